"""Decisions by policy, pages of a queue, pooled systems and catch-up points against plain loops."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from triagelake.functions import align, verifier
from triagelake.operators import detail

FOLDER = "/root/testdata/sf0.001"


def drawn(spark, n=120):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), rng.random(), rng.random() if rng.random() < 0.8 else None, int(rng.random() < 0.3), int(rng.random() < 0.2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "unit_id long, ev string, r double, s double, y int, crit int")


def test_points_and_decisions(spark):
    rows, u = drawn(spark)
    risks = {"r": F.col("r"), "s": F.col("s")}
    found = detail.points(u, risks, (0.1,), (0.0, 0.4)).cache()
    got = {(p["ev"], p["policy"], p["point"]): (p["threshold"], p["feasible"]) for p in found.collect()}
    for ev in ("a", "b"):
        for place, policy in ((2, "r"), (3, "s")):
            scores = sorted((row[place], row[4]) for row in rows if row[1] == ev and row[place] is not None)
            k = math.ceil((len(scores) - 1) * (1.0 - 0.1))
            assert got[ev, policy, "budget_0.10"] == (scores[k][0], True)
            ok = [scores[i][0] for i in range(29, len(scores)) if sum(y for _, y in scores[: i + 1]) / (i + 1) <= 0.4 + 1e-12]
            assert got[ev, policy, "risk_0.40"] == ((max(ok), True) if ok else (-math.inf, False))
            assert got[ev, policy, "risk_0.00"][1] is False
    shown = {d["unit_id"]: d["risks"] for d in detail.with_decisions(u, risks, found.filter("ev IS NOT NULL"), "budget_0.10").collect()}
    assert len(shown) == len(rows)
    for i, ev, r, s, *_ in rows:
        wanted = [(p, v, "review" if v >= got[ev, p, "budget_0.10"][0] else "accept") for p, v in (("r", r), ("s", s)) if v is not None] if ev else []
        assert [(x["policy"], x["risk"], x["decision"]) for x in shown[i]] == wanted


def test_queue_pages(spark):
    rows, u = drawn(spark)
    u = u.withColumn("review", F.col("r") >= 0.7)
    tests = {"all": lambda x: True, "review": lambda x: x[2] >= 0.7, "accepted_errors": lambda x: x[2] < 0.7 and x[4], "accepted_critical": lambda x: x[2] < 0.7 and x[5]}
    for page, ok in tests.items():
        wanted = sorted((x for x in rows if ok(x)), key=lambda x: x[2], reverse=not page.startswith("accepted"))
        found = sorted(detail.queue_page(u, page, 7).collect(), key=lambda x: x["place"])
        assert [x["unit_id"] for x in found] == [x[0] for x in wanted[:7]] and {x["total"] for x in found} == {len(wanted)} and [x["place"] for x in found] == [*range(1, len(found) + 1)]
    assert detail.queue_page(u.filter("false"), "all", 7).collect() == []


def test_pooled_systems_and_change(spark):
    rng = random.Random(9)
    rows = [(i, s, [rng.choice("abc") for _ in range(rng.randint(0, 6))], [rng.choice("abc") for _ in range(rng.randint(0, 6))]) for i in range(40) for s in ("x", "y")]
    scored = spark.createDataFrame(rows, "id int, system string, ref array<string>, hyp array<string>").withColumn("a", align.aligned("ref", "hyp")).select("id", "system", *(c.alias(n) for n, c in align.counts(F.col("a")).items()))
    rates = detail.pooled_by_system(scored, ["system"]).cache()
    wer = {}
    for r in rates.collect():
        mine = [(len(ref), align.distance(ref, hyp)) for _, s, ref, hyp in rows if s == r["system"]]
        n, e = sum(a for a, _ in mine), sum(b for _, b in mine)
        own = [b / a for a, b in mine if a]
        wer[r["system"]] = e / n
        assert (r["n_units"], r["n_ref"], r["errors"]) == (len(mine), n, e) and r["wer"] == pytest.approx(e / n) == pytest.approx(r["sub_rate"] + r["del_rate"] + r["ins_rate"])
        assert r["mean_wer"] == pytest.approx(sum(own) / len(own)) and r["share_over"] == pytest.approx(sum(x > 0.2 for x in own) / len(own)) and r["share_exact"] == pytest.approx(sum(x == 0 for x in own) / len(own))
    assert detail.relative_change(rates.withColumn("k", F.lit(1)), ["k"], "system", "x", "y", "wer").first()["percent"] == round(100 * (1 - wer["y"] / wer["x"]))
    none = spark.createDataFrame([(1, "x", 0.0), (1, "y", 1.0), (2, "y", 1.0)], "k int, system string, wer double")
    assert {r["percent"] for r in detail.relative_change(none, ["k"], "system", "x", "y", "wer").collect()} == {None}


def test_catch_up(spark):
    rng = random.Random(2)
    items = [(i, rng.randint(1, 4), rng.randint(0, 3), rng.random()) for i in range(60)]
    budgets = (0.0, 0.25, 0.5, 1.0)
    df = spark.createDataFrame(items, "id int, cost int, wrong int, s double").withColumn("k", F.lit("k"))
    found = {r["budget"]: r["left"] for r in detail.left_by_budget(df, ["k"], [F.desc("s"), "id"], "cost", "wrong", budgets).collect()}
    total = sum(c for _, c, *_ in items)
    for b in budgets:
        spent = left = 0
        for _, c, w, _ in sorted(items, key=lambda x: -x[3]):
            spent += c
            left += w if spent > b * total + 1e-9 else 0
        assert found[b] == left
    curve = lambda *left: spark.createDataFrame([("k", b, x) for b, x in zip(budgets, left)], "k string, budget double, left int")
    first = lambda a, b: detail.first_catch_up(curve(*a), curve(*b), ["k"]).first()["first_budget"]
    assert first((9, 7, 4, 0), (9, 5, 4, 0)) == 0.5 and first((9, 7, 5, 1), (9, 5, 4, 0)) is None


def test_consultations(spark):
    rows = [(1, 1, "user", 2.0, 3.5, "a  b"), (1, 0, "assistant", 0.0, 2.0004, ""), (1, 2, None, 3.5, 3.6, None), (2, None, "user", 0.0, 1.0, "x")]
    found = {r["consultation"]: json.loads(r["payload"]) for r in detail.consultations(spark.createDataFrame(rows, "consultation long, idx long, role string, start double, end double, text string")).collect()}
    assert found[1]["roles"] == ["assistant", "user"] and found[1]["n_turns"] == 3 and found[1]["until_ms"] == 3600
    assert [(t["idx"], t["end_ms"], t.get("n_words")) for t in found[1]["turns"]][:2] == [(0, 2000, 0), (1, 3500, 2)] and found[2]["n_turns"] == 1


def test_unit_page(spark):
    from triagelake.plans import queries_detail

    shown = queries_detail.QUERIES["sv_api_unit"](spark, FOLDER).collect()
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    texts = {(t["conv_id"], t["turn"]): t["text"].lower().split() for t in turns}
    places = {c: sorted(t for k, t in texts if k == c) for c, _ in texts}
    wanted = {(c, t): (texts[c, t], texts[c, line[i + 1]]) for c, line in places.items() for i, t in enumerate(line[:-2])}
    assert {(r["conv_id"], r["turn"]) for r in shown} == set(wanted)
    for r in shown:
        ref, hyp = wanted[r["conv_id"], r["turn"]]
        assert [o["ref"] for o in r["ops"] if o["ref"] is not None] == ref and [o["hyp"] for o in r["ops"] if o["hyp"] is not None] == hyp
        assert sum(o["op"] in "SDI" for o in r["ops"]) == r["subs"] + r["dels"] + r["ins"] == align.distance(ref, hyp)
        assert [x["policy"] for x in r["risks"]] == ["raw", "rules", "recalibrated"][: 2 + (r["turn"] % 4 > 0)]
        assert r["risks"][0]["risk"] == pytest.approx(1 - r["conf"]) and all((x["decision"] == "review") == (x["risk"] >= x["threshold"]) for x in r["risks"])


def test_gaps_and_words_by_display_word(spark):
    tokens = spark.createDataFrame([(1, 0, 0, 0.2, 0.5, False, 0), (1, 1, 2, 0.4, 0.9, False, 1), (1, 2, 2, 0.1, 0.3, True, 0)], "u int, at int, owner int, score double, p double, critical boolean, wrong int")
    found = {r["owner"]: (r["score"], r["min_p"], r["critical"], r["wrong"]) for r in verifier.by_display_word(tokens, ["u"]).collect()}
    assert found == {0: (0.2, 0.5, False, 0), 2: (0.4, 0.3, True, 1)}
    gaps = spark.createDataFrame([(1, 0, 0.1, "x", 1), (1, 1, 0.3, "", 0), (1, 2, 0.9, "y", 1), (1, 3, 0.2, "z", 1)], "u int, at int, score double, suggestion string, truth int")
    found = {r["after"]: (r["score"], r["suggestion"], r["truth"]) for r in verifier.gap_after(gaps, tokens.select("u", "at", "owner"), ["u"]).collect()}
    assert found == {-1: (0.1, "x", 1), 0: (0.3, "", 0), 2: (0.9, "y z", 2)}
