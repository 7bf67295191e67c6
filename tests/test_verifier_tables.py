"""The verifier's tables, review by duration and the rewritten text functions, against brute force and hand-made cases."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from triagelake import catalog
from triagelake.functions import align, combine, text, verifier
from triagelake.operators import review
from triagelake.plans import views
from triagelake.sources import records


def test_hyp_tokens_keep_their_display_word(spark):
    rows = [(["I've", "got", "pain"],), (["twenty", "six", "mg,", "uh", "no", "no", "25mg"],), ([],), (None,)]
    found = [tuple(r["x"]) for r in spark.createDataFrame(rows, "w array<string>").select(verifier.hyp_tokens(F.col("w")).alias("x")).collect()]
    assert found[0] == (["i", "have", "got", "pain"], [0, 0, 1, 2])
    assert found[1][0][:3] == ["20", "6", "mg"] and found[1][1][:3] == [0, 1, 2] and found[1][0].count("no") == 1
    assert found[2] == ([], []) and found[3] == ([], [])


def test_scoring_tokens(spark):
    one = lambda s: spark.createDataFrame([(s,)], "t string").select(text.scoring_tokens(F.col("t")).alias("x")).first()["x"]
    assert one("I I took twenty six <UNSURE>milligrams</UNSURE> um, of it of it.") == ["i", "took", "26", "mg", "of", "it"]
    assert one("") == []


def test_p_full(spark):
    rows = [([0.1, 0.2], ["C", "W", "S"], 0.9), ([0.1], ["C", "W", "S"], 0.9), (None, ["C"], None), ([], [], 0.3)]
    found = [r["x"] for r in spark.createDataFrame(rows, "p array<double>, s array<string>, c double").select(verifier.p_full("p", "s", "c").alias("x")).collect()]
    assert found == [[0.1, 0.9, 0.2], [0.9, 0.9, 0.9], [0.5], []]


def test_word_and_gap_tables(spark):
    unit = ", ".join(f"{c} double" for c in verifier.UNIT if c != "n_words")
    stats = (0.0,) * 8
    rows = [(1, "take one tablet daily".split(), [0.9, 0.4, 0.3, 0.9], "take two tablets daily".split(), None, *stats), (2, ["a", "b"], [0.5, 0.6], None, None, *stats), (3, ["pain"], [0.7], "chest pain not now".split(), [0.1, 0.2, 0.3, 0.5], *stats), (4, [], [], ["x"], [0.4], *stats)]
    df = spark.createDataFrame(rows, f"u int, tokens array<string>, p array<double>, other array<string>, other_p array<double>, {unit}")
    words, gaps = (t.orderBy("u", "at").toPandas() for t in verifier.word_and_gap_tables(df, ["u"]))
    w, g = words[words.u == 1], gaps[gaps.u == 1]
    assert w.agree.tolist() == [1, 0, 0, 1] and w.dis_run.tolist() == [0, 2, 2, 0] and w.p_prev.tolist() == [1.0, 0.9, 0.4, 0.3] and w.p_next.tolist() == [0.4, 0.3, 0.9, 1.0]
    assert w.own_w.tolist() == [1.0, 10.0, 1.0, 1.0] and w.other_w.tolist() == [0, 1, 1, 0] and w.other_p.isna().all() and w.pos.tolist() == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert w.agree_win.tolist() == pytest.approx([1 / 3, 0.5, 0.5, 1 / 3])
    assert g.dis_near.tolist() == [0, 1, 2, 1, 0] and g.edge.tolist() == [1, 0, 0, 0, 1] and g.left_p.tolist() == [1.0, 0.9, 0.4, 0.3, 0.9] and g.right_p.tolist() == [0.9, 0.4, 0.3, 0.9, 1.0]
    w, g = words[words.u == 2], gaps[gaps.u == 2]
    assert w[["agree", "agree_win", "other_w", "dis_run", "extra_near"]].isna().all().all() and g[["extra", "dis_near", "extra_p"]].isna().all().all()
    w, g = words[words.u == 3], gaps[gaps.u == 3]
    assert g.extra.tolist() == [1, 2] and g.extra_crit.tolist() == [0, 1] and g.extra_w.tolist() == [1.0, 11.0] and g.extra_p.tolist() == pytest.approx([0.1, 0.4]) and g.suggestion.tolist() == ["chest", "not now"]
    assert w.other_p.tolist() == [0.2] and w.extra_near.tolist() == [3]
    assert len(words[words.u == 4]) == 0 and gaps[gaps.u == 4].extra.tolist() == [1] and gaps[gaps.u == 4].edge.tolist() == [1]
    for name in ("solo", "second", "full", "v3"):
        wf, gf = verifier.variant_features(name)
        assert set(wf) <= set(words.columns) and set(gf) <= set(gaps.columns)
    assert set(verifier.variant_features("second")[0]) < set(verifier.variant_features("full")[0])


def test_gaps_after_display_words(spark):
    gaps = spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate([(0.1, ""), (0.9, "x"), (0.2, "y"), (0.3, ""), (0.4, "")])], "u int, at int, score double, suggestion string")
    owners = spark.createDataFrame([(1, i, o) for i, o in enumerate([0, 0, 1, 2])], "u int, at int, owner int")
    found = {r["after"]: (r["score"], r["suggestion"]) for r in verifier.gap_after(gaps, owners, ["u"]).collect()}
    assert found == {-1: (0.1, ""), 0: (0.9, "x y"), 1: (0.3, ""), 2: (0.4, "")}


def test_whole_units_cost_their_duration():
    clip = lambda u, a, b, pred, duration: {"unit": u, "a": a, "b": b, "pred": pred, "true": 1.0, "crit": 0.0, "duration": duration}
    # Eight clips that fill a unit of 2 s, and a unit of 20 s with one flag of 1 s.
    items = pd.DataFrame([clip("u", 0.2 * k, 0.2 * k + 0.4, 1.0, 2.0) for k in range(8)] + [clip("long", 0.0, 1.0, 3.9, 20.0)])
    assert review.hybrid_curve(items, [2.0])[0] == [8.0]
    assert review.hybrid_curve(items, [2.0, 3.0])[0] == [8.0, 9.0]
    # The flag of the long unit is heard alone: the unit as a whole would cost 20 s.
    only = items[items["unit"] == "long"]
    assert review.hybrid_curve(only, [0.5, 1.0, 19.0])[0] == [0.0, 1.0, 1.0]
    assert review.hybrid_curve(items, [2.0], scale=0.0)[0] == review.queue_curve(items, [2.0])[0]


def test_queue_charges_what_was_not_heard():
    rng = random.Random(4)
    for _ in range(100):
        rows = [(rng.choice("uv"), a := rng.randint(0, 30) / 2, a + rng.randint(1, 8) / 2, rng.randint(1, 9) / 3, 1.0, 0.0) for _ in range(rng.randint(1, 15))]
        items = pd.DataFrame(rows, columns="unit a b pred true crit".split())
        order = sorted(range(len(rows)), key=lambda i: -rows[i][3] / (rows[i][2] - rows[i][1]))
        heard, spent, curve = set(), 0.0, [0.0]
        for i in order:
            new = {(rows[i][0], k) for k in range(int(rows[i][1] * 2), int(rows[i][2] * 2))} - heard
            heard |= new
            curve.append(curve[-1] + len(new) / 2)
        budgets = [0.0, 1.0, 2.5, 7.0, 100.0]
        assert review.queue_curve(items, budgets)[0] == [max(k for k, c in enumerate(curve) if c <= b + 1e-9) for b in budgets]


def brute_collapse(tokens, longest=4, most=6):
    """By the words of the description: mark loops, then take back a repeated group as soon as it is complete."""
    n, whole = len(tokens), set()
    for size in range(1, longest + 1):
        at = 0
        while at < n:
            group = tokens[at : at + size]
            times = 1
            while len(group) == size and "<*>" not in group and tokens[at + times * size : at + (times + 1) * size] == group:
                times += 1
            if (times - 1) * size > most:
                whole |= set(range(at, at + times * size))
                at += times * size
            else:
                at += 1
    kept = []
    for i in range(n):
        kept.append(i)
        again = True
        while again:
            again = False
            for size in range(longest, 0, -1):
                pair = kept[-2 * size :]
                if len(pair) == 2 * size and not whole & set(pair) and [tokens[k] for k in pair[:size]] == [tokens[k] for k in pair[size:]] and "<*>" not in [tokens[k] for k in pair]:
                    del kept[-size:]
                    again = True
                    break
    return kept


def test_collapse_and_terms():
    rng = random.Random(5)
    for k in range(3000):
        tokens = [rng.choice(["a", "b", "c", "<*>"][: 2 + k % 3]) for _ in range(rng.randint(0, 24))]
        tokens = tokens[:4] * rng.randint(1, 6) + tokens[4:] if k % 3 == 0 else tokens
        assert text.collapse(tokens) == brute_collapse(tokens)
    for _ in range(300):
        terms = {tuple(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(5)}
        tokens, expected, at = [rng.choice("abcd") for _ in range(20)], [], 0
        while at < len(tokens):
            fit = max((len(t) for t in terms if tuple(tokens[at : at + len(t)]) == t), default=0)
            expected += [(at, fit)] if fit else []
            at += fit or 1
        assert list(text.TermMatcher([" ".join(t) for t in terms]).find(tokens)) == expected
    assert text.CANONICAL["milligrams"] == "mg" and text.CANONICAL["eg"] == "for example"


def test_edit_count_has_no_limit_of_different_tokens(spark):
    many = [f"t{i}" for i in range(40_000)]
    assert align.distance(many, ["x", *many[5:200]]) == 40_000 - 195
    found = spark.createDataFrame([(many, many[:3]), (None, ["a"]), ([], ["a", "b"])], "r array<string>, h array<string>").select(align.edit_count("r", "h").alias("n"))
    assert [r["n"] for r in found.collect()] == [39_997, None, 2]


def test_combinations():
    rng = random.Random(6)
    assert combine.nearest_occurrences("a b a b a".split(), [(["a"], 3.0), (["a"], 3.0), (["b", "a"], 0.0), (["z"], 1.0), ([], 0.0)]) == [2, 4, 1, -1, -1]
    for _ in range(200):
        tokens = [rng.choice("abc") for _ in range(8)]
        wanted = [([rng.choice("abc") for _ in range(rng.randint(1, 2))], rng.random() * 8) for _ in range(4)]
        used, expected = set(), []
        for parts, near in wanted:
            at = [i for i in range(8) if tokens[i : i + len(parts)] == parts and (i, len(parts)) not in used]
            best = sorted(at, key=lambda i: (abs(i - near), i))[:1]
            expected.append(best[0] if best else -1)
            used |= {(b, len(parts)) for b in best}
        assert combine.nearest_occurrences(tokens, wanted) == expected
    one, two = "take the two pills".split(), "take two pills now".split()
    assert combine.combined(one, [0.9, 0.2, 0.9, 0.9], two, [0.9, 0.9, 0.9, 0.8]) == "take two pills now".split()
    assert combine.combined(["a"], [0.5], ["b"], [0.55]) == ["a"] and combine.combined(["a"], [0.5], ["b"], [0.65]) == ["b"]
    assert combine.combined(one, [0.1] * 4, [], []) == []


def test_append_only_log_goes_on_where_it_broke_off(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *ids: spark.createDataFrame([(str(i), i * 2) for i in ids], "unit_id string, n int")
    assert records.read_jsonl(spark, path, "unit_id string, n int", "unit_id").collect() == []
    records.append_jsonl(rows(1, 2), path, "unit_id")
    (tmp_path / "log" / "part-torn.json").write_text('{"unit_id":"3","n":6}  \n{"unit_id":"4","n":')
    records.append_jsonl(rows(1, 2, 3, 4, 5), path, "unit_id")
    found = records.read_jsonl(spark, path, "unit_id string, n int", "unit_id").collect()
    assert sorted((r["unit_id"], r["n"]) for r in found) == [(str(i), i * 2) for i in range(1, 6)]


def test_content_keys_and_validation(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 3)], "g int, s string, n int")
    keys = {r["g"]: r["key"] for r in records.content_key(df, ["g"], ["s", "n"]).collect()}
    again = {r["g"]: r["key"] for r in records.content_key(df.orderBy(F.desc("n")).repartition(3), ["g"], ["s", "n"]).collect()}
    assert keys == again and keys[1] != keys[2]
    found = records.validated(df, {"s": F.col("s") == "a", "n": F.when(F.col("g") == 1, F.col("n") < 5)}).orderBy("g", "s").collect()
    assert [r["verdict"] for r in found] == ["ok", "s", "n", "s"]


def test_units_of_another_system_are_scored_again(spark):
    refs = spark.createDataFrame([("a", "Take two tablets <UNIN/> daily daily."), ("b", "no pain"), ("c", "")], "unit_id string, reference string")
    found = spark.createDataFrame([("a", "take 2 pills with food daily"), ("c", "uh"), ("x", "gone")], "unit_id string, text string")
    scored = {r["unit_id"]: r for r in align.score_units(found, refs, "unit_id").collect()}
    assert (scored["a"]["n_ref"], scored["a"]["hits"], scored["a"]["subs"], scored["a"]["absorbed"], scored["a"]["errors"]) == (4, 3, 1, 2, 1)
    assert (scored["b"]["n_ref"], scored["b"]["dels"]) == (2, 2) and scored["c"]["errors"] == 0 and set(scored) == {"a", "b", "c"}


def test_tokens_have_their_words_probabilities(spark):
    rows = [(["I've", "pain"], [0.9, 0.4], 0.2), (["I've", "pain"], [0.9], 0.2), (["pain"], None, None)]
    df = spark.createDataFrame(rows, "w array<string>, p array<double>, c double").withColumn("t", verifier.hyp_tokens(F.col("w")))
    found = [r["x"] for r in df.select(verifier.token_probabilities(F.col("t.owner"), F.col("p"), F.col("c")).alias("x")).collect()]
    assert found == [[0.9, 0.9, 0.4], [0.9, 0.9, 0.2], [0.5]]


@pytest.fixture(scope="module")
def turns(spark):
    """The catalogue's pairs of turns on the smallest tables, collected."""
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    return [(r["conv_id"], r["turn"], list(r["ref"]), list(r["hyp"])) for r in views.pairs(spark, "/root/testdata/sf0.001").collect()]


def test_critical_tokens_against_a_loop(spark, turns):
    import re

    def critical(tokens, i):
        t, following = tokens[i], tokens[i + 1] if i + 1 < len(tokens) else None
        number = not re.fullmatch(r"[0-9]+(st|nd|rd|th)", t) and (re.search("[0-9]", t) or t in text.COUNT_WORDS or (t == "one" and following in text.ONE_BEFORE))
        return t in text.NEGATIONS or bool(number)

    expected = {}
    for c, turn, ref, hyp in turns:
        status = align.align(ref, hyp).ref_status
        at = [i for i in range(len(ref)) if critical(ref, i)]
        expected[c, turn] = (len(at), sum(status[i] == "C" for i in at))
    found = {(r["conv_id"], r["turn"]): (r["n"], r["correct"]) for r in catalog.queries()["al_critical"](spark, "/root/testdata/sf0.001").collect()}
    assert found == {k: v for k, v in expected.items() if k in found} and all(v == (0, 0) for k, v in expected.items() if k not in found)


def test_churn_against_a_loop(spark, turns):
    expected = {}
    for c, _, ref, hyp in turns:
        one, two = align.align(ref, hyp).ref_status, align.align(ref, [t for t in hyp if len(t) > 3]).ref_status
        n = expected.setdefault(c, [0, 0, 0])
        for a, b in zip(one, two, strict=True):
            n[0] += a != "C" and b == "C"
            n[1] += a == "C" and b != "C"
            n[2] += a != "C" and b != "C"
    found = {r["conv_id"]: [r["fixed"], r["broken"], r["wrong_in_both"]] for r in catalog.queries()["agg_churn"](spark, "/root/testdata/sf0.001").collect()}
    assert found == {c: n for c, n in expected.items() if c in found} and all(n == [0, 0, 0] for c, n in expected.items() if c not in found)
