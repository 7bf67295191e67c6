"""Operators against brute force and hand-made cases."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.functions import align, features, text
from triagelake.operators import bootstrap, intervals, metrics, policies, review, splits, thresholds, windows
from triagelake.plans import queries_sequences, views
from triagelake.sources import records
from triagelake.streaming import live


def scored(spark, seed, n=300):
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), rng.choice("gh"), rng.random() < 0.4, rng.randint(0, 40) / 40) for i in range(n)]
    rows = [(i, e, g, int(y), int(rng.random() < 0.2), r, rng.randint(1, 60), rng.randint(0, 9)) for i, e, g, y, r in rows]
    return rows, spark.createDataFrame(rows, "unit_id long, ev string, group_id string, y int, crit int, r double, n_ref long, errors long")


@pytest.mark.parametrize("seed", [1, 2])
def test_rank_metrics(spark, seed):
    rows, df = scored(spark, seed)
    for ev in "ab":
        p, y = (np.array([r[k] for r in rows if r[1] == ev]) for k in (5, 3))
        auroc = metrics.auroc(df.filter(F.col("ev") == ev), ["ev"]).first()["auroc"]
        wins = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
        assert auroc == pytest.approx(np.mean(wins))
        found = metrics.auprc(df.filter(F.col("ev") == ev), ["ev"]).first()
        ap, before = 0.0, 0.0
        for t in sorted(set(p), reverse=True):
            tp, flagged = y[p >= t].sum(), (p >= t).sum()
            ap += (tp / y.sum() - before) * tp / flagged
            before = tp / y.sum()
        assert found["auprc"] == pytest.approx(ap)
        b = np.minimum((p * 15).astype(int), 14)
        ece = sum(abs(p[b == k].mean() - y[b == k].mean()) * (b == k).sum() for k in set(b)) / len(p)
        assert metrics.ece(df.filter(F.col("ev") == ev), ["ev"]).first()["ece"] == pytest.approx(ece)
    one = df.withColumn("y", F.lit(1))
    assert all(r["auroc"] is None for r in metrics.auroc(one, ["ev"]).collect())


@pytest.mark.parametrize("seed", [3, 4])
def test_thresholds(spark, seed):
    rows, df = scored(spark, seed, 200)
    for ev in "ab":
        p, y = (np.array([r[k] for r in rows if r[1] == ev], float) for k in (5, 3))
        own = df.filter(F.col("ev") == ev)
        for r in thresholds.budget(own, ["ev"], [0.01, 0.1, 0.25, 0.5]).collect():
            assert r["threshold"] == np.quantile(p, 1 - r["budget"], method="higher")
        order, s = np.argsort(p, kind="stable"), np.sort(p)
        for r in thresholds.risk_target(own, ["ev"], [0.2, 0.4], n_min=10).collect():
            wrong = np.cumsum(y[order])
            ok = [s[k] for k in range(9, len(s)) if (k + 1 == len(s) or s[k + 1] != s[k]) and wrong[k] / (k + 1) <= r["alpha"] + 1e-12]
            assert r["threshold"] == (max(ok) if ok else -math.inf)
    strict = thresholds.risk_clopper_pearson(df, ["ev"], [0.9], n_min=10).collect()
    assert all(r["threshold"] == 1.0 for r in strict)


def test_clopper_pearson_closed_forms():
    n = np.array([1.0, 10.0, 50.0])
    assert thresholds.clopper_pearson_upper(np.zeros(3), n) == pytest.approx(1 - 0.05 ** (1 / n), abs=1e-9)
    assert thresholds.clopper_pearson_upper(n, n).tolist() == [1.0, 1.0, 1.0]
    assert thresholds.clopper_pearson_upper(np.array([2.0]), np.array([20.0]))[0] == pytest.approx(0.2826, abs=1e-3)


def test_bootstrap_resamples_whole_groups(spark):
    rows, df = scored(spark, 5)
    table = bootstrap.draws(spark, ["g", "h"], 50, 1)
    reps = bootstrap.replicate_ratios(df, ["ev"], table, {"rate": (F.col("y"), F.lit(1))}).collect()
    drawn = {r["rep"]: {} for r in table.collect()}
    for r in table.collect():
        drawn[r["rep"]][r["group_id"]] = r["mult"]
    for r in reps:
        sample = [x[3] for x in rows if x[1] == r["ev"] for _ in range(drawn[r["rep"]].get(x[2], 0))]
        assert r["rate"] == pytest.approx(np.mean(sample))
    holm = bootstrap.holm(spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.04), (1, "c", 0.03), (1, "d", None)], "f int, t string, p double"), ["f"], "p", "t")
    assert {r["t"]: r["p_holm"] and round(r["p_holm"], 6) for r in holm.collect()} == {"a": 0.04, "b": 0.09, "c": 0.09, "d": None}


def brute_cost(ref, hyp):
    cost = [list(range(len(hyp) + 1))]
    for t in ref:
        above, row = cost[-1], []
        for j in range(len(hyp) + 1):
            if t == text.WILDCARD:
                row.append(min(above[: j + 1]))
            else:
                row.append(min([above[j] + 1] + ([row[j - 1] + 1, above[j - 1] + (t != hyp[j - 1])] if j else [])))
        cost.append(row)
    return cost[-1][-1]


def test_alignment(spark):
    rng = random.Random(6)
    rows = [([rng.choice(["a", "b", "c", "<*>"]) for _ in range(rng.randint(0, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for _ in range(400)]
    for ref, hyp in rows:
        a = align.align(ref, hyp)
        errors = a.ref_status.count("S") + a.ref_status.count("D") + a.hyp_status.count("I")
        assert errors == brute_cost(ref, hyp) and a.ref_status.count("S") == a.hyp_status.count("S")
        ops = align.operations(a)
        assert [i for _, i, _ in ops if i >= 0] == list(range(len(ref))) and [j for _, _, j in ops if j >= 0] == list(range(len(hyp)))
    df = spark.createDataFrame(rows, "ref array<string>, hyp array<string>").withColumn("a", align.aligned("ref", "hyp"))
    plain = F.filter("ref", lambda t: t != text.WILDCARD)
    found = df.select("ref", "hyp", align.counts(F.col("a"))["errors"].alias("e"), align.edit_count(plain, F.col("hyp")).alias("n"), align.wildcard_cost(F.col("ref"), F.col("hyp")).alias("w")).collect()
    for r in found:
        assert r["e"] == brute_cost(r["ref"], r["hyp"]) == r["w"]
        assert r["n"] == brute_cost([t for t in r["ref"] if t != text.WILDCARD], r["hyp"])
    assert align.align(["a", "b"], ["b"]).ref_status == ["D", "C"] and align.align(["a"], ["b", "a"]).hyp_status == ["I", "C"]


def test_text(spark):
    one = lambda s, f: spark.createDataFrame([(s,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]
    assert one("OK, take 5 mm of the U.S.A. stuff, 3 g/dL alright", text.variants) == "okay, take 5 millimeter of the USA stuff, 3 g per dL all right"
    assert one("Ohh I see, oh seven", text.variants).split() == ["I", "see,", "oh", "seven"]
    assert one("a <UNIN/> b <UNSURE>c</UNSURE>", text.strip_tags) == "a b c"
    assert one("Take 500 Milligrams <UNIN/><UNIN/> of it.", text.reference_tokens) == ["take", "500", "mg", "<*>", "of", "it"]
    with pytest.raises(Exception, match="unknown tag"):
        one("a <b> c", text.reference_tokens)
    assert one("One. Two\nthree, 5 six", text.pieces) == ["One.", "Two", "three,", "5", "six"]
    assert text.collapse("it is a bit it is a bit ok".split()) == [0, 1, 2, 3, 8]
    assert text.collapse(["no"] * 12) == list(range(12)) and text.collapse(["no"] * 4) == [0]
    assert text.collapse(["<*>", "<*>", "a"]) == [0, 1, 2]
    assert text.numbers_to_digits("i took twenty six of two hundred and five".split()) == ["i", "took", "26", "of", "200", "and", "5"]
    assert list(text.TermMatcher(["chest pain", "pain", "chest pain relief"]).find("a chest pain relief pain".split())) == [(1, 3), (4, 1)]
    crit = spark.createDataFrame([(t,) for t in (["one", "tablet"], ["one", "man"], ["1st", "x"], ["12", "x"], ["denies", "x"])], "t array<string>")
    flag = lambda t: text.is_negation(t[0]) | text.is_number(t[0], t[1])
    assert [r[0] for r in crit.select(flag(F.col("t"))).collect()] == [True, False, False, True, True]


def test_intervals(spark):
    rng = random.Random(7)
    rows = [(k, float(a := rng.randint(0, 400)), float(a + rng.randint(1, 25))) for k in range(4) for _ in range(20)]
    df = spark.createDataFrame(rows, "k int, start double, end double")
    covered = {r["k"]: r["covered"] for r in intervals.union_length(df, ["k"]).collect()}
    packed = intervals.windows(intervals.block_table(df, ["k"]), ["k"]).collect()
    for k in range(4):
        own = sorted((a, b) for j, a, b in rows if j == k)
        assert covered[k] == len({s for a, b in own for s in range(int(a), int(b))})
        blocks = []
        for a, b in own:
            if blocks and a < blocks[-1][1]:
                blocks[-1][1] = max(blocks[-1][1], b)
            else:
                blocks.append([a, b])
        wins = []
        for a, b in blocks:
            if wins and b - wins[-1][0] <= 30:
                wins[-1][1] = b
            else:
                wins.append([a, b])
        assert [[r["start"], r["end"]] for r in sorted(packed, key=lambda r: r["window"]) if r["k"] == k] == wins


def test_number_words_in_the_normaliser(spark):
    one = lambda s, f: spark.createDataFrame([(s,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]
    for f in (text.plain_tokens, text.reference_tokens):
        assert one("I took twenty six of Two Hundred, um, and he doesn't.", f) == "i took 26 of 200 and he does not".split()
        assert one("twenty six. Twenty\nsix OK, Dolo 650 three times, just one", f) == "26 20 6 okay dolo 650 3 times just one".split()
        assert one("1,250.5 mg and 3 mm", f) == "1250.5 mg and 3 mm".split() and one("", f) == [] and one(None, f) is None
    assert one("twenty <UNIN/>\n<UNIN/> six\n<UNIN/>", text.reference_tokens) == ["20", "<*>", "6", "<*>"]
    docs = spark.createDataFrame([("It's <b>two thousand and</b> it's five.",)], "t string")
    assert docs.select(F.array_join(text.plain_tokens(text.strip_tags(F.col("t"))), " ")).first()[0] == "it is 2000 and it is 5"


def test_review_curves(spark):
    cover = review.Cover()
    cover.add(0, 2), cover.add(5, 6)
    assert cover.new_seconds(1, 5.5) == 3 and cover.new_seconds(0, 1) == 0
    cover.add(2, 5)
    assert (cover.starts, cover.ends) == ([0], [6])
    items = spark.createDataFrame([("c", "u", 0.25 * i, 0.25 * i + 0.8, 1.0, 1.0, 0.0) for i in range(8)], "consultation string, unit string, a double, b double, pred double, true double, crit double")
    got = {(r["method"], r["budget"]): r["caught"] for r in review.review_curves(items, [0.0, 1.0, 3.0]).collect()}
    assert got["queue", 0.0] == 0 and got["queue", 3.0] == got["hybrid", 3.0] == 8 and got["queue", 1.0] >= 1


def test_review_of_windows_and_of_unsure_words(spark):
    # u: two words that overlap, and a gap, which has no p; v: the least sure unit, one word; w: no clips.
    rows = [("c", "u", 0.0, 1.0, 0.1, 1.0, 1.0, 0.9, 0.8, 4.0), ("c", "u", 0.5, 1.5, 0.2, 2.0, 0.0, 0.2, 0.8, 4.0), ("c", "u", 2.0, 3.0, 0.9, 4.0, 0.0, None, 0.8, 4.0)]
    rows += [("c", "v", 0.0, 1.0, 0.5, 8.0, 2.0, 0.5, 0.3, 2.0), ("c", "w", None, None, None, None, None, None, 0.5, 3.0)]
    names = "consultation string, unit string, a double, b double, pred double, true double, crit double, p double, conf double, duration double"
    got = review.review_curves(spark.createDataFrame(rows, names), [1, 2, 2.5, 5, 9], review.FIVE).collect()
    assert {r["total"] for r in got} == {15.0}
    curve = lambda m: [(r["caught"], r["crit_caught"]) for r in sorted((r for r in got if r["method"] == m), key=lambda r: r["budget"])]
    assert curve("window_review") == [(0, 0), (8, 2), (8, 2), (8, 2), (15, 3)]
    assert curve("whisper_conf") == [(2, 0), (10, 2), (11, 3), (11, 3), (11, 3)]
    assert curve("verifier") == [(4, 0), (12, 2), (12, 2), (15, 3), (15, 3)]
    assert curve("perfect") == [(8, 2), (12, 2), (12, 2), (15, 3), (15, 3)] and curve("hybrid")[-1] == (15, 3)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_every_word_is_a_clip(spark):
    d = "/root/testdata/sf0.001"
    items = queries_sequences._items(spark, d)
    n = views.table(spark, d, "conversations").agg(F.sum(F.size(views.tokens_of(F.col("text"))))).first()[0]
    assert items.filter("a IS NOT NULL").count() == n and items.agg({"pred": "min"}).first()[0] == pytest.approx(0.1) and items.agg({"pred": "max"}).first()[0] == pytest.approx(1.0)
    assert {r["method"] for r in queries_sequences.iv_curve_parts(spark, d).collect()} == set(review.FIVE)


def test_policies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=1500)
    y = (rng.random(1500) < 1 / (1 + np.exp(-(1.5 * x - 0.5)))).astype(int)
    df = spark.createDataFrame([(i, f"g{i % 9}", float(a), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "unit_id long, group_id string, x double, y int")
    model, intercept = policies.fit_logistic(df, ["x"], "y", 100.0)
    mean, scale, weight = model["x"]
    assert weight / scale == pytest.approx(1.5, abs=0.2) and intercept - weight * mean / scale == pytest.approx(-0.5, abs=0.2)
    raw = df.withColumn("r", policies.sigmoid(F.col("x") * 3.0))
    a, b, fell = policies.fit_platt(raw)
    assert a == pytest.approx(0.5, abs=0.1) and b == pytest.approx(-0.5, abs=0.2) and not fell
    assert policies.fit_platt(raw.withColumn("y", 1 - F.col("y")))[2]
    assert sorted(policies.balanced_folds({"a": 9, "b": 5, "c": 4, "d": 1}, 2).values()) == [0, 0, 1, 1]
    two = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.2), (1, 0.9)], "side int, r double")
    assert policies.ks_statistic(two, [], "side").first()["ks"] == 0.5
    assert policies.ks_p_value(0.0, 5, 5) == 1.0


def test_splits(spark):
    rows = [(1, "t1", "s", "test"), (2, "t1", "u", "calibration"), (3, "t2", "u", "calibration"), (4, "t2", "v", "validation"), (5, None, "w", "validation")]
    df = spark.createDataFrame(rows, "id int, a string, b string, split string")
    assert sorted(r["id"] for r in splits.drop_leaks(df, ["a", "b"]).collect()) == [1, 3, 5]
    assert splits.group_split({"a": 60, "b": 30, "c": 10}, {"x": 0.6, "y": 0.4}) == {"a": "x", "b": "y", "c": "y"}
    assert [r["id"] for r in splits.replace_rows(df.select("id", "a"), df.filter("id = 2").select("id", F.lit("new").alias("a")), "id").orderBy("id").collect()] == [1, 2, 3, 4, 5]


def test_windows(spark):
    rows = [(1, i, p) for i, p in enumerate([0.1, 0.2, 0.9, 0.1, 0.1, 0.1])]
    df = spark.createDataFrame(rows, "u int, pos int, p double")
    assert [r["run"] for r in windows.run_length(df, ["u"], F.col("p") < 0.5).orderBy("pos").collect()] == [2, 2, 0, 3, 3, 3]
    assert [round(r["m"], 4) for r in df.withColumn("m", windows.rolling_mean("p", ["u"])).orderBy("pos").collect()][:2] == [0.4, 0.325]


def test_unit_features(spark):
    record = {"unit_id": "u", "text": "a b", "audio_s": 2.0, "decode_s": 0.1, "segments": [{"start": 0.0, "end": 1.0, "text": "a", "avg_logprob": -0.2, "n_tokens": 3, "no_speech_prob": 0.1, "compression_ratio": 1.0, "temperature": 0.0}, {"start": 1.0, "end": 2.0, "text": "b", "avg_logprob": -1.0, "n_tokens": 0, "no_speech_prob": 0.3, "compression_ratio": 2.0, "temperature": 0.2}], "words": [{"start": 0.0, "end": 0.5, "word": "a", "probability": 0.9}, {"start": 1.2, "end": 1.5, "word": "b", "probability": 0.3}]}
    empty = {"unit_id": "e", "text": " ", "audio_s": None, "decode_s": None, "segments": None, "words": None}
    found = {r["unit_id"]: r for r in features.unit_features(spark.createDataFrame([record, empty], records.RECORD)).collect()}
    u = found["u"]
    assert u["mean_logprob"] == pytest.approx(-0.4) and u["word_p_q10"] == pytest.approx(0.36) and u["word_frac_low"] == 0.5 and u["fallback"] == 1.0 and u["words_per_s"] == 1.0
    assert found["e"]["empty_hyp"] == 1.0 and found["e"]["word_frac_low"] == 1.0 and found["e"]["log_duration"] == pytest.approx(math.log(0.05))
    segments = live.words_of_segments(spark.createDataFrame([record], records.RECORD)).orderBy("segment").collect()
    assert [r["words"] for r in segments] == [["a"], ["b"]]


def test_sources(spark, tmp_path):
    lines = [json.dumps({"unit_id": "a", "text": "old"}), json.dumps({"unit_id": "a", "text": "new"}), json.dumps({"unit_id": "b", "text": "x"}), '{"unit_id": "c", "te']
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    assert {r["unit_id"]: r["text"] for r in records.read_records(spark, str(tmp_path / "r.jsonl")).collect()} == {"a": "new", "b": "x"}
    grid = 'intervals [1]:\n xmin = 0\n xmax = 1.5\n text = "say ""hi"" "\nintervals [2]:\n xmin = 1.5\n xmax = 2\n text = ""\n'
    (tmp_path / "g").mkdir()
    (tmp_path / "g/day1_doctor.TextGrid").write_text(grid)
    (tmp_path / "g/notes.txt").write_text(grid)
    assert [tuple(r) for r in records.read_utterances(spark, str(tmp_path / "g")).collect()] == [("day1", "doctor", 0, 0.0, 1.5, 'say "hi"')]
    table = spark.createDataFrame([(1, 0.123456789)], "n int, x double")
    records.write_csv(table, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["x"] == "0.12346"
    records.write_csv(table.filter("false"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    assert records.markdown(table, ("x",)).split("\n")[-1] == "| 1 | 12.3% |"


def test_stream_log_is_replayed_and_resumed(spark, tmp_path):
    schema = "unit_id string, start double, end double"
    feed = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    feed(1, [("b", 5.0, 9.0), ("a", 0.0, 4.0)])

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = live.live_turns(stream, "turns", str(tmp_path / "log"), str(tmp_path / "cp"))
        query.processAllAvailable()
        query.stop()

    run()
    feed(2, [("c", 9.0, 12.0)])
    run()
    events = live.replay(spark, str(tmp_path / "log"))
    assert [(r["event"], r["at"]) for r in events.collect()] == [("turn", 0.0), ("turn", 5.0), ("progress", 9.0), ("turn", 9.0), ("progress", 12.0)]
    assert [r["decoded_until"] for r in live.progress(events).orderBy("batch").collect()] == [9.0, 12.0]
