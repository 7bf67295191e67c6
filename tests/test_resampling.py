"""Resampling of groups against numpy, and the rule for statistics that are often undefined."""

import random

import numpy as np
from pyspark.sql import functions as F

from triagelake.operators import bootstrap


def test_draws_are_of_as_many_groups_as_there_are(spark):
    rows = [(k, f"g{i}" if i else None) for k, n in (("a", 7), ("b", 1), ("c", 40)) for i in range(n) for _ in range(1 + i % 3)]
    df = spark.createDataFrame(rows, "k string, group_id string")
    one = bootstrap.resampled(df.distinct(), ["k"], {"n": F.lit(1)}, 300, 5).collect()
    assert {(r["k"], r["n"]) for r in one} == {("a", 7), ("b", 1), ("c", 40)} and len(one) == 900
    each = bootstrap.resampled(df.distinct().withColumn("g", F.coalesce("group_id", F.lit(""))), ["k"], {"n": F.lit(1)}, 300, 5, by=["g"]).filter("k = 'c'").groupBy("g").agg(F.sum("n").alias("n")).collect()
    counts = np.array([r["n"] for r in each])
    assert counts.sum() == 12_000 and abs(counts - 300).max() < 6 * 300**0.5
    again = bootstrap.resampled(df.distinct(), ["k"], {"n": F.hash("group_id").cast("long")}, 300, 5).collect()
    other = bootstrap.resampled(df.distinct(), ["k"], {"n": F.hash("group_id").cast("long")}, 300, 6).collect()
    key = lambda rows: {(r["k"], r["rep"]): r["n"] for r in rows}
    assert key(again) == key(bootstrap.resampled(df.distinct(), ["k"], {"n": F.hash("group_id").cast("long")}, 300, 5).collect()) != key(other)


def test_interval_near_numpy(spark):
    rng = np.random.default_rng(0)
    sizes, means = rng.integers(1, 20, 60), rng.random(60)
    rows = [(f"g{g}", float(means[g] + rng.normal() / 5)) for g in range(60) for _ in range(sizes[g])]
    df = spark.createDataFrame(rows, "group_id string, x double").withColumn("k", F.lit(1))
    reps = bootstrap.resampled_ratios(df, ["k"], {"m": (F.col("x"), F.lit(1))}, 1500, 2)
    got = bootstrap.percentile_interval(reps, ["k"], ["m"]).first()
    of = [[x for g, x in rows if g == f"g{i}"] for i in range(60)]
    want = np.quantile([np.mean(np.concatenate([of[i] for i in rng.integers(0, 60, 60)])) for _ in range(1500)], [0.025, 0.975])
    width = want[1] - want[0]
    assert abs(got["m_lo"] - want[0]) < 0.1 * width and abs(got["m_hi"] - want[1]) < 0.1 * width


def test_often_undefined_is_not_tested(spark):
    rng = random.Random(1)
    rows = [(h, r, None if r >= 0 and rng.random() < undefined else rng.gauss(1 if h == "up" else -1, 0.1)) for h, undefined in (("up", 0.02), ("down", 0.3)) for r in range(-1, 400)]
    df = spark.createDataFrame(rows, "h string, rep int, v double").withColumn("side", F.lit("greater"))
    found = {r["h"]: r for r in bootstrap.tested(df, ["h", "side"], "v", "side").collect()}
    assert found["up"]["testable"] and found["up"]["p"] == 1 / (found["up"]["n_boot"] + 1) and found["up"]["ci_lo"] < found["up"]["estimate"] + 0.5
    assert not found["down"]["testable"] and found["down"]["p"] is None


def test_plugin_error(spark):
    rows = [(0, p / 10, n, y) for p, n, y in ((1, 4, 1), (2, 3, 2), (9, 2, 2))] + [(1, 0.5, 3, 1)]
    found = {r["rep"]: r["error"] for r in bootstrap.plugin_error(spark.createDataFrame(rows, "rep int, p double, n long, y long"), ["rep"], 0.2, "p").collect()}
    assert found == {0: 3 / 7, 1: None}
