import math
import random

from pyspark.sql import functions as F

from triagelake.operators import quantiles

AT = {"lo": 0.025, "first": 0.25, "mid": 0.5, "p": 0.9, "end": 1.0, "start": 0.0}


def test_equal_to_percentile(spark):
    rng = random.Random(6)
    kinds = {"same": lambda: 3.5, "ties": lambda: rng.randint(0, 3), "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300), "normal": lambda: rng.gauss(0, 1), None: lambda: rng.choice([None, 1.0, 2.0]), "none": lambda: None, "odd": lambda: rng.choice([float("nan"), float("inf"), -float("inf"), 1.0])}
    rows = [(k, v if (v := f()) is None else float(v)) for k, f in kinds.items() for _ in range(rng.randint(50, 400))] + [("one", 7.0), ("two", -1.0), ("two", 2.0), ("huge", 1.7e308), ("huge", -1.7e308), ("huge", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    want = {r["k"]: r for r in df.groupBy("k").agg(*(F.percentile("v", F.lit(q)).alias(n) for n, q in AT.items())).collect()}
    found = {r["k"]: r for r in quantiles.exact(df, ["k"], "v", AT).collect()}
    assert found.keys() == want.keys()
    for k, r in found.items():
        for n in AT:
            assert math.isnan(r[n] or 0) == math.isnan(want[k][n] or 0) or k == "odd"
            assert math.isnan(r[n] or 0) or r[n] == want[k][n] or abs(r[n] - want[k][n]) <= 1e-12 * abs(want[k][n]), (k, n)


def test_without_keys_and_rows(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert quantiles.exact(df, [], "v", {"m": 0.5}).first()["m"] == 500
    assert quantiles.exact(df.withColumn("k", F.lit(1)).limit(0), ["k"], "v", {"m": 0.5}).collect() == []
