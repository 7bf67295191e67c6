"""Policies tuned, stored, read back and applied."""

import math
import random

import pytest
from pyspark.sql import functions as F

from triagelake.operators import stored, thresholds


def test_round_trip_decides_alike(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "a" if i % 3 else "b", rng.choice([0.1, 0.2, 0.3, 0.7, 1 / 3]), int(rng.random() < 0.3)) for i in range(300)] + [(900, "a", None, 1), (901, None, 0.3, 0)]
    u = spark.createDataFrame(rows, "unit_id long, ev string, r double, y int")
    linear = stored.Policy("P3", "Linear “score”", True, "a", features={"r": (0.5, 0.3, 1.1)}, intercept=-0.4)
    known = [stored.tuned(linear, u, (0.1,), (0.3, 0.0)), stored.tuned(stored.Policy("P1", "Raw", False, "a", raw="r"), u, (0.1,), (0.3,)), stored.tuned(stored.Policy("P9", "No units", True, "zz", raw="r"), u, (0.1,), (0.3,))]
    assert list(known[1].thresholds) == ["budget_0.10"] and list(known[2].thresholds) == []
    path = str(tmp_path / "policies")
    stored.export(spark, known, path)
    again = stored.load(spark, path)
    assert [p.name for p in again] == ["P1", "P3", "P9"] and again[1].label == "Linear “score”"
    assert dict(again[1].thresholds) == known[0].thresholds
    cut = thresholds.risk_target(u.filter("ev = 'a' AND r IS NOT NULL").withColumn("r", linear.risk()), ["ev"], (0.3,)).first()["threshold"]
    above = {r["unit_id"] for r in u.filter(linear.risk() > cut).collect()}
    got = stored.decided(u.withColumn("__x", F.lit(1)), again)
    assert {r["unit_id"] for r in got.filter("policy = 'P3' AND point = 'risk_0.30' AND review").collect()} == above
    assert got.filter("unit_id = 900").count() == 0 and got.filter("unit_id = 901").count() == 4
    assert all(r["review"] for r in got.filter("point = 'risk_0.00'").collect()) or known[0].thresholds["risk_0.00"] > -1


def test_thresholds_that_nothing_meets_are_finite_json(spark, tmp_path):
    assert thresholds.as_inclusive(-math.inf) == -1.7976931348623157e308
    with pytest.raises(ValueError):
        stored.export(spark, [stored.Policy("P", "p", True, "a", raw="r", thresholds={"x": math.nan})], str(tmp_path / "bad"))
    stored.export(spark, [stored.Policy("P", "p", True, "a", raw="r")], str(tmp_path / "none"))
    assert stored.decided(spark.range(2), stored.load(spark, str(tmp_path / "none"))).collect() == []
