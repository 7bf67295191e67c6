"""Thresholds that decide which units a human reviews.

Rules look at distinct scores with their counts and run sums over ranges of them, however many units and scores a set has. Budgets review
scores of at least the threshold; the other rules review scores above it, and minus infinity reviews everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.operators import scans
from triagelake.sources.records import written

Keys = Sequence[str]


def budget(df: DataFrame, keys: Keys, budgets: Sequence[float], p: str = "r") -> DataFrame:
    """(keys, budget, threshold): the score of rank ceil((n - 1)(1 - budget)) from below, counting from 0."""
    scores = scans.running(df.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("__k")), keys, [p], {"upto": F.col("__k")})
    scores = scores.join(scores.groupBy(*keys).agg(F.sum("__k").alias("n")), list(keys))
    with_budget = scores.withColumn("budget", F.explode(F.array(*(F.lit(float(b)) for b in budgets))))
    rank = F.ceil((F.col("n") - 1).cast("double") * (F.lit(1.0) - F.col("budget")))
    return with_budget.filter(F.col("upto") > rank).groupBy(*keys, "budget").agg(F.min(p).alias("threshold"))


def _cuts(df: DataFrame, keys: Keys, p: str, y: Column | str) -> DataFrame:
    """Accepting all scores up to each distinct one: n and wrong."""
    scores = df.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("__k"), F.sum(y).alias("__bad"))
    return scans.running(scores, keys, [p], {"n": F.col("__k"), "wrong": F.col("__bad")}).select(*keys, p, "n", "wrong")


def risk_target(df: DataFrame, keys: Keys, alphas: Sequence[float], n_min: int = 30, p: str = "r", y: Column | str = "y") -> DataFrame:
    """(keys, alpha, threshold): the largest cut at which the accepted are wrong at a rate of alpha at most; minus infinity if none."""
    cuts = _cuts(df, keys, p, y).withColumn("alpha", F.explode(F.array(*(F.lit(float(a)) for a in alphas))))
    ok = (F.col("n") >= n_min) & (F.col("wrong") / F.col("n") <= F.col("alpha") + 1e-12)
    return cuts.groupBy(*keys, "alpha").agg(F.coalesce(F.max(F.when(ok, F.col(p))), F.lit(-math.inf)).alias("threshold"))


def plugin(df: DataFrame, keys: Keys, alphas: Sequence[float], p: str = "r") -> DataFrame:
    """The risk target without labels: predicted risks stand for outcomes, and one unit is enough."""
    return risk_target(df, keys, alphas, 1, p, p)


def _stirling(n: np.ndarray) -> np.ndarray:
    """What Stirling's formula leaves of log n!."""
    small = np.minimum(n, 16.0)
    exact = np.array([math.lgamma(k + 1) for k in small]) - ((small + 0.5) * np.log(small) - small + 0.5 * math.log(2 * math.pi))
    return np.where(n > 16, (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n**2)) / n**2) / n**2) / n, exact)


def _beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(X > x) for X ~ Beta(a, b), a and b >= 1: the continued fraction of the incomplete beta function (Lentz), of about the square root of a + b terms."""
    out = np.where(x <= 0, 1.0, 0.0)
    inside = (x > 0) & (x < 1)
    if not inside.any():
        return out
    a, b, x = a[inside], b[inside], x[inside]
    n = a + b
    # x^a (1 - x)^b / B(a, b) by deviances, so that no large logarithms cancel.
    deviance = lambda k, mean: mean * ((k / mean) * np.log1p((k - mean) / mean) - (k - mean) / mean)
    front = np.exp(_stirling(n) - _stirling(a) - _stirling(b) - deviance(a, n * x) - deviance(b, n * (1 - x))) * np.sqrt(a * b / (2 * math.pi * n))
    upper = x >= (a + 1) / (n + 2)
    p, q, y = np.where(upper, b, a), np.where(upper, a, b), np.where(upper, 1 - x, x)
    tiny = 1e-300
    kept = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones(len(p)), 1 / kept(1 - n * y / (p + 1))
    found, m, moving = d.copy(), 0, True
    while moving:
        m += 1
        for term in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (n + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            c, d = kept(1 + term / c), 1 / kept(1 + term * d)
            found *= c * d
        moving = bool((np.abs(c * d - 1) > 1e-14).any())
    part = front * found / p
    out[inside] = np.where(upper, part, 1 - part)
    return out


def clopper_pearson_above(wrong: np.ndarray, n: np.ndarray, rate: float, level: float = 0.95) -> np.ndarray:
    """Whether the upper confidence bound of a rate is above `rate`: one look at the distribution there, without finding the bound."""
    wrong, n = np.asarray(wrong, float), np.asarray(n, float)
    out, some = np.full(len(n), rate < 1), wrong < n
    out[some] = _beta_tail(wrong[some] + 1, n[some] - wrong[some], np.full(int(some.sum()), rate)) > 1 - level
    return out


def clopper_pearson_upper(wrong: np.ndarray, n: np.ndarray, level: float = 0.95) -> np.ndarray:
    """Upper confidence bound of a rate: the level quantile of Beta(wrong + 1, n - wrong) by bisection; 1 when all are wrong."""
    wrong, n = np.asarray(wrong, float), np.asarray(n, float)
    low, high, some = np.zeros(len(n)), np.ones(len(n)), wrong < n
    for _ in range(60):
        mid = (low + high) / 2
        above = np.zeros(len(n), bool)
        above[some] = _beta_tail(wrong[some] + 1, n[some] - wrong[some], mid[some]) > 1 - level
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return np.where(some, high, 1.0)


def risk_clopper_pearson(df: DataFrame, keys: Keys, alphas: Sequence[float], n_min: int = 30, level: float = 0.95, p: str = "r", y: str = "y") -> DataFrame:
    """Fixed-sequence testing: cuts are tried in increasing order from n_min units and stop at the first whose upper bound exceeds alpha."""
    cuts = _cuts(df, keys, p, y).filter(F.col("n") >= n_min)

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for alpha in alphas:
                yield batch.assign(alpha=float(alpha), above=clopper_pearson_above(batch["wrong"].to_numpy(), batch["n"].to_numpy(), alpha, level))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cuts.schema) + ", alpha double, above boolean"
    tried = written(cuts.mapInPandas(tested, schema))
    stops = tried.groupBy(*keys, "alpha").agg(F.min(F.when(F.col("above"), F.col("n"))).alias("__stop"))
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in [*keys, "alpha"]]
    held = tried.join(stops.select(*(F.col(c).alias(f"__of_{c}") for c in [*keys, "alpha"]), "__stop"), same).filter(F.col("__stop").isNull() | (F.col("n") < F.col("__stop")))
    passed = held.groupBy(*keys, "alpha").agg(F.max(p).alias("threshold"))
    every = df.select(*keys).distinct().withColumn("alpha", F.explode(F.array(*(F.lit(float(a)) for a in alphas))))
    return every.join(passed, [*keys, "alpha"], "left").select(*keys, "alpha", F.coalesce("threshold", F.lit(-math.inf)).alias("threshold"))


def decide(p: Column, threshold: Column, inclusive: Column | bool) -> Column:
    """Whether a unit is reviewed; inclusive rules (budgets) review scores that equal the threshold."""
    inclusive = F.lit(inclusive) if isinstance(inclusive, bool) else inclusive
    return F.when(inclusive, p >= threshold).otherwise(p > threshold)


def as_inclusive(threshold: float) -> float:
    """The threshold of a `>=` rule that decides as `> threshold` does."""
    return math.nextafter(threshold, math.inf)
