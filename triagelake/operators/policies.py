"""Risk policies: raw confidence, rules, logistic scores with grouped folds and Platt scaling."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.operators import dealing, scans

EPS = 1e-6
#: Inverse strengths that the grouped cross-validation tries.
GRID = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0)


def raw_risk(conf: Column) -> Column:
    return F.lit(1.0) - conf


def rules_risk(nsp: Column, cr: Column, rep3: Column, conf: Column) -> Column:
    """At least 1 when speech is doubtful, compression is over 2.4 or a fifth of the trigrams repeat; confidence breaks ties."""
    return F.greatest(nsp / 0.6, F.when(cr > 2.4, cr / 2.4).otherwise(0.0), rep3 / 0.2) + F.lit(1e-3) * (F.lit(1.0) - conf)


def rules_risk_raw(nsp: Column, cr: Column) -> Column:
    return F.greatest(nsp / 0.6, cr / 2.4)


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def platt(p: Column, a: float, b: float) -> Column:
    return sigmoid(F.lit(float(a)) * logit(p) + F.lit(float(b)))


def linear_score(features: Mapping[str, tuple[float, float, float]], intercept: float) -> Column:
    """Probability by exported coefficients: feature to (mean, scale, coefficient)."""
    z = F.lit(float(intercept))
    for name, (mean, scale, weight) in features.items():
        z = z + F.lit(float(weight)) * (F.col(name) - F.lit(float(mean))) / F.lit(float(scale or 1.0))
    return sigmoid(z)


def balanced_folds(sizes: Mapping[str, int], folds: int) -> dict[str, int]:
    """Groups by falling size to the lightest fold, for groups that are few enough to be listed."""
    load, out = [0] * folds, {}
    for group, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fold = min(range(folds), key=lambda k: (load[k], k))
        out[group], load[fold] = fold, load[fold] + n
    return out


def with_folds(df: DataFrame, group: str = "group_id", folds: int = 5) -> DataFrame:
    """Adds fold: as balanced_folds, for any number of groups."""
    dealt = dealing.with_bins(df, group, {str(k): 1 for k in range(folds)}, "fold")
    return dealt.withColumn("fold", F.col("fold").cast("int"))


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, c: float) -> tuple[dict[str, tuple[float, float, float]], float]:
    """L2 logistic regression on features scaled by population deviations; a constant model where there is one class."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate"), *(f(x).alias(f"{k}_{x}") for x in features for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scale = {x: (float(stats[f"m_{x}"] or 0.0), float(stats[f"s_{x}"] or 0.0) or 1.0) for x in features}
    rate = float(stats["rate"] or 0.0)
    if rate in (0.0, 1.0):
        return {x: (*scale[x], 0.0) for x in features}, math.copysign(20.0, rate - 0.5)
    scaled = df.select(F.col(label).cast("double").alias("label"), *(((F.col(x) - m) / s).alias(x) for x, (m, s) in scale.items()))
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(scaled)
    model = LogisticRegression(regParam=1.0 / (c * stats["n"]), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8).fit(rows)
    return {x: (*scale[x], float(w)) for x, w in zip(features, model.coefficients, strict=True)}, float(model.intercept)


def log_loss(df: DataFrame, p: Column, label: str) -> float:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return float(df.agg(F.avg(-(F.col(label) * F.ln(q) + (1 - F.col(label)) * F.ln(1 - q)))).first()[0] or 0.0)


def fit_cross_validated(df: DataFrame, features: Sequence[str], label: str, group: str = "group_id", folds: int = 5, grid: Sequence[float] = GRID) -> tuple[dict[str, tuple[float, float, float]], float, float]:
    """The strength with the least grouped log loss (the first of equals), and the model of all rows with it: (features, intercept, c)."""
    split = with_folds(df, group, folds).cache()
    best, chosen = math.inf, grid[0]
    for c in grid:
        loss = 0.0
        for k in range(folds):
            held = split.filter(F.col("fold") == k)
            if not held.isEmpty():
                loss += log_loss(held, linear_score(*fit_logistic(split.filter(F.col("fold") != k), features, label, c)), label)
        if loss < best - 1e-12:
            best, chosen = loss, c
    model = fit_logistic(split, features, label, chosen)
    split.unpersist()
    return (*model, chosen)


def cross_fit(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0, group: str = "group_id", folds: int = 5) -> DataFrame:
    """Adds p: the probability by a model fitted without the row's fold."""
    split, score = with_folds(df, group, folds), F.lit(None).cast("double")
    for k in range(folds):
        train = split.filter(F.col("fold") != k)
        score = F.when(F.col("fold") == k, linear_score(*fit_logistic(train, features, label, c))).otherwise(score)
    return split.withColumn("p", score)


def fit_platt(df: DataFrame, p: str = "r", y: str = "y", intercept_only: bool = False, steps: int = 50) -> tuple[float, float, bool]:
    """(a, b, fell_back) by Newton's method on aggregated gradients; a slope of 0 or less, or one class, falls back to the shift alone."""
    rows = df.select(logit(F.col(p)).alias("z"), F.col(y).cast("double").alias("y")).groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))

    def newton(free: bool) -> tuple[float, float]:
        a, b = (0.0 if free else 1.0), 0.0
        for _ in range(steps):
            q = sigmoid(F.lit(a) * F.col("z") + F.lit(b))
            g, w = F.col("k") - F.col("n") * q, F.col("n") * q * (1 - q)
            s = rows.agg(F.sum(g).alias("g"), F.sum(g * F.col("z")).alias("gz"), F.sum(w).alias("w"), F.sum(w * F.col("z")).alias("wz"), F.sum(w * F.col("z") ** 2).alias("wzz")).first()
            if s["w"] is None:
                break
            if free:
                step = np.linalg.solve([[s["wzz"] + 1e-4, s["wz"]], [s["wz"], s["w"] + 1e-9]], [s["gz"] - 1e-4 * a, s["g"]])
            else:
                step = np.array([0.0, s["g"] / max(s["w"], 1e-9)])
            step = np.clip(step, -4, 4)
            a, b = a + float(step[0]), min(10.0, max(-10.0, b + float(step[1])))
            if np.abs(step).max() < 1e-9:
                break
        return a, b

    one_class = df.agg(F.countDistinct(y)).first()[0] < 2
    if not intercept_only and not one_class:
        a, b = newton(True)
        if a > 0:
            return a, b, False
    return (*newton(False), not intercept_only)


def probability(model: LogisticRegression, df: DataFrame) -> DataFrame:
    """Adds p from a fitted Spark ML classifier."""
    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


def ks_statistic(df: DataFrame, keys: Sequence[str], side: str, p: str = "r") -> DataFrame:
    """(keys, ks, n0, n1): the largest distance of the two sides' distributions (side 0 and 1)."""
    k = list(keys)
    side_is = lambda s: F.sum(F.when(F.col(side) == s, 1).otherwise(0))
    counts = df.groupBy(*k, p).agg(side_is(0).alias("__a"), side_is(1).alias("__b"))
    totals = df.groupBy(*k).agg(side_is(0).alias("n0"), side_is(1).alias("n1"))
    steps = scans.running(counts, k, [p], {"a": F.col("__a"), "b": F.col("__b")})
    steps = steps.join(totals, k) if k else steps.crossJoin(totals)  # without keys, a single row
    distance = F.abs(F.try_divide(F.col("a").cast("double"), F.col("n0").cast("double")) - F.try_divide(F.col("b").cast("double"), F.col("n1").cast("double")))
    return steps.groupBy(*k, "n0", "n1").agg(F.max(distance).alias("ks"))


def ks_p_value(ks: float, n0: int, n1: int) -> float:
    """Asymptotic p-value of the two-sample statistic."""
    x = ks * math.sqrt(n0 * n1 / (n0 + n1))
    return 1.0 if x < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    k, n = k.cast("double"), n.cast("double")
    mid, half = (k + z * z / 2) / (n + z * z), F.lit(z) * F.sqrt(k * (n - k) / n + z * z / 4) / (n + z * z)
    return mid - half, mid + half
