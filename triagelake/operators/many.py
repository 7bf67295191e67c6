"""Many small logistic models fitted at once: a Newton step of all of them is one grouped aggregate."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.operators.policies import logit, sigmoid
from triagelake.sources.records import written

#: The largest step of a coefficient, and the bound of an intercept that is fitted alone.
STEP, BOUND = 4.0, 10.0


def fit(rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, *, l2: float, offset: str | None = None, steps: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(keys, features..., intercept, n, rate): a logistic model for each key, with a penalty of l2 / 2 on each squared slope.

    Rows are added up by (keys, features) first. `offset` is a column that the score starts from; without features the intercept alone is fitted, within +-BOUND. Every step
    brings one row a model to the driver: its gradient and Hessian. Null keys, features and labels take no part; a key with one class
    ends with a large intercept, as far as the steps go.
    """
    keys, features = list(keys), list(features)
    x = [F.col(c).cast("double") for c in features]
    start = F.col(offset).cast("double") if offset else F.lit(0.0)
    flat = rows.select(*keys, *(c.alias(f"__x{i}") for i, c in enumerate(x)), start.alias("__o"), F.col(label).cast("double").alias("__y")).dropna()
    flat = written(flat.groupBy(*keys, *(f"__x{i}" for i in range(len(x))), "__o").agg(F.count(F.lit(1)).alias("__n"), F.sum("__y").alias("__k")))
    spark, d = rows.sparkSession, len(features) + 1
    totals = flat.groupBy(*keys).agg(F.sum("__n").alias("__n"), F.sum("__k").alias("__k")).collect()
    names = [tuple(r[k] for k in keys) for r in totals]
    weights, live = {name: np.zeros(d) for name in names}, set(names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema if f.name in keys)
    terms = [F.col(f"__x{i}") for i in range(d - 1)] + [F.lit(1.0)]
    for _ in range(steps):
        if not live:
            break
        current = spark.createDataFrame([(*name, *map(float, weights[name])) for name in live], f"{kinds}, " + ", ".join(f"__w{i} double" for i in range(d)))
        z = sum((F.col(f"__w{i}") * t for i, t in enumerate(terms)), F.col("__o"))
        q = flat.join(current, keys).withColumn("__q", sigmoid(z))
        miss, curve = F.col("__k") - F.col("__n") * F.col("__q"), F.col("__n") * F.col("__q") * (1 - F.col("__q"))
        sums = q.groupBy(*keys).agg(*(F.sum(miss * t).alias(f"__g{i}") for i, t in enumerate(terms)), *(F.sum(curve * terms[i] * terms[j]).alias(f"__h{i}_{j}") for i in range(d) for j in range(i, d)))
        for r in sums.collect():
            name = tuple(r[k] for k in keys)
            own = weights[name]
            ridge = np.array([l2] * (d - 1) + [0.0])
            g = np.array([r[f"__g{i}"] for i in range(d)]) - ridge * own
            h = np.array([[r[f"__h{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) + np.diag(ridge + 1e-9)
            step = np.clip(np.linalg.solve(h, g), -STEP, STEP)
            weights[name] = own + step
            if d == 1:
                weights[name] = np.clip(weights[name], -BOUND, BOUND)
            if np.abs(step).max() < tolerance or np.array_equal(weights[name], own):
                live.discard(name)
    rows_out = [(*name, *map(float, weights[name]), int(r["__n"]), float(r["__k"] / r["__n"])) for name, r in zip(names, totals, strict=True)]
    return spark.createDataFrame(rows_out, f"{kinds}, " + ", ".join(f"`{c}` double" for c in [*features, "intercept"]) + ", n long, rate double")


def platt(rows: DataFrame, keys: Sequence[str], p: str, y: str) -> DataFrame:
    """(keys, slope, shift, fell_back, only_shift): Platt's scaling of a score for each key. A slope of 0 or less, or a single class, falls back to
    shifting the logit alone; only_shift is that shift in any case."""
    scored = rows.withColumn("__z", logit(F.col(p)))
    free = fit(scored, keys, ["__z"], y, l2=1e-4).withColumnsRenamed({"__z": "slope", "intercept": "shift"})
    alone = fit(scored, keys, [], y, l2=0.0, offset="__z").select(*keys, F.col("intercept").alias("only_shift"))
    both = free.join(alone, list(keys))
    falls = (F.col("slope") <= 0) | (F.col("rate") <= 0) | (F.col("rate") >= 1)
    return both.select(*keys, F.when(falls, 1.0).otherwise(F.col("slope")).alias("slope"), F.when(falls, F.col("only_shift")).otherwise(F.col("shift")).alias("shift"), falls.alias("fell_back"), "only_shift", "n")


def redraws(groups: DataFrame, group: str, ks: Sequence[int], draws: int, seed: int) -> DataFrame:
    """(k, draw, group, inside): every group in each redraw, k of them inside: those of the k least hashes of (seed, k, draw, group).

    The k-th least hash of a redraw is found by keeping the k smallest of each task, not by sorting all. Redraws of all groups, which leave none outside, have no rows.
    """
    hashed = groups.select(group).distinct().withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    hashed = written(hashed.withColumn("__h", F.xxhash64(F.lit(seed), "k", "draw", F.col(group).cast("string"))))
    sizes = groups.select(group).distinct().count()
    ranked = hashed.withColumn("__r", F.struct("__h", group))
    least = ranked.withColumn("__n", F.row_number().over(Window.partitionBy("k", "draw").orderBy("__h", group))).filter(F.col("__n") <= max(ks)).filter(F.col("__n") == F.col("k")).select("k", "draw", F.col("__r").alias("__last"))
    return ranked.filter(F.col("k") < F.lit(sizes)).join(least, ["k", "draw"]).select("k", "draw", group, (F.col("__r") <= F.col("__last")).alias("inside"))
