"""Exact quantiles of any number of rows with bounded memory: selection by repeated bucket counts.

A quantile lies between two order statistics. For each one that is wanted the rows of its key within an interval are counted in `BUCKETS` equal
buckets, with the least and the largest value of each; the bucket with the wanted rank is the next interval, until it holds a single value. A round is
one aggregate over the rows; what is kept is an interval for each key and rank. Buckets are equal in the logarithm of the magnitude and in the number itself by
turns, so that neither a wide range nor a narrow one takes many rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.sources.records import written

#: Buckets of a round; intervals that are broadcast at most, by their count.
BUCKETS, FEW = 1024, 100_000


def _scaled(c: str) -> Column:
    """A measure that grows with a number and with its magnitude's logarithm, infinities and then NaN last."""
    size = F.least(F.ln(F.abs(c)) + 750, F.lit(1500.0))
    return F.when(F.isnan(c), F.lit(1600.0)).when(F.col(c) == 0, F.lit(0.0)).otherwise(F.signum(c) * size)


def exact(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """(keys, names...): the quantiles of a column by linear interpolation, as F.percentile gives them. Nulls don't count; a key with nothing else
    has null quantiles, and NaN is above all numbers. Null keys are a key."""
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"))
    ends = written(rows.groupBy(*keys).agg(F.count("__v").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("n") - 1)).alias("place")) for name, q in at.items()))
    wanted = ends.filter("n > 0").withColumn("w", F.explode(wanted)).select(*keys, "lo", "hi", F.col("w.name").alias("name"), F.col("w.place").alias("place"))
    ranks = F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place"))))
    state = written(wanted.select(*keys, "lo", "hi", ranks.alias("rank")).distinct().withColumn("left", F.col("rank")))
    done: list[DataFrame] = []
    while True:
        over = F.col("lo").eqNullSafe(F.col("hi"))
        done.append(state.filter(over).select(*keys, "rank", F.col("lo").alias("found")))
        state = state.filter(~over)
        n = state.count()
        if not n:
            break
        asked = state.select(*(F.col(k).alias(f"__k_{k}") for k in keys), "lo", "hi", "rank", "left")
        same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
        inside = (F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi"))
        asked = F.broadcast(asked) if n <= FEW else asked
        near = rows.join(asked, [*same, inside])
        scaled = _scaled if len(done) % 2 else lambda c: F.col(c) / 2  # halves, as a difference may exceed what a double holds
        step = (scaled("__v") - scaled("lo")) / (scaled("hi") - scaled("lo"))
        bucket = F.when(F.isnan("__v") | F.isnan(step), F.lit(BUCKETS)).otherwise(F.least(F.floor(step * BUCKETS), F.lit(BUCKETS - 1)))
        counted = near.groupBy(*keys, "rank", "left", bucket.cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        upto = Window.partitionBy(*keys, "rank").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        placed = counted.withColumn("upto", F.sum("c").over(upto)).filter((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("c") <= F.col("left")))
        state = written(placed.select(*keys, "lo", "hi", "rank", (F.col("left") - F.col("upto") + F.col("c")).alias("left")))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    found = written(found)
    pick = lambda name: found.select(*(F.col(k).alias(f"__{name}_{k}") for k in keys), F.col("rank").alias(f"__{name}"), F.col("found").alias(name))
    low, high = pick("below"), pick("above")
    match = lambda name, rank: [*(F.col(k).eqNullSafe(F.col(f"__{name}_{k}")) for k in keys), F.col(f"__{name}") == rank]
    both = wanted.join(low, match("below", F.floor("place"))).join(high, match("above", F.ceil("place")))
    between = F.when(F.col("below") == F.col("above"), F.col("below")).otherwise((F.ceil("place") - F.col("place")) * F.col("below") + (F.col("place") - F.floor("place")) * F.col("above"))
    wide = both.withColumn("q", between).groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in at))
    if not keys:
        return wide
    out = ends.select(*(F.col(k).alias(f"__e_{k}") for k in keys)).join(wide, [F.col(k).eqNullSafe(F.col(f"__e_{k}")) for k in keys], "left")
    return out.select(*(F.col(f"__e_{k}").alias(k) for k in keys), *at)
