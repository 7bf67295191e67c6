"""Cluster bootstrap as relational algebra: a drawn group's rows count as often as the group was drawn.

Statistics are first summed by group, so the cost is replicates times groups, whatever the number of units is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.operators import scans
from triagelake.sources.records import written

Keys = Sequence[str]


def draws(spark: SparkSession, groups: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """(rep, group_id, mult): groups drawn with replacement, coded in sorted order. For groups that are few enough to be listed; `resampled` is for any number."""
    groups, rng = sorted(groups), np.random.default_rng(seed)
    rows = []
    for rep in range(replicates):
        for g, m in enumerate(np.bincount(rng.integers(0, len(groups), len(groups)), minlength=len(groups))):
            if m:
                rows.append((rep, groups[g], int(m)))
    return spark.createDataFrame(rows, "rep int, group_id string, mult int")


def resampled(df: DataFrame, keys: Keys, sums: Mapping[str, Column], replicates: int, seed: int, *, group: str = "group_id", by: Keys = ()) -> DataFrame:
    """(keys, rep, by, sums...): sums over each replicate's units, which are those of as many groups as the key has, drawn with replacement.

    Group number i of a key's G makes draw number i of every replicate: the group that MD5(seed-keys-rep-i) picks of G. So draws are multinomial, add up to G,
    are made where the groups are, and any engine can repeat them. They meet the sums by group in a shuffle join: the cost is replicates times groups.
    A null group is one like the empty one.
    """
    keys, by = list(keys), list(by)
    unit = df.withColumn("__group", F.coalesce(F.col(group).cast("string"), F.lit("")))
    found = written(unit.groupBy(*keys, "__group", *by).agg(*(F.sum(c).alias(n) for n, c in sums.items())))
    numbered = scans.running(found.select(*keys, "__group").distinct(), keys, ["__group"], {"__g": F.lit(1)})
    numbered = written(numbered.select(*keys, "__group", (F.col("__g") - 1).cast("long").alias("__g")))
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    rows = numbered.join(sizes, keys) if keys else numbered.crossJoin(sizes)  # without keys, sizes is one row
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    pick = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), *keys, "rep", "__g")), 1, 12), 16, 10).cast("long") % F.col("__n")
    picked = rows.select(*keys, "rep", pick.alias("__g"))
    own = found.join(numbered, [*keys, "__group"]).drop("__group")
    return picked.join(own, [*keys, "__g"]).groupBy(*keys, "rep", *by).agg(*(F.sum(n).alias(n) for n in sums))


def resampled_ratios(df: DataFrame, keys: Keys, stats: Mapping[str, tuple[Column, Column]], replicates: int, seed: int, group: str = "group_id") -> DataFrame:
    """(keys, rep, stats...): the ratio of each (numerator, denominator) in every replicate."""
    sums = {f"{name}_{i}": c for name, both in stats.items() for i, c in enumerate(both)}
    drawn = resampled(df, keys, sums, replicates, seed, group=group)
    return drawn.select(*keys, "rep", *(F.try_divide(F.col(f"{n}_0").cast("double"), F.col(f"{n}_1").cast("double")).alias(n) for n in stats))


def replicate_ratios(df: DataFrame, keys: Keys, table: DataFrame, stats: Mapping[str, tuple[Column, Column]], group: str = "group_id") -> DataFrame:
    """(keys, rep, stats...) with given draws (rep, group_id, mult): the ratio of weighted sums of each (numerator, denominator)."""
    sums = df.groupBy(*keys, F.col(group).alias("group_id")).agg(*(F.sum(c).alias(f"{name}_{i}") for name, both in stats.items() for i, c in enumerate(both)))
    joined = sums.join(table, "group_id")
    w = lambda c: F.sum(F.col(c) * F.col("mult")).cast("double")
    return joined.groupBy(*keys, "rep").agg(*(F.try_divide(w(f"{name}_0"), w(f"{name}_1")).alias(name) for name in stats))


def percentile_interval(reps: DataFrame, keys: Keys, names: Sequence[str], level: float = 0.95) -> DataFrame:
    """(keys, name_lo, name_hi) by linear interpolation over finite replicates."""
    q = (1 - level) / 2
    finite = lambda n: F.when(~F.isnan(n) & (F.abs(n) < float("inf")), F.col(n))
    return reps.groupBy(*keys).agg(*(F.percentile(finite(n), F.lit(p)).alias(f"{n}_{end}") for n in names for end, p in (("lo", q), ("hi", 1 - q))))


def interval(df: DataFrame, keys: Keys, reps: DataFrame, stats: Mapping[str, tuple[Column, Column]], level: float = 0.95) -> DataFrame:
    """Point estimates and intervals of ratio statistics."""
    point = df.groupBy(*keys).agg(*(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")).alias(n) for n, (a, b) in stats.items()))
    return point.join(percentile_interval(reps, keys, list(stats), level), list(keys))


def paired(a: DataFrame, b: DataFrame, keys: Keys, name: str) -> DataFrame:
    """Differences a - b of a statistic on the same draws: interval and share of replicates at or above 0. Two draw tables with their own seeds make it unpaired."""
    diff = a.select(*keys, "rep", F.col(name).alias("x")).join(b.select(*keys, "rep", F.col(name).alias("z")), [*keys, "rep"]).withColumn("diff", F.col("x") - F.col("z"))
    return percentile_interval(diff, keys, ["diff"]).join(diff.groupBy(*keys).agg(F.avg((F.col("diff") >= 0).cast("double")).alias("share_up"), one_sided_p(F.col("diff") <= 0).alias("p_value")), list(keys))


def one_sided_p(wrong: Column) -> Column:
    """(wrong + 1) / (n + 1) over replicates."""
    return (F.sum(F.when(wrong, 1).otherwise(0)) + 1).cast("double") / (F.count(wrong) + 1)


def holm(df: DataFrame, keys: Keys, p: str, order: str) -> DataFrame:
    """Holm's step-down adjustment within keys; an undefined p counts as 1 and stays undefined."""
    q = F.coalesce(F.when(~F.isnan(p), F.col(p)), F.lit(1.0))
    line, whole = Window.partitionBy(*keys).orderBy("__q", order), Window.partitionBy(*keys)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(whole) - F.row_number().over(line) + 1) * F.col("__q"))
    out = df.withColumn("__q", q).withColumn("__s", step)
    top = F.max("__s").over(line.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("p_holm", F.when(F.col(p).isNotNull() & ~F.isnan(p), top)).drop("__q", "__s")


def plugin_error(scores: DataFrame, keys: Keys, alpha: float, p: str) -> DataFrame:
    """(keys, error): the rate of y among what the plug-in rule accepts, of rows (keys, p, n, y) a score: scores up to the highest at which
    their mean is alpha at most. Null where none is accepted."""
    upto = scans.running(scores, keys, [p], {"__n": F.col("n"), "__y": F.col("y"), "__p": F.col(p) * F.col("n")})
    ok = F.col("__p") / F.col("__n") <= alpha + 1e-12
    return upto.groupBy(*keys).agg(F.max(F.when(ok, F.struct("__n", "__y"))).alias("at")).select(*keys, (F.col("at.__y") / F.col("at.__n")).alias("error"))


def tested(reps: DataFrame, keys: Keys, value: str, direction: str, undefined: float = 0.05) -> DataFrame:
    """Of rows (keys, rep, value), rep -1 being the sample itself: estimate, ci_lo, ci_hi, n_boot, testable, p. `direction` is a column saying less or greater.

    A statistic that is undefined in the sample or in more than `undefined` of the replicates isn't tested.
    """
    finite, drawn = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value)), F.col("rep") >= 0
    wrong = F.when(F.col(direction) == "less", finite >= 0).otherwise(finite <= 0)
    ends = (F.percentile(F.when(drawn, finite), F.lit(q)).alias(n) for q, n in ((0.025, "ci_lo"), (0.975, "ci_hi")))
    out = reps.groupBy(*keys).agg(
        F.max(F.when(~drawn, finite)).alias("estimate"), *ends, F.count(F.when(drawn, finite)).alias("n_boot"), F.count(F.when(drawn, 1)).alias("__all"), ((F.count(F.when(drawn & wrong, 1)) + 1) / (F.count(F.when(drawn, finite)) + 1)).alias("p"),
    )
    out = out.withColumn("testable", (F.col("n_boot") >= (1 - undefined) * F.col("__all")) & F.col("estimate").isNotNull())
    return out.withColumn("p", F.when(F.col("testable"), F.col("p"))).drop("__all")
