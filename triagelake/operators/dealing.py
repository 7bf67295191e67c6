"""Whole groups dealt to bins (splits, folds) of given shares: the largest first, each to the bin that has least for its share.

Dealing is sequential in sizes, not in groups: groups of one size are alike. So the driver sees how many groups there are of each size
(with n rows in all at most sqrt(2n) sizes, however many groups) and finds how many of them each bin takes. Which group that is
follows on the executors, from its place among the groups of its size.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.operators import scans
from triagelake.sources.records import written

#: Slots that one row is exploded to.
CHUNK = 100_000


def taken(levels: Sequence[int], steps: Sequence[int], count: int) -> list[int]:
    """How many of `count` equal groups each bin takes: bin b stands at levels[b] and rises by steps[b] a group, the lowest is next, the first of equals."""
    if not any(steps):
        return [count if b == levels.index(min(levels)) else 0 for b in range(len(levels))]

    def upto(level: int) -> list[int]:
        """Groups that find their bin at `level` or below."""
        return [(level - at) // step + 1 if level >= at else 0 for at, step in zip(levels, steps, strict=True)]

    low, high = min(levels), min(at + (count - 1) * step for at, step in zip(levels, steps, strict=True))
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if sum(upto(mid)) >= count else (mid + 1, high)
    full, out = upto(low), upto(low - 1)
    for b in range(len(levels)):
        if out[b] < full[b] and sum(out) < count:
            out[b] += 1
    return out


def dealt(sizes: DataFrame, group: str, size: str, shares: Mapping[str, int]) -> DataFrame:
    """(group, bin) of rows (group, size), one a group: groups by falling size, then by name (null first), to the bin with least size for its share.

    Shares are whole numbers above 0; of bins at the same level the first takes the group. A null group is a group like others, a null
    size counts as 0. The result is exactly that of dealing group by group.
    """
    names, least = list(shares), math.lcm(*shares.values())
    times = [least // w for w in shares.values()]
    rows = sizes.select(F.col(group).alias("__group"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size"))
    placed = written(scans.running(rows, ["__size"], ["__group"], {"__place": F.lit(1)}))
    load, plan = [0] * len(names), []
    for r in placed.groupBy("__size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("__size")).collect():
        levels, steps = [a * t for a, t in zip(load, times, strict=True)], [r["__size"] * t for t in times]
        counts = taken(levels, steps, r["n"])
        plan.append((r["__size"], levels, steps, counts))
        load = [a + r["__size"] * c for a, c in zip(load, counts, strict=True)]
    table = sizes.sparkSession.createDataFrame(plan, "__size long, levels array<long>, steps array<long>, counts array<long>")
    # A slot for each group that a bin takes; its place is the number of slots of the same size at lower levels, or at this level in earlier bins.
    slots = table.select("*", F.posexplode("counts").alias("bin", "n")).filter("n > 0")
    slots = slots.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))).repartition("__size", "bin", "first")
    slots = slots.withColumn("j", F.explode(F.sequence("first", F.least(F.col("first") + CHUNK, F.col("n")) - 1)))
    slots = slots.withColumn("level", F.expr("levels[bin] + j * steps[bin]"))
    ahead = " + ".join(f"CASE WHEN bin = {b} OR level - int(bin <= {b}) < levels[{b}] THEN 0 ELSE (level - int(bin <= {b}) - levels[{b}]) div steps[{b}] + 1 END" for b in range(len(names)))
    slots = slots.select("__size", (F.when(F.col("__size") == 0, F.col("j")).otherwise(F.col("j") + F.expr(ahead)) + 1).alias("__place"), F.element_at(F.array(*map(F.lit, names)), F.col("bin") + 1).alias("bin"))
    return placed.join(slots, ["__size", "__place"]).select(F.col("__group").alias(group), "bin")


def with_bins(df: DataFrame, group: str, shares: Mapping[str, int], column: str) -> DataFrame:
    """Adds the bin of each row's group, by numbers of rows; the groups meet their rows in a join that Spark may broadcast or split where a group is hot."""
    bins = dealt(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group, "n", shares)
    bins = written(bins.select(F.col(group).alias("__g"), F.col("bin").alias(column)))
    return df.join(bins, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
