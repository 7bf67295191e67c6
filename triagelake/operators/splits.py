"""Splits, leakage and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A leaked key stays with the first of these that has it.
PRIORITY = ("test", "calibration", "validation")


def group_split(sizes: Mapping[str, int], shares: Mapping[str, float]) -> dict[str, str]:
    """Whole groups, largest first, to the split that lacks most of its share."""
    total, have, out = sum(sizes.values()), dict.fromkeys(shares, 0), {}
    for group, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        split = max(shares, key=lambda s: (shares[s] * total - have[s]) / max(shares[s] * total, 1e-9))
        out[group], have[split] = split, have[split] + n
    return out


def drop_leaks(df: DataFrame, keys: Sequence[str], split: str = "split", priority: Sequence[str] = PRIORITY) -> DataFrame:
    """For each key in turn, keeps rows in the split of highest priority only; later keys don't see rows that are gone."""
    rank = F.coalesce(*(F.when(F.col(split) == s, F.lit(i)) for i, s in enumerate(priority)), F.lit(len(priority)))
    for key in keys:
        best = F.min("__rank").over(Window.partitionBy(key))
        df = df.withColumn("__rank", rank).withColumn("__best", best).filter(F.col(key).isNull() | (F.col("__rank") == F.col("__best"))).drop("__rank", "__best")
    return df


def leaks(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in several splits; empty when nothing leaks."""
    return df.groupBy(key).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def keep_last(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    line = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("__n", F.row_number().over(line)).filter("__n = 1").drop("__n")


def replace_rows(main: DataFrame, better: DataFrame, key: str) -> DataFrame:
    """Rows of `better` in place of those of `main` with the same key."""
    return main.join(better.select(key), key, "left_anti").unionByName(better, allowMissingColumns=True)


def stratified_pick(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n keys of each stratum by a seeded hash."""
    line = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.select(stratum, key).distinct().withColumn("__n", F.row_number().over(line)).filter(F.col("__n") <= n).drop("__n")
