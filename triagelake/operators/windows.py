"""Positional features of sequences by window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.operators import scans

Keys = Sequence[str]


def rolling_mean(value: str, keys: Keys, pos: str = "pos", half: int = 2) -> Column:
    """Centred mean over 2 * half + 1 rows, fewer at the ends."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(pos).rowsBetween(-half, half))


def run_length(df: DataFrame, keys: Keys, flag: Column, pos: str = "pos") -> DataFrame:
    """Adds run: how long the run of flagged rows is that a row belongs to; 0 where it is not flagged."""
    line = Window.partitionBy(*keys).orderBy(pos)
    marked = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__i", F.row_number().over(line) - F.row_number().over(Window.partitionBy(*keys, "__f").orderBy(pos)))
    return marked.withColumn("run", F.when(F.col("__f"), F.count(F.lit(1)).over(Window.partitionBy(*keys, "__f", "__i"))).otherwise(0)).drop("__f", "__i")


def runs_of(df: DataFrame, keys: Keys, status: str, wanted: Sequence[str], least: int = 4, pos: str = "pos") -> DataFrame:
    """(keys, status, n_runs, n_words): runs of at least `least` equal statuses."""
    line = Window.partitionBy(*keys).orderBy(pos)
    islands = df.withColumn("__i", F.row_number().over(line) - F.row_number().over(Window.partitionBy(*keys, status).orderBy(pos)))
    runs = islands.filter(F.col(status).isin(list(wanted))).groupBy(*keys, status, "__i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return runs.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_words"))


def neighbours(df: DataFrame, keys: Keys, value: str = "p", pos: str = "pos", default: float = 1.0) -> DataFrame:
    line = Window.partitionBy(*keys).orderBy(pos)
    return df.withColumn("prev_p", F.lag(value, 1, default).over(line)).withColumn("next_p", F.lead(value, 1, default).over(line))


def relative_position(df: DataFrame, keys: Keys, pos: str = "pos") -> DataFrame:
    """Adds rel (0 to 1), gap (position among the gaps) and edge."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("rel", F.col(pos) / F.greatest(n - 1, F.lit(1))).withColumn("gap", F.col(pos) / F.greatest(n, F.lit(1))).withColumn("edge", (F.col(pos) == 0) | (F.col(pos) == n - 1))


def trigram_repeat(tokens: Column) -> Column:
    """Share of trigrams that repeat an earlier one; 0 with fewer than three tokens."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - 2, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(3)), "\x01"))
    return F.when(F.size(tokens) < 3, F.lit(0.0)).otherwise(1.0 - F.size(F.array_distinct(grams)) / F.size(grams))


def speaker_changes(df: DataFrame, keys: Keys, role: str = "role", pos: str = "idx") -> DataFrame:
    """(keys, n_turns): one more than the changes of role."""
    changed = F.col(role) != F.lag(role).over(Window.partitionBy(*keys).orderBy(pos))
    return df.withColumn("__c", F.when(changed, 1).otherwise(0)).groupBy(*keys).agg((F.sum("__c") + 1).alias("n_turns"))


def caught_within(df: DataFrame, keys: Keys, budgets: Sequence[float], order: Column, cost: str, value: str, tie: str) -> DataFrame:
    """(keys, budget, caught): the value of what can be reviewed, in order, before its cost exceeds each budget."""
    spent = scans.running(df, keys, [order, tie], {"__cost": F.col(cost)}).withColumn("budget", F.explode(F.array(*(F.lit(float(b)) for b in budgets))))
    return spent.groupBy(*keys, "budget").agg(F.coalesce(F.sum(F.when(F.col("__cost") <= F.col("budget") + 1e-9, F.col(value))), F.lit(0)).alias("caught"), F.sum(value).alias("total"))


def queue(df: DataFrame, limit: int, by: str = "r", tie: str = "unit_id", descending: bool = True) -> DataFrame:
    """The first units to review. The limit is what a queue page shows."""
    return df.orderBy(F.col(by).desc() if descending else F.col(by).asc(), tie).limit(limit)
