"""Running sums and ranks over ordered rows, in as many tasks as the rows need.

Rows are dealt by range of their keys and order, and each range knows its number. Sums run within the ranges of a key; what
comes before a range is a window over one row a range. So a key with any number of rows, and a table without keys, is spread
over all tasks, and no window sees more rows of a key than one range holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.sources.records import written

PART = "__part"


def ranged(df: DataFrame, order: Sequence[str | Column], ranges: int | None = None) -> DataFrame:
    """The rows dealt by ranges of `order`, the number of its range in each (__part). They are written to the shared folder: where a range
    begins is settled once, whoever reads it afterwards."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return written(dealt.withColumn(PART, F.spark_partition_id()))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, Column], *, maxima: Mapping[str, Column] | None = None, placed: bool = False) -> DataFrame:
    """Adds, by name, the sum of each column over the rows of the key up to this one (itself included), in ascending order, and of `maxima`
    the largest value up to the row before this one (null at first).

    Rows equal in `order` get sums of their own, in any sequence: name enough columns. Null keys are a key, null values count as nothing
    (a sum over nothing is 0). `placed`: the rows come from `ranged` by the keys and the order already, and keep __part.
    """
    keys, spark_order = list(keys), [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df if placed else ranged(df, [*keys, *spark_order])
    value = {n: F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    line = Window.partitionBy(*keys, PART).orderBy(*spark_order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    most = maxima or {}
    parts = rows.groupBy(*keys, PART).agg(F.lit(1), *(F.sum(c).alias(f"__s_{n}") for n, c in value.items()), *(F.max(c).alias(f"__m_{n}") for n, c in most.items()))
    parts = parts.select(
        *(F.col(c).alias(f"__k_{c}") for c in [*keys, PART]), *(F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in value), *(F.max(f"__m_{n}").over(before).alias(f"__b_{n}") for n in most),
    )
    inner = rows.withColumns({f"__r_{n}": F.sum(c).over(line) for n, c in value.items()} | {f"__r_{n}": F.max(c).over(line.rowsBetween(Window.unboundedPreceding, -1)) for n, c in most.items()})
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys]
    joined = inner.join(parts, [*same, F.col(PART) == F.col(f"__k_{PART}")])
    out = joined.select(*rows.columns, *((F.col(f"__r_{n}") + F.col(f"__b_{n}")).alias(n) for n in value), *(F.greatest(f"__r_{n}", f"__b_{n}").alias(n) for n in most))
    return out if placed else out.drop(PART)
