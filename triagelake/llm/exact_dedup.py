"""Exact deduplication by skew-safe combining.

Copies meet in three steps, each of which compares whole texts and not only their digests: within a partition of the
scan, within a salted digest group, and between the winners of the salts. Every step leaves one row for a text and
partition, so a text that a third of all rows repeat reaches a task once for each partition before it, not once a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.common import attach_by_key, materialise


def combine_copies(docs: DataFrame, text: Column, *, id_col: str = "doc_id", salts: int = 16) -> DataFrame:
    """One row for each text: digest, keep_id (the largest id; null if all are null) and n, the number of its rows."""
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    # The partial aggregate of this one is the local step.
    salted = rows.groupBy("digest", "salt", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return merged.select("digest", "keep_id", "n")


def mark_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = lambda c: c, salts: int = 16
) -> DataFrame:
    """Every row of `docs` with its columns, and keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical after `normalise`; the row with the largest id of equal texts is kept. A
    null text counts as empty. Rows that repeat an id and text are all answered, and one of them is kept. Where all
    ids of a text are null, keep_id is null and one row is kept. An empty table gives an empty one. Columns of `docs`
    with the names of the four results are replaced. Rows find their group by the SHA-256 of their text, of which two different texts
    are taken never to have the same.
    """
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    results = ["keep_id", "group_size", "kept", "text_sha256"]
    groups = materialise(combine_copies(docs, text, id_col=id_col, salts=salts).filter("n > 1"), "copies")
    # The columns of `docs` get names of their own, which clash with none here; those that nobody asks for are not shuffled, as fields of a struct would be.
    kept = {f"row_{i}": c for i, c in enumerate(docs.columns) if c not in results or c in (id_col, text_col)}
    rows = docs.select(*(F.col(f"`{c}`").alias(own) for own, c in kept.items()), F.col(id_col).alias("id"), F.sha2(text, 256).alias("text_sha256"))
    groups = groups.withColumnsRenamed({"digest": "text_sha256", "keep_id": "keep"}).withColumn("size", F.col("n"))
    out = attach_by_key(rows, groups, "text_sha256", ["keep", "size"], docs.count(), F.col("id"))
    keep_id = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    found = [keep_id.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.col("text_sha256")]
    return out.select(*(F.col(own).alias(c) for own, c in kept.items()), *found)


def one_of_repeats(marked: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Of kept rows that repeat an id and text, leaves one marked as kept."""
    tie = F.row_number().over(Window.partitionBy("text_sha256", id_col).orderBy(F.lit(1)))
    return marked.withColumn("kept", F.col("kept") & (tie == 1))
