"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import attach_by_key, drop_tables, materialise


def connected_components(edges: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """From edges (a, b) of longs: (id, component) for every vertex, component being its smallest reachable vertex.

    Each round hangs the neighbours of a vertex on their smallest one; rounds grow as the logarithm of the diameter.
    A vertex with very many neighbours is spread like any hot key. Every round is written to the shared folder, and what it was made from is
    removed. The path of the last table is noted in `scratch`.
    """
    spark, held = edges.sparkSession, []
    edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", held)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
        total = 2 * edges.count()
        large = attach_by_key(both, low.select("a", "n", F.least("a", "low").alias("low")), "a", ["low"], total, F.col("b"))
        large = materialise(large.filter("b > a").select(F.col("low").alias("a"), "b").distinct(), "large-star", held)
        low = large.groupBy("b").agg(F.min("a").alias("low"), F.count(F.lit(1)).alias("n"))
        small = attach_by_key(large, low, "b", ["low"], large.count(), F.col("a"))
        hung = small.select(F.explode(F.array(F.struct(F.col("low").alias("a"), "b"), F.struct(F.col("low").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        last: list[str] = []
        edges = materialise(hung.filter("a <> b").distinct(), "small-star", last)
        drop_tables(spark, held)
        held = last
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    if scratch is not None:
        scratch += held
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
