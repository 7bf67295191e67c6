"""Shards of nearly equal bytes for indivisible groups, by Karmarkar-Karp differencing.

The groups (equal texts) are first reduced to a bounded number of items: groups above 1 / `bundles` of all bytes stand
for themselves, and there are fewer than `bundles` of those; the rest is hashed into `bundles` bundles. So the
differencing, on the driver, sees at most twice `bundles` items whatever the input is. Rows then find their shard
by two broadcast tables of at most that many entries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.common import materialise


def difference(items: Iterable[tuple[str, int]], parts: int) -> dict[str, int]:
    """Assigns each (key, size) to one of `parts`, with sums as equal as Karmarkar-Karp differencing makes them.

    Each item starts as a partial partition with itself in one part. The two partial partitions of the largest spread
    are combined, the largest sum of one with the smallest of the other, until one is left.
    """
    heap: list[tuple[int, int, list[int], list]] = []
    for order, (key, size) in enumerate(sorted(items, key=lambda x: (-x[1], x[0]))):
        heap.append((-size, order, [size] + [0] * (parts - 1), [key] + [None] * (parts - 1)))
    if not heap:
        return {}
    heapq.heapify(heap)
    while len(heap) > 1:
        _, order, sums, trees = heapq.heappop(heap)
        _, _, other, other_trees = heapq.heappop(heap)
        joined = sorted(
            ((a + b, i, (s, t) if s is not None and t is not None else s if t is None else t) for i, (a, b, s, t) in enumerate(zip(sums, reversed(other), trees, reversed(other_trees), strict=True))),
            key=lambda x: (-x[0], x[1]),
        )
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], order, [x[0] for x in joined], [x[2] for x in joined]))
    out: dict[str, int] = {}
    for part, tree in enumerate(heap[0][3]):
        todo = [tree] if tree is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo.extend(node)
            else:
                out[node] = part
    return out


def shard_by_bytes(
    docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, bundles: int = 5120, slot_buckets: int = 1024
) -> DataFrame:
    """Every document with its shard and slot: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text (null: none) plus `overhead`. Equal texts share a shard (null counts as empty);
    sums of size are near equal, as far as one text does not exceed a shard's share. Slots count from 0 without gaps in
    a shard, by a hash of the id and the id; rows that repeat an id get slots of their own. An empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.sha1(text).alias("digest"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = materialise(rows, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("digest"), F.lit(bundles)).cast("string"))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    items = groups.groupBy(F.when(F.col("bytes") * bundles > F.lit(total), F.col("digest")).otherwise(bundle).alias("item")).agg(F.sum("bytes").alias("bytes"))
    found = difference([(r["item"], r["bytes"]) for r in items.collect()], shards)
    table = spark.createDataFrame([(k, v) for k, v in found.items()], "item string, shard int")
    large = table.filter(~F.col("item").startswith("b") | (F.length("item") == 40)).select(F.col("item").alias("digest"), F.col("shard").alias("own"))
    small = table.filter(F.col("item").startswith("b") & (F.length("item") < 40)).select(F.col("item").alias("bundle"), F.col("shard").alias("shared"))
    placed = rows.withColumn("bundle", bundle).join(F.broadcast(large), "digest", "left").join(F.broadcast(small), "bundle", "left")
    placed = placed.select(F.col(id_col), "size", "text_crc32", F.coalesce("own", "shared").alias("shard"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(slot_buckets)).cast("int").alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)))
    out = placed.withColumn("within", within).join(before, ["shard", "bucket"])
    return out.select(
        F.col(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
