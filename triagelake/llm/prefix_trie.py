"""The trie of conversations' prefixes, encoded by preorder intervals.

A node is a distinct sequence of first turns. Its key is made of sums of hashes of (depth, role, text), so that keys of all prefixes come
from prefix sums and a conversation of any length is spread over tasks. Conversations are ranked lexicographically by the branches that
they take (a turn that has no sibling decides nothing); a node's conversations are then neighbours, and nodes in the order of
(their first conversation, depth) are in preorder. Each node stores its place and where its subtree ends; leaves and savings of the subtree are
differences of running sums at the two places.

The branches of one conversation are held together: b of them take other conversations with b * b / 2 turns, so there are no more than the root of
twice all turns. Turns of a node are only counted, with partial sums, and hot nodes and conversations are joined by broadcast (attach_by_key).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import attach_by_key, materialise
from triagelake.operators import scans

#: Lanes of 32 bits in a node's sum, and the turns of a conversation that are summed in one task.
LANES, RUN = 6, 4096
_SUMS, _OWN = [f"p{i}" for i in range(LANES)], [f"l{i}" for i in range(LANES)]


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, nth, role, text): turns numbered from 1 by turn, null first, then role and text. A null role or text becomes empty;
    rows with a null conv_id belong to no conversation and are left out."""
    kept = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return scans.running(kept, ["conv_id"], ["turn", "role", "text"], {"nth": F.lit(1)}).select("conv_id", F.col("nth").cast("long").alias("nth"), "role", "text")


def rebuilt(turns: DataFrame, *, modulus: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another one does: (conv_id, nth, role, text) and (conv_id) of all, turnless ones included.

    Conversation c takes the first h turns of conversation c - c % modulus (all if fewer, none if absent), h = crc32(decimal c) % heads,
    then its own after its first h.
    """
    own = materialise(numbered(turns), "trie-turns")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % modulus).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    sizes = materialise(sizes, "trie-sizes")
    plan = sizes.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base")), "base", "left")
    plan = plan.withColumn("head", F.least("h", F.coalesce("of_base", F.lit(0))))
    tails = attach_by_key(own, plan.select("conv_id", "n", "h", "head"), "conv_id", ["h", "head"], own.count(), F.col("nth")).filter("nth > h")
    tails = tails.select("conv_id", (F.col("head") + F.col("nth") - F.col("h")).alias("nth"), "role", "text")
    # A base has fewer than 2 * modulus followers, and fewer than `heads` of its turns are taken.
    first = own.filter(F.col("nth") < heads).withColumnRenamed("conv_id", "base")
    starts = first.join(plan.filter("head > 0").select("conv_id", "base", "head"), "base").filter("nth <= head").select("conv_id", "nth", "role", "text")
    return tails.unionByName(starts), sizes.select("conv_id")


def _paths(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, size, key, parent): a row for each conversation and prefix of it, the empty one included. Keys are hexadecimal."""
    digest = F.sha2(F.concat_ws(":", "nth", F.length("role"), F.concat("role", "text")), 256)
    lanes = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(_OWN)]
    rows = turns.withColumn("digest", digest).select("conv_id", F.col("nth").alias("depth"), F.octet_length("text").cast("long").alias("size"), *lanes)
    roots = conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), *(F.lit(0).cast("long").alias(c) for c in _OWN))
    rows = materialise(rows.unionByName(roots).withColumn(scans.PART, F.floor(F.col("depth") / RUN)), "trie-lanes")
    summed = scans.running(rows, ["conv_id"], ["depth"], {p: F.col(own) for p, own in zip(_SUMS, _OWN, strict=True)}, placed=True)
    key = lambda depth, parts: F.md5(F.concat_ws("|", depth, *parts))
    parent = key(F.col("depth") - 1, [F.col(p) - F.col(own) for p, own in zip(_SUMS, _OWN, strict=True)])
    return materialise(summed.select("conv_id", "depth", "size", key(F.col("depth"), map(F.col, _SUMS)).alias("key"), F.when(F.col("depth") > 0, parent).alias("parent")), "trie-paths")


def _ranks(paths: DataFrame, total: int) -> DataFrame:
    """(conv_id, n, end, j): conversations with their prefixes, the key of the whole and their lexicographic rank from 1."""
    nodes = paths.filter("depth > 0").groupBy("key").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n"))
    lone = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.min("key").alias("key")).filter("children = 1")
    branches = nodes.join(lone.select("key"), "key", "left_anti").select("key", "n", F.lit(True).alias("branch"))
    taken = attach_by_key(paths.filter("depth > 0").select("conv_id", "depth", "key"), branches, "key", ["branch"], total, F.col("conv_id")).filter("branch")
    places = taken.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "key"))), lambda x: x["key"]), "").alias("place"))
    convs = paths.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("key", "depth").alias("end"))
    ordered = scans.running(convs.join(places, "conv_id", "left").withColumn("place", F.coalesce("place", F.lit(""))), [], ["place", "n", "conv_id"], {"j": F.lit(1)})
    return materialise(ordered.select("conv_id", "n", "end", F.col("j").cast("long").alias("j")), "trie-ranks")


def _digests_of_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, conv_id) in order, those of a key together: (key, ends_sha256), of lists of any length."""
    key, digest, out = None, None, []
    for batch in batches:
        for k, ids in batch.groupby("key", sort=False)["conv_id"]:
            part = ",".join(map(str, ids)).encode()
            if k == key:
                digest.update(b"," + part)
                continue
            if key is not None:
                out.append((key, digest.hexdigest()))
            key, digest = k, hashlib.sha256(part)
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
        out = []
    if key is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"])


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256, place, place_end.

    `turns` has conv_id, nth (1, 2, ... in each conversation), role and text, none null; `conversations` the ids of all, those without turns
    included, which end at the root. place is the node's number in preorder from 1, place_end that of the last node of its subtree.
    saved_tokens sums over the subtree (n_convs - 1) * bytes of a node's last text. Copies share all their nodes. Without conversations
    there are no nodes.
    """
    paths = _paths(turns, conversations)
    total = paths.count()
    ranks = _ranks(paths, total)
    ranked = attach_by_key(paths, ranks.select("conv_id", "n", "j"), "conv_id", ["j"], total, F.col("depth"))
    least = lambda c: F.min(c).alias(c)
    nodes = ranked.groupBy("key").agg(least("parent"), least("depth"), least("size"), least("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("j").alias("first_j"), F.max("j").alias("last_j"))
    nodes = materialise(nodes, "trie-nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children.select(F.col("parent").alias("key"), "n_children"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = {"place": F.lit(1), "leaves": F.when(F.col("n_children") == 0, 1).otherwise(0), "saved": (F.col("n_convs") - 1) * F.col("size")}
    nodes = materialise(scans.running(nodes, [], ["first_j", "depth"], own), "trie-preorder")

    # Sums up to the last node that conversation j brings, for every j.
    brought = nodes.groupBy(F.col("first_j").alias("j")).agg(*(F.sum(c).alias(f"own_{n}") for n, c in own.items()))
    until = scans.running(ranks.select("j").join(brought, "j", "left"), [], ["j"], {f"to_{n}": F.col(f"own_{n}") for n in own}).drop(*(f"own_{n}" for n in own))
    n_nodes = nodes.count()
    until = until.withColumnRenamed("j", "last_j").join(nodes.groupBy("last_j").agg(F.count(F.lit(1)).alias("n")), "last_j")
    closed = attach_by_key(nodes, until, "last_j", [f"to_{n}" for n in own], n_nodes, F.col("key"))
    above = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("n_children").alias("n"), F.col("conv_id").alias("parent_conv_id"))
    closed = attach_by_key(closed, above, "parent", ["parent_conv_id"], n_nodes, F.col("key"))

    ends = ranks.select(F.col("end").alias("key"), "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInPandas(_digests_of_lists, "key string, ends_sha256 string")
    span = lambda name: (F.col(f"to_{name}") - F.col(name) + own[name]).cast("long")
    return closed.join(ends, "key", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), span("leaves").alias("n_leaves"), span("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"), "place", F.col("to_place").alias("place_end"),
    )
