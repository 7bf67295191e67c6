"""Near-duplicate components by a chosen-path set similarity join.

Documents with the same shingle set are one class; what follows sees classes. Every class has a minwise sketch. A tree
branches the classes by a selected coordinate of it: classes with the same minimum go to the same child. A node of a
few classes is compared exhaustively; a larger one branches again, by two coordinates that its path selects, and
several independent trees make up for a pair that one of them parts.

A large node of near copies would never branch apart, so before branching, every large node is compared with one of
its classes, the pivot (the class of most documents). Classes that look linked to the pivot (`core`) leave the node:
whatever else is linked to one of them is, by the triangle inequality of the Jaccard distance, about half like the
pivot; those (`rim`) are compared with the core in blocks of bounded size.

What the trees give is not every candidate pair but, for each node, a forest that connects its candidates, so its size
is that of the classes. Pairs of the forest are confirmed on full sets first. Where classes that the forests
connect are still different components, each class outside of the largest of them is compared with all others there by full
sets, in blocks, and the links found join the components. A pair whose sketches are less alike than CANDIDATE is found only there:
at similarity 0.75 the sketches of 0.0003 to 0.0004 of the pairs are. The trees part about 2.5e-6 of them where all nodes are large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest

from triagelake.llm.common import attach_by_key, drop_tables, materialise
from triagelake.llm.components import connected_components
from triagelake.llm.shingles import SKETCH, mixed, shingle_set, sketch

#: Independent trees: at similarity 0.75 one root parts a pair with probability 1/4.
TREES = 12
#: Coordinates by which a large node branches.
BRANCHES = 2
#: Classes in a node that is compared exhaustively.
LEAF = 160
#: Sketch likeness below which a pair is no candidate: 3.4 standard deviations under 0.75.
CANDIDATE = 0.62
#: Sketch likeness to the pivot that makes a class part of the core, and of the rim.
CORE, RIM = 0.75, 0.3
#: Classes on each side of a block, about, and shingles of their sets where those are compared (8 bytes each).
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Levels of branching; a node that is still large after them is compared whole, in blocks.
LEVELS = 2

PAIRS = "a long, b long, likeness double"


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n_shingles, digest, sketch)."""
    for batch, at in ((b, at) for b in batches for at in range(0, len(b), 1024)):
        batch = batch.slice(at, 1024)
        counts, digests, sketches = [], [], []
        for text in batch.column("text").to_pylist():
            found = shingle_set(text)
            counts.append(len(found))
            digests.append(xxh3_128_hexdigest(found.tobytes()) if len(found) else None)
            sketches.append(sketch(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(sketches, pa.binary())], names=["id", "n_shingles", "digest", "sketch"])


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, shingles)."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(t).view(np.int64) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])


def _sketches(column: pa.Array | list) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if isinstance(column, pa.Array) else column), np.uint32).reshape(-1, SKETCH)


def _pairs(a: list, b: list, likeness: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(likeness, pa.float64())], names=["a", "b", "likeness"])


def _forest(like: np.ndarray, first: list[int], second: list[int]) -> list[tuple[int, int]]:
    """Pairs (row, column) of a forest of greatest likeness that connects what candidate pairs connect; rows and columns are numbered by first and second."""
    i, j = np.nonzero(like >= CANDIDATE)
    parent, pairs = list(range(max([*first, *second], default=0) + 1)), []
    for k in np.argsort(-like[i, j], kind="stable").tolist():
        a, b = _root(parent, first[i[k]]), _root(parent, second[j[k]])
        if a != b:
            parent[max(a, b)] = min(a, b)
            pairs.append((int(i[k]), int(j[k])))
    return pairs


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def compare_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (ids, sketches) to candidate pairs."""
    for batch in batches:
        a, b, likeness = [], [], []
        for ids, column in zip(batch.column("ids").to_pylist(), batch.column("sketches").to_pylist(), strict=True):
            s = _sketches(column)
            like = (s[:, None, :] == s[None, :, :]).mean(axis=2)
            for x, y in _forest(np.triu(like, 1), list(range(len(ids))), list(range(len(ids)))):
                a.append(min(ids[x], ids[y])), b.append(max(ids[x], ids[y])), likeness.append(float(like[x, y]))
        yield _pairs(a, b, likeness)


def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (left, left_sketches, right, right_sketches) to a forest of candidate pairs across, which connects what all of them connect."""
    for batch in batches:
        for left, ls, right, rs in zip(*(batch.column(c).to_pylist() for c in ("left", "left_sketches", "right", "right_sketches")), strict=True):
            a, b, likeness = [], [], []
            if left and right:
                s, t = _sketches(ls), _sketches(rs)
                like = np.stack([(s == x).mean(axis=1) for x in t], axis=1)
                number = {x: k for k, x in enumerate(dict.fromkeys([*left, *right]))}
                for i, j in _forest(like, [number[x] for x in left], [number[x] for x in right]):
                    a.append(min(left[i], right[j])), b.append(max(left[i], right[j])), likeness.append(float(like[i, j]))
            yield _pairs(a, b, likeness)


def link_blocks(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of classes (id, part, sketch, shingles) on two sides to links (a, b) between different parts, one for each two parts that a block joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                left, right, a, b = left.as_py(), right.as_py(), [], []
                if left and right:
                    sets = [[np.unique(np.array(x["shingles"], np.int64)) for x in side] for side in (left, right)]
                    sizes, values = np.array([len(x) for x in sets[0]]), np.concatenate(sets[0])
                    order = np.argsort(values, kind="stable")
                    values, owner = values[order], np.repeat(np.arange(len(left)), sizes)[order]
                    names = {p: i for i, p in enumerate(dict.fromkeys(x["part"] for side in (left, right) for x in side))}
                    parent = list(range(len(names)))
                    for y, wanted in zip(right, sets[1], strict=True):
                        lo = np.searchsorted(values, wanted)
                        counts = np.searchsorted(values, wanted, side="right") - lo
                        shared = np.bincount(owner[np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())], minlength=len(left))
                        for i in np.flatnonzero((shared > 0) & (100 * shared >= percent * (sizes + len(wanted) - shared))).tolist():
                            p, q = _root(parent, names[left[i]["part"]]), _root(parent, names[y["part"]])
                            if p != q:
                                parent[max(p, q)] = min(p, q)
                                a.append(left[i]["id"]), b.append(y["id"])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def against_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, id, copies, pivot, sketch, pivot_sketch) to (node, id, copies, pivot, sketch, likeness)."""
    for batch in batches:
        like = (_sketches(batch.column("sketch")) == _sketches(batch.column("pivot_sketch"))).mean(axis=1) if len(batch) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "id", "copies", "pivot", "sketch")), pa.array(like, pa.float64())], names=["node", "id", "copies", "pivot", "sketch", "likeness"])


def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sketch) to a row (node, id) for each tree."""
    for batch in batches:
        if len(batch):
            s = _sketches(batch.column("sketch"))[:, :TREES].astype(np.uint64)
            node = mixed(s | (np.arange(1, TREES + 1, dtype=np.uint64) << np.uint64(32))).view(np.int64)
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(node.ravel()), pa.array(ids, pa.int64())], names=["node", "id"])


def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, id, copies, sketch) to the same for each selected coordinate, under the child's number."""
    for batch in batches:
        if len(batch):
            s = _sketches(batch.column("sketch"))
            node = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            chosen = (mixed(node) % np.uint64(SKETCH)).astype(np.int64)
            step = (mixed(node ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(SKETCH)).astype(np.int64) | 1
            for k in range(BRANCHES):
                at = (chosen + k * step) % SKETCH
                child = mixed(mixed(node + np.uint64(k + 1)) ^ s[np.arange(len(s)), at].astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(child), *(batch.column(c) for c in ("id", "copies", "sketch"))], names=["node", "id", "copies", "sketch"])


def _grid(left: DataFrame, right: DataFrame, columns: list[str], scratch: list[str], weight: Column | None = None) -> DataFrame:
    """The left and right rows (node, id, ...) of each node in a grid of blocks: (left, right), arrays of structs.

    A side of a block has about BLOCK rows and, with a `weight` of rows, BLOCK_SHINGLES of that at most (or one row), whatever a node holds.
    """
    rows = left.select("node", *columns, F.lit(0).alias("side")).unionByName(right.select("node", *columns, F.lit(1).alias("side")))
    share = F.lit(1.0 / BLOCK) if weight is None else F.greatest(F.lit(1.0 / BLOCK), weight / F.lit(float(BLOCK_SHINGLES)))
    sides = [F.ceil(F.sum(F.when(F.col("side") == k, share).otherwise(0.0))).cast("int").alias(f"parts{k}") for k in (0, 1)]
    counted = materialise(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *sides).filter("parts0 > 0 AND parts1 > 0"), "grid", scratch)
    rows = attach_by_key(rows, counted, "node", ["parts0", "parts1"], rows.select("node").count(), F.col("id")).filter("parts0 IS NOT NULL")
    mine, theirs = (F.when(F.col("side") == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("parts0", "parts1"), ("parts1", "parts0")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), mine).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), theirs - 1)))
    i, j = (F.when(F.col("side") == k, F.col("own")).otherwise(F.col("other")) for k in (0, 1))
    of = lambda k: F.collect_list(F.when(F.col("side") == k, F.struct(*columns)))
    return rows.groupBy("node", i.alias("i"), j.alias("j")).agg(of(0).alias("left"), of(1).alias("right"))


def _blocks(left: DataFrame, right: DataFrame, scratch: list[str]) -> DataFrame:
    """Candidate pairs that connect the left and right classes (node, id, sketch) of each node, block by block."""
    grid = _grid(left, right, ["id", "sketch"], scratch)
    return grid.select(F.col("left.id").alias("left"), F.col("left.sketch").alias("left_sketches"), F.col("right.id").alias("right"), F.col("right.sketch").alias("right_sketches")).mapInArrow(compare_blocks, PAIRS)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def candidate_pairs(classes: DataFrame, scratch: list[str]) -> DataFrame:
    """Pairs (a, b, likeness) of classes (id, copies, sketch) that connect all candidates which the trees bring together."""
    found: list[DataFrame] = []
    rows = materialise(classes.select("id", "sketch").mapInArrow(root, "node long, id long"), "tree-rows", scratch)
    for level in range(LEVELS + 1):
        total = rows.count()
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("who")).filter("n > 1")
        # Trees often end in the same few classes; they are compared once.
        sizes = sizes.groupBy("n", "who").agg(F.min("node").alias("node")).withColumn("size", F.col("n"))
        rows = attach_by_key(rows, sizes, "node", ["size"], total, F.col("id")).filter("size > 1")
        if level == 0:
            rows = materialise(rows, "tree-nodes", scratch).join(classes, "id")
        else:
            rows = materialise(rows, "tree-nodes", scratch)
        small = rows.filter(F.col("size") <= LEAF).groupBy("node").agg(F.collect_list("id").alias("ids"), F.collect_list("sketch").alias("sketches"))
        pairs = small.select("ids", "sketches").mapInArrow(compare_leaves, PAIRS)
        large = materialise(rows.filter(F.col("size") > LEAF).select("node", "id", "copies", "sketch"), "large-nodes", scratch)
        total = large.count()
        if not total or level == LEVELS:
            found.append(materialise(pairs.unionByName(_blocks(large, large, scratch)) if total else pairs, "pairs", scratch))
            break
        pivots = large.groupBy("node").agg(F.max(F.struct("copies", F.xxhash64("id").alias("h"), "id", "sketch")).alias("p"), F.count(F.lit(1)).alias("n"))
        pivots = materialise(pivots.select("node", "n", F.col("p.id").alias("pivot"), F.col("p.sketch").alias("pivot_sketch")), "pivots", scratch)
        seen = attach_by_key(large, pivots, "node", ["pivot", "pivot_sketch"], total, F.col("id"))
        seen = materialise(seen.select("node", "id", "copies", "pivot", "sketch", "pivot_sketch").mapInArrow(against_pivot, "node long, id long, copies long, pivot long, sketch binary, likeness double"), "tree-stars", scratch)
        seen = seen.filter(F.col("id") != F.col("pivot"))
        # Nodes of several trees often have the same pivot; what it has met in them is one star.
        star = seen.filter(F.col("likeness") >= RIM).dropDuplicates(["pivot", "id"]).select(F.col("pivot").alias("node"), "id", "sketch", "likeness")
        star = materialise(star, "stars", scratch)
        pairs = pairs.unionByName(star.filter(F.col("likeness") >= CANDIDATE).select(F.least("id", "node").alias("a"), F.greatest("id", "node").alias("b"), "likeness"))
        found.append(materialise(pairs.unionByName(_blocks(star.filter(F.col("likeness") >= CORE), star.filter(F.col("likeness") < CORE), scratch)), "pairs", scratch))
        rest = seen.filter(F.col("likeness") < CORE).select("node", "id", "copies", "sketch")
        rows = materialise(rest.mapInArrow(branch, "node long, id long, copies long, sketch binary"), "tree-rows", scratch)
    return _union(found).groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets (id, shingles)."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = both.withColumn("shared", F.size(F.array_intersect("x", "y")).cast("long")).withColumn("union", F.size("x") + F.size("y") - F.col("shared"))
    return both.filter(F.col("shared") * 100 >= F.col("union") * percent).select("a", "b")


def links(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes (id, copies, sketch), enough to connect every component. docs: (id, text).

    First the pairs of the forests are confirmed. Where components of confirmed links are connected by a pair that was
    not, classes outside of the largest component there are compared with all others.
    """
    scratch: list[str] = []
    pairs = materialise(candidate_pairs(classes, scratch), "candidates", scratch)
    members = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # A class has the same set whichever of its documents is read; an id that repeats may have several texts.
    sets = docs.join(members, "id", "left_semi").mapInArrow(sets_of, "id long, shingles array<long>").dropDuplicates(["id", "shingles"])
    sets = materialise(sets, "candidate-sets", scratch)
    first = materialise(confirm(pairs, sets, percent), "links", scratch)
    parts = connected_components(first, scratch).withColumnRenamed("component", "part")
    clusters = connected_components(pairs.select("a", "b"), scratch).withColumnRenamed("component", "node")
    placed = materialise(clusters.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")), "clusters", scratch)
    sizes = placed.groupBy("node", "part").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("node").agg(F.max(F.struct("k", "part")).getField("part").alias("largest"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("n")).filter("parts > 1")
    open_ = attach_by_key(placed, largest, "node", ["largest"], placed.count(), F.col("id")).filter("largest IS NOT NULL")
    open_ = materialise(open_.join(sets, "id").join(classes.select("id", "sketch"), "id").select("node", "id", "part", "largest", "sketch", "shingles"), "open-classes", scratch)
    grid = _grid(open_, open_.filter(F.col("part") != F.col("largest")), ["id", "part", "sketch", "shingles"], scratch, F.size("shingles"))
    found = materialise(first.unionByName(grid.select("left", "right").mapInArrow(link_blocks(percent), "a long, b long")), "links")
    drop_tables(docs.sparkSession, scratch)
    return found


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row for each row of `docs`: id, n_shingles, component_id, kept.

    Two documents are linked when their sets of 5-word shingles (A-Z in lower case, words parted by white space, fewer
    than five words counting as one shingle) have a Jaccard similarity of percent / 100 or more. component_id is the
    smallest id that links reach, and kept says that it is the document's own. A text that is null or has no words
    has the empty set, is linked with nothing and is kept. Rows that repeat an id are one document in what
    they are linked to. A null id has no component and is kept. An empty table gives an empty one; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = materialise(docs.mapInArrow(describe, "id long, n_shingles long, digest string, sketch binary"), "sketches")
    total = described.count()
    classes = described.filter("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"), F.first("sketch").alias("sketch"))
    classes = materialise(classes, "classes")
    found = links(classes.select(F.col("class").alias("id"), F.col("n").alias("copies"), "sketch"), docs, percent)
    # An id with several texts joins the classes of them all.
    repeated = described.filter("digest IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("id")
    member = attach_by_key(described.select("id", "n_shingles", "digest"), classes.select("digest", "n", "class"), "digest", ["class"], total, F.col("id"))
    member = materialise(member, "members")
    same = member.join(repeated, "id", "left_semi").filter("class IS NOT NULL").select(F.col("class").alias("a"), F.col("id").alias("b"))
    parts = connected_components(found.unionByName(same))
    parts = parts.select(F.col("id").alias("class"), F.col("component"))
    counts = member.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    out = attach_by_key(member, counts.join(parts, "class"), "class", ["component"], total, F.col("id"))
    out = out.withColumn("component_id", F.coalesce("component", "class", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
