import random
import re

import numpy as np
import pyarrow as pa

from triagelake.llm import near_dedup
from triagelake.llm.components import connected_components
from triagelake.llm.near_dedup import near_duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """(n_shingles, component) by id, comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {(i, len(s)): find(i) for i, s in sets}


def documents(seed, families=12, size=30, words=60):
    """Families of copies with more and fewer edits, so that similarities spread around the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, passage = [], [word() for _ in range(30)]
    for _ in range(families):
        base = [word() for _ in range(words)]
        if rng.random() < 0.5:
            base[10:40] = passage
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else "\t ".join(copy))
    rows += [None, "", " \n", "one two", "One\vtwo", "one two three four five", "one two three four five", "one two three four five six"]
    rng.shuffle(rows)
    return list(zip(rng.sample(range(100_000), len(rows)), rows, strict=True))


def test_equal_to_all_pairs(spark):
    rows = documents(1)
    expected = brute(rows)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in found} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_a_family_larger_than_a_leaf(spark):
    rows = documents(2, families=1, size=500, words=100)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in found} == brute(rows)


def test_edges(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = spark.createDataFrame([(1, "a b", "x"), (1, "c d e f g h", "x"), (2, "c d e f g h", "x"), (None, "a b", "x"), (3, None, None)], "doc_id long, text string, digest string")
    found = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_duplicates(rows).collect() if r["doc_id"] is not None)
    assert found == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}


def test_blocks_of_open_clusters_compare_whole_sets():
    rng = np.random.default_rng(3)
    sets = [rng.choice(60, rng.integers(30, 55), replace=False).tolist() for _ in range(40)]
    # Sketches that are alike nowhere: only the sets may decide.
    rows = [{"id": i, "part": i, "sketch": np.full(near_dedup.SKETCH, i, np.uint32).tobytes(), "shingles": x} for i, x in enumerate(sets)]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("part", pa.int64()), ("sketch", pa.binary()), ("shingles", pa.list_(pa.int64()))]))
    (out,) = near_dedup.link_blocks(75)([pa.RecordBatch.from_arrays([pa.array([rows], kind), pa.array([rows], kind)], names=["left", "right"])])
    linked = {(i, j) for i in range(40) for j in range(40) if i != j and 100 * len({*sets[i]} & {*sets[j]}) >= 75 * len({*sets[i]} | {*sets[j]})}

    def parts(pairs):
        part = list(range(40))
        for a, b in pairs:
            part = [part[a] if p == part[b] else p for p in part]
        return {frozenset(i for i in range(40) if part[i] == p) for p in part}

    found = list(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))
    assert linked and set(found) <= linked and parts(found) == parts(linked)


def test_recall_on_texts_of_20000_words(spark):
    """Every link of an all-pairs comparison, between long texts edited around the threshold, is in the components."""
    rng = random.Random(5)
    rows = []
    for family in range(8):
        base = [f"w{family}x{rng.randrange(8000)}" for _ in range(20_000)]
        for k in range(5):
            copy = list(base)
            # A changed word parts five shingles: about 480 to 640 changes bring two texts to a similarity around 0.75 of each other.
            for at in rng.sample(range(20_000), [0, 60, 480, 560, 700][k]):
                copy[at] = f"edit{rng.randrange(10**6)}"
            rows.append((family * 10 + k, " ".join(copy)))
    rows.append((999, "short text"))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in found} == brute(rows)


def test_blocks_hold_a_bounded_number_of_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1000)
    rows = spark.range(40).selectExpr("0 AS node", "id", "sequence(1, 300) AS shingles")
    scratch = []
    blocks = near_dedup._grid(rows, rows, ["id", "shingles"], scratch, near_dedup.F.size("shingles")).collect()
    assert max(sum(len(x["shingles"]) for x in b["left"]) for b in blocks) <= 4000 and len(blocks) > 100
    assert {(x["id"], y["id"]) for b in blocks for x in b["left"] for y in b["right"]} == {(i, j) for i in range(40) for j in range(40)}


def test_scratch_tables_go(spark, tmp_path):
    from triagelake.llm import common

    scratch = []
    table = common.materialise(spark.range(3), "some", scratch)
    assert table.count() == 3 and len(scratch) == 1
    path = scratch[0]
    common.drop_tables(spark, scratch)
    assert not scratch and not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
