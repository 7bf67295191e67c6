import random
import zlib
from collections import defaultdict

import pytest

from triagelake.llm.sharding import difference, shard_by_bytes


def test_differencing_beats_greedy_and_keeps_every_item():
    rng = random.Random(1)
    items = [(str(i), int(rng.paretovariate(1.2) * 1000)) for i in range(500)]
    items = [(k, min(n, 20_000)) for k, n in items]
    found = difference(items, 10)
    assert set(found) == {k for k, _ in items} and set(found.values()) <= set(range(10))
    sums, greedy = [0] * 10, [0] * 10
    for k, n in items:
        sums[found[k]] += n
    for _, n in sorted(items, key=lambda x: -x[1]):
        greedy[greedy.index(min(greedy))] += n
    assert max(sums) - min(sums) <= max(greedy) - min(greedy)
    assert difference([], 3) == {} and difference([("a", 5)], 3).keys() == {"a"}
    assert sorted(difference([(c, n) for c, n in zip("abcde", (8, 7, 6, 5, 4))], 2).values()).count(0) in (2, 3)


def test_shards_of_documents(spark, docs_schema):
    rng = random.Random(3)
    rows = [(i, None if rng.random() < 0.02 else "hot text" if rng.random() < 0.3 else "w" * rng.randint(0, 3000), "en", "s", 0) for i in range(3000)]
    found = shard_by_bytes(spark.createDataFrame(rows, docs_schema), bundles=512).collect()
    text = {r[0]: r[1] or "" for r in rows}
    shard_of, sums, slots = {}, defaultdict(int), defaultdict(list)
    for r in found:
        t = text[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        assert shard_of.setdefault(t, r["shard"]) == r["shard"]
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(found) == 3000 and set(sums) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) <= 1.02 * sum(sums.values()) / 40


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a"), (None, "a"), (2, "b")]])
def test_edges(spark, rows):
    found = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=3).collect()
    assert len(found) == len(rows)
