"""Long texts and columns whose names clash, for the operators whose own tests have neither."""

import pytest
from pyspark.sql import functions as F

from triagelake.llm import exact_dedup, mixing, sharding, warc

LONG = "word " * 200_000


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with a very long text, nulls, repeats, and columns named as the operators name theirs."""
    rows = [(1, LONG, "a"), (2, LONG, "b"), (3, None, None), (3, None, None), (4, "", "a"), (None, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = "id key queue bucket size n digest body salt keep_id kept group_size text_sha256 shard slot bundle bytes item payload_digest original copies positions target __keep __n __ck rank".split()
    return docs.withColumns({name: F.lit(7) for name in names})


def test_mixing(odd):
    found = {r["doc_id"]: r for r in mixing.mix(odd).collect()}
    assert found[1]["size"] == found[2]["size"] == 200_000 and found[1]["source_size"] == 200_000 and found[3]["size"] == 0
    order = mixing.training_order(odd, mixing.mix(odd))
    assert order.columns == odd.columns and order.filter("doc_id = 1").count() == found[1]["copies"]


def test_exact_dedup(odd):
    found = exact_dedup.one_of_repeats(exact_dedup.mark_duplicates(odd)).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in found) == [(0, 0, 1, True), (1, 2, 2, False), (2, 2, 2, True), (3, 4, 3, False), (3, 4, 3, False), (4, 4, 3, True)]


def test_sharding(odd):
    found = sharding.shard_by_bytes(odd, shards=3).collect()
    assert sorted(r["size"] for r in found) == [16, 16, 16, 19, 1_000_016, 1_000_016]
    assert len({r["shard"] for r in found if r["size"] > 1_000_000}) == 1
    for s in {r["shard"] for r in found}:
        slots = sorted(r["slot"] for r in found if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_warc(odd):
    records = odd.select(F.col("doc_id").alias("order_id"), F.lit("u").alias("target"), F.col("text").cast("binary").alias("payload"), "digest", "n", "original", "payload_digest", "__ck")
    _, found = warc.archive(records)
    rows = sorted((r["record_id"] or "", r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found.collect())
    assert rows[:3] == [("", 3, "response", None), ("1", 1_000_000, "revisit", "2"), ("2", 1_000_000, "response", None)]
    assert rows[3:] == [("3", 0, "revisit", "4"), ("3", 0, "revisit", "4"), ("4", 0, "response", None)]
