"""Fingerprints against sets of paragraph digests, and edits against slicing."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from triagelake.llm import fingerprints


def pieces(text):
    return set(p.rstrip(" ") for p in re.findall(r"(?:\S+[^\S\n]*){1,12}", text))


def like(a, b):
    a, b = pieces(a), pieces(b)
    return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))


def test_edits_and_likeness(spark, docs_schema):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    texts = ["", None, "x", "same same", "same same"]
    texts += ["\n".join(" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.choice([1, 3, 30, 200]))) for _ in range(60)]
    ids = rng.sample(range(10_000), len(texts))
    rows = [(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)]
    found = {r["doc_id"]: r for r in fingerprints.compare_with_edits(spark.createDataFrame(rows, docs_schema)).collect()}
    order = sorted(rows, key=lambda r: r[0])
    names = {}
    for i, row in enumerate(order):
        text, other = row[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + other[:k]
        r = found[row[0]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - like(text, edited)) < 1e-9 and abs(r["near_next"] - like(text, other)) < 1e-9
        assert len(r["only_edited"]) == len(pieces(text) ^ pieces(edited))
        assert names.setdefault(text, r["fingerprint"]) == r["fingerprint"] and (edited != text or r["edited_fingerprint"] == r["fingerprint"])
    assert len(set(names.values())) == len(names)


def test_repeats_nulls_and_empty_tables(spark, docs_schema):
    assert fingerprints.compare_with_edits(spark.createDataFrame([], docs_schema)).collect() == []
    rows = [(1, "a b c d", "en", "s", 0), (1, "a b c d", "en", "s", 0), (1, "other", None, None, None), (None, "first", "en", "s", 0)]
    found = fingerprints.compare_with_edits(spark.createDataFrame(rows, docs_schema).withColumn("k1", F.lit("x"))).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in found) == [(-1, 5), (1, 5), (1, 7), (1, 7)]


def test_an_overfull_table_is_retried_larger(spark):
    digests = lambda low, high: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: F.xxhash64(i))
    pairs = spark.range(3).select(F.col("id").alias("k1"), F.col("id").alias("k2"), F.lit(0).alias("pair"), digests(1, 500).alias("a"), digests(501, 1000).alias("b"), F.lit(40.0).alias("estimate"))
    first = fingerprints.differences(pairs, 0, False).collect()
    assert all(r["left"] > 0 for r in first)
    assert [r["differ"] for r in fingerprints.recover(pairs, False).collect()] == [1000] * 3


def test_likeness_from_the_two_strings_alone(spark, docs_schema, tmp_path):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(3, 12)))
    texts = ["\n".join(line() for _ in range(rng.choice([1, 5, 40, 300]))) for _ in range(40)] + ["", None]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    fingerprints.compare_with_edits(spark.createDataFrame(rows, docs_schema)).write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    found = fingerprints.subtract(stored, ["doc_id"], "fingerprint", "edited_fingerprint").withColumnRenamed("only", "later").join(stored, "doc_id").collect()
    assert len(found) == len(rows) and sum(r["left"] == 0 for r in found) >= 0.95 * len(rows)
    for r in found:
        assert (r["likeness"] is None) == (r["left"] > 0)
        if r["left"] == 0:
            assert abs(r["likeness"] - r["near_edited"]) < 1e-9 and sorted(r["later"]) == sorted(r["only_edited"])
    # A text against one of another size: the larger table is folded.
    two = stored.filter("doc_id < 2").agg(F.max_by("fingerprint", "doc_id").alias("b"), F.min_by("fingerprint", "doc_id").alias("a")).withColumn("k", F.lit(1))
    r = fingerprints.subtract(two, ["k"], "a", "b").first()
    assert r["likeness"] is None or abs(r["likeness"] - like(texts[0], texts[1])) < 1e-9


def test_the_difference_is_estimated_from_strata(spark):
    span = lambda low, high: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: F.xxhash64(i))
    for differ in (0, 4, 30, 400, 5000):
        a, b = fingerprints.strata(span(1, 6000 + differ // 2)), fingerprints.strata(F.concat(span(1, 6000), span(20_001, 20_000 + (differ - differ // 2))) if differ else span(1, 6000))
        found = spark.range(1).select(fingerprints.estimated_difference(a, b).alias("d")).first()["d"]
        assert abs(found - differ) <= max(3, 0.5 * differ)
