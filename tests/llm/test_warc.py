import base64
import gzip
import hashlib
import random

from triagelake.llm import warc


def test_round_trip_and_revisits(spark):
    rng = random.Random(6)
    texts = ["", None, "<p>a</p>", "WARC/1.1\r\n\r\nfake", "\r\n\r\n" * 5, "é" * 3000, "hot"]
    rows = [(i, f"http://x/{i}", "hot" if rng.random() < 0.4 else rng.choice(texts)) for i in range(300)]
    pages = spark.createDataFrame(rows, "order_id long, target string, html string").selectExpr("order_id", "target", "CAST(html AS BINARY) AS payload")
    path, found = warc.archive(pages)
    last = {}
    for i, _, t in rows:
        last[t or ""] = i
    found = {int(r["record_id"]): r for r in found.collect()}
    assert len(found) == len(rows)
    for i, url, t in rows:
        body, r = (t or "").encode(), found[i]
        assert r["target"] == url and r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        original = last[t or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == original else ("revisit", str(original)))
    # Only one copy of each payload is in the archives, and the files are plain gzip.
    stored = warc.read_archives(spark, path).filter("payload IS NOT NULL").collect()
    assert sorted(bytes(r["payload"]) for r in stored) == sorted(t.encode() for t in last)


def test_small_payloads_are_responses_and_edges(spark):
    rows = spark.createDataFrame([(1, "u", b"a"), (2, "u", b"a"), (3, None, b"long one"), (4, "u", b"long one")], "order_id long, target string, payload binary")
    found = {r["order_id"]: r["record_type"] for r in warc.resolve_revisits(rows, least_bytes=4).collect()}
    assert found == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.archive(rows.filter("false"))[1].collect() == []


def test_parses_members_of_their_own():
    record = lambda n: b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % n + b"x" * n + b"\r\n\r\n"
    found = list(warc.parse_archive(gzip.compress(record(3)) + gzip.compress(record(70_000)) + gzip.compress(record(0))))
    assert [len(b) for _, b in found] == [3, 70_000, 0]


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", ((100, 50), (2000, 3), (None, 1)))
    rng = random.Random(3)
    rows = [(i, "u", rng.randbytes(rng.choice((0, 30, 100, 101, 1500, 2000, 2001, 400_000)))) for i in range(200)]
    pages = spark.createDataFrame(rows, "order_id long, target string, payload binary").coalesce(1)
    path, found = warc.archive(pages)
    assert found.count() == len(rows)
    stored = {bytes(r["payload"]) for r in warc.read_archives(spark, path).filter("payload IS NOT NULL").collect()}
    assert stored == {p for *_, p in rows}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect()
    held = [[len(block.partition(b"\r\n\r\n")[2]) for _, block in warc.parse_archive(bytes(f["content"]))] for f in files]
    assert all(sum(sizes) <= 6000 or len(sizes) == 1 for sizes in held) and max(map(len, held)) > 3
    # Only classes that records have are written.
    assert warc.archive(pages.filter("octet_length(payload) <= 100"))[1].count() == sum(len(p) <= 100 for *_, p in rows)
