"""WARC archives: writing, reading and resolving revisits.

An archive is a gzip file of WARC/1.1 records. Spark's text writer writes it, a record a row with the two empty lines
that end a record as the separator, so archives go to whatever store the shared folder is in; they are read back as binary files and
parsed by Content-Length, decompressing as it goes. Records are written by classes of their size, each with its own number of records a file, so that a file holds
a bounded number of bytes, or one record.

Resolution shuffles headers only, by payload digest, to find the response that stands for equal payloads. Records
then learn it by a join that serves digests with very many records by broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.common import attach_by_key, materialise, scratch_path

#: Fixed values of the format: what revisit records refer to.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGIT_32, LETTER_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Classes of payloads by their size: bytes, at most, and records in a file, at most. A file has 256 MB of payloads or one record.
SIZES = ((1 << 16, 4096), (1 << 22, 64), (None, 1))
RECORD = "record_id string, target string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGIT_32, LETTER_32)


def _size_class(payload_bytes: Column) -> Column:
    """The place in SIZES of a payload."""
    out = F.lit(len(SIZES) - 1)
    for place, (most, _) in reversed([*enumerate(SIZES)][:-1]):
        out = F.when(payload_bytes <= most, place).otherwise(out)
    return out


def _with_digest(records: DataFrame) -> DataFrame:
    payload = F.coalesce("payload", F.lit("").cast("binary"))
    return records.select("order_id", "target", payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": sha1_base32(F.col("payload"))})


def headers_of(records: DataFrame) -> DataFrame:
    """A written table of what resolution needs of records (order_id, target, payload): order_id, payload_bytes, payload_digest."""
    return materialise(_with_digest(records).select("order_id", "payload_bytes", "payload_digest"), "headers")


def resolve_revisits(records: DataFrame, *, least_bytes: int = 0, headers: DataFrame | None = None) -> DataFrame:
    """Records (order_id, target, payload) to the same with payload_bytes, payload_digest, record_type and refers_to.

    Of records with equal payloads of at least `least_bytes`, the one with the largest order_id is a response and the others are
    revisits that refer to it; smaller payloads are all responses. A null payload is empty. Rows that
    repeat the largest id of a payload are responses too. An empty table gives an empty one. `headers` are headers_of(records), if the caller has them.
    """
    headers = headers if headers is not None else headers_of(records)
    equal = headers.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("order_id").alias("original"), F.count(F.lit(1)).alias("n"))
    groups = materialise(equal.filter("n > 1"), "payloads")
    out = attach_by_key(_with_digest(records), groups, "payload_digest", ["original"], headers.count(), F.col("order_id"))
    revisit = F.col("original").isNotNull() & ~F.col("order_id").eqNullSafe(F.col("original")) & (F.col("payload_bytes") >= least_bytes)
    return out.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("original"))).drop("original")


def _urn(order_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-record:"), F.coalesce(order_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(resolved: DataFrame, path: str, *, classes: Iterable[int] = range(len(SIZES))) -> None:
    """Writes resolved records as archives with fresh headers; revisits keep the answer's HTTP header and have no payload.

    Each class of SIZES is a folder of its own below `path`; `classes` are those that records can be of, revisits by the payload they had.
    """
    revisit = F.col("record_type") == "revisit"
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n")).cast("binary")
    block = F.when(revisit, answer).otherwise(F.concat(answer, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn(F.col("order_id"))),
        line("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("target", F.lit("")), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(IDENTICAL)), line("WARC-Refers-To", _urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    for place in sorted(set(classes)):
        records = resolved.filter(_size_class(F.col("payload_bytes")) == place).select(F.concat(head.cast("binary"), block).cast("string").alias("value"))
        records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", SIZES[place][1]).text(f"{path}/size-{place}")


class _Source:
    """Reads a gzip file piecemeal."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer, self.inflate = memoryview(data), 0, bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        if self.inflate.eof:
            if not self.inflate.unused_data and self.at >= len(self.data):
                return False
            rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            if rest:
                self.buffer += self.inflate.decompress(rest)
                return True
        if self.at >= len(self.data):
            return False
        self.buffer += self.inflate.decompress(self.data[self.at : self.at + (1 << 16)])
        self.at += 1 << 16
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (end := self.buffer.find(mark)) < 0:
            if not self.more():
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("an archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names in lower case) and block of each record of a gzip file, in one or many members."""
    source = _Source(data)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = source.take(int(headers["content-length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        yield headers, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below a path; payload_bytes and payload are null for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("target", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
        name = lambda urn: None if not urn or urn == "<urn:x-record:none>" else urn.removeprefix("<urn:x-record:").removesuffix(">")
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for head, block in parse_archive(content.as_py()):
                    revisit, block = head["warc-type"] == "revisit", block.partition(b"\r\n\r\n")[2]
                    rows.append((name(head["warc-record-id"]), head.get("warc-target-uri"), "revisit" if revisit else "response", None if revisit else len(block), head["warc-payload-digest"].removeprefix("sha1:"), name(head.get("warc-refers-to")), None if revisit else block))
                    size += len(block)
                    if size > 1 << 23 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def join_originals(records: DataFrame) -> DataFrame:
    """Records read back, revisits with the payload_bytes and payload_digest of the response they refer to; without payloads.

    The response's digest is computed anew from its payload.
    """
    heads = materialise(records.withColumn("own_digest", F.when(F.col("payload").isNotNull(), sha1_base32(F.col("payload")))).drop("payload"), "warc-headers")
    revisits = heads.filter("refers_to IS NOT NULL").groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    originals = heads.filter("record_type = 'response'").dropDuplicates(["record_id"]).select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("o_bytes"), F.col("own_digest").alias("o_digest"))
    out = attach_by_key(heads, revisits.join(originals, "refers_to"), "refers_to", ["o_bytes", "o_digest"], heads.count(), F.col("record_id"))
    return out.select("record_id", "target", "record_type", F.coalesce("payload_bytes", "o_bytes").alias("payload_bytes"), F.coalesce("own_digest", "o_digest").alias("payload_digest"), "refers_to")


def archive(records: DataFrame, *, least_bytes: int = 0) -> tuple[str, DataFrame]:
    """Resolves and writes records (order_id, target, payload) to a new path of the shared folder; the path, and what join_originals reads there.

    Nulls, ties, repeated rows and empty tables are as in resolve_revisits; a null order_id comes back as null, a null target as an empty one; payloads of any
    length are written whole; other columns are not read, whatever their names.
    """
    path, headers = scratch_path(records.sparkSession, "warc"), headers_of(records)
    # A class without records costs no pass over the payloads; an empty table still gets a folder.
    classes = [r["c"] for r in headers.select(_size_class(F.col("payload_bytes")).alias("c")).distinct().collect()] or [0]
    write_archives(resolve_revisits(records, least_bytes=least_bytes, headers=headers), path, classes=classes)
    return path, join_originals(read_archives(records.sparkSession, path))
