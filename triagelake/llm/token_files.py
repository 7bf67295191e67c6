"""Token-id files: documents encoded by a tokenizer, in order of id, as blocks of an adaptive range coder.

A file is a sequence of groups. A group holds whole documents: where it stands (partition of the writing job, number in it), the
documents' ids and numbers of token ids, and coded blocks. Groups end at GROUP token ids, and files at a number of groups, so that neither
grows with the data (a single longer document makes a longer group). Spark's text writer writes a group a row, with a mark as
the line separator, so files go to whatever store the shared folder is in; they are read back as binary files.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.llm import range_coder
from triagelake.llm.common import materialise, scratch_path
from triagelake.llm.parts import Known, Lists, Short, parts_of, slices

#: Fixed values of the format: what opens and ends a group.
OPEN, MARK = b"IDS1", b"#END\n"
#: Token ids of a group, about (8 million are some 8 MB), and groups of a file at most.
GROUP, GROUPS_A_FILE = 1 << 23, 8
_HEAD = struct.Struct("<4sIIII")
#: Bytes of text tokenized at once, about: the more at once, the fewer times a part is looked up.
_AT_ONCE = 1 << 24
#: The letters of a byte-level alphabet by byte, and the last letter of Latin Extended-B; all letters up to there have been in Unicode for long.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = sorted({*range(256)} - _PLAIN)
_ALPHABET = "".join(chr(b if b in _PLAIN else 0x100 + _OTHERS.index(b)) for b in range(256))
_LAST_LATIN = "\u024f"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def group_record(partition: int, number: int, docs: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """A group of documents (ids, numbers of token ids, all token ids) as bytes."""
    known = np.array([d is not None for d in docs], np.uint8)
    table = zlib.compress(known.tobytes() + np.array([d or 0 for d in docs], "<i8").tobytes() + np.array(sizes, "<i8").tobytes())
    blocks = range_coder.encode([ids[i : i + range_coder.BLOCK] for i in range(0, len(ids), range_coder.BLOCK)]) if len(ids) else []
    return b"".join([_HEAD.pack(OPEN, partition, number, len(docs), len(table)), table, struct.pack("<I", len(blocks)), *blocks])


def groups_of(data: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(partition, number, document ids, numbers of token ids, all token ids) of each group of a file."""
    at = 0
    while at < len(data):
        opened, partition, number, n, size = _HEAD.unpack_from(data, at)
        if opened != OPEN:
            raise ValueError("a token file is damaged")
        at += _HEAD.size
        table, at = zlib.decompress(data[at : at + size]), at + size
        known, docs, sizes = np.frombuffer(table, np.uint8, n), np.frombuffer(table, "<i8", n, n), np.frombuffer(table, "<i8", n, 9 * n)
        (blocks,) = struct.unpack_from("<I", data, at)
        at += 4
        coded = []
        for _ in range(blocks):
            end = at + range_coder.record_size(data, at)
            coded.append(data[at:end])
            at = end
        if data[at : at + len(MARK)] != MARK:
            raise ValueError("a token file is damaged")
        at += len(MARK)
        ids = np.concatenate(range_coder.decode(coded)) if coded else np.zeros(0, "<u4")
        if len(ids) != sizes.sum():
            raise ValueError("a group of a token file has other ids than its documents")
        yield partition, number, [int(d) if k else None for k, d in zip(known, docs, strict=True)], sizes, ids


class Tokens:
    """Texts to token ids by a tokenizer of the tokenizers library, which sees each distinct part of texts once.

    That gives what the library gives for whole texts where it is a byte-level BPE that splits by its own pattern, since no token goes on
    over the border of two parts; any other tokenizer gets whole texts. Words of Latin letters, with a space or without, go to the
    library's model directly, in the letters that stand for their bytes, as they are one piece each.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        parts = json.loads(self.tokenizer.to_str())
        split = parts["pre_tokenizer"] or {}
        self.splits = parts["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and all(t["special"] for t in parts["added_tokens"])
        self.lists = Lists(np.int32)
        self.known = Known(self.lists, most=1_000_000, short=Short())

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, first: int, parts: list[bytes]) -> None:
        tokenize, id_of, data = self.tokenizer.model.tokenize, attrgetter("id"), b"".join(parts)
        stops = np.cumsum([len(p) for p in parts])
        starts = stops - [len(p) for p in parts]
        # A letter a byte, of all parts at once; words of ASCII letters are found by their bytes.
        letters, read = charmap_decode(data, "strict", _ALPHABET)[0], np.frombuffer(data, np.uint8)
        begin = starts + (read[starts] == 0x20)
        others = np.concatenate(([0], np.cumsum(~_ASCII_LETTER[read])))
        words = (others[stops] == others[begin]) & (stops > begin)
        for at in np.flatnonzero(~words & (np.maximum.reduceat(read, starts) >= 0x80)):
            text = data[begin[at] : stops[at]].decode()
            words[at] = text.isalpha() and max(text) <= _LAST_LATIN
        rest = iter(self._encode([parts[at].decode() for at in np.flatnonzero(~words)]))
        # One flat list, as many small ones would keep the cyclic collector busy.
        flat, sizes = [], []
        for start, stop, word in zip(starts.tolist(), stops.tolist(), words.tolist(), strict=True):
            ids = [*map(id_of, tokenize(letters[start:stop]))] if word else next(rest)
            flat += ids
            sizes.append(len(ids))
        self.lists.put_flat(first, flat, sizes)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none null) one after the other, and where each text's start, with the end."""
        if self.splits:
            parts, before = parts_of(texts)
            ids, bounds = self.lists.take(self.known.rows(parts, self._encode_parts))
            return ids, bounds[before]
        found = self._encode(texts.to_pylist())
        return np.array([i for ids in found for i in ids], np.int32), np.cumsum([0, *map(len, found)])


@lru_cache(maxsize=2)
def load(file: str) -> Tokens:
    """The tokenizer of a file, once a worker."""
    return Tokens(file)


def write(docs: DataFrame, path: str, *, tokenizer_file: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends end_id and writes files below `path`, in ascending order of id over groups and within them.

    A null text has the end id only. Null ids come first; rows that repeat an id stand in order of their texts, repeated rows are all
    written. An empty table gives no group; other columns are not read. Ids of the tokenizer and end_id are below range_coder.IDS (65,536): a
    larger one stops the job with an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, partition, number = load(tokenizer_file), TaskContext.get().partitionId(), 0
        held, names, sizes, total = [], [], [], 0

        def group() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([group_record(partition, number, names, sizes, np.concatenate(held))], pa.binary())], names=["record"])

        for part in slices(batches, "text", _AT_ONCE):
            ids, starts = tokens.encode_all(part.column("text"))
            if (len(ids) and ids.max() >= range_coder.IDS) or not 0 <= end_id < range_coder.IDS:
                raise ValueError(f"the files hold ids below {range_coder.IDS}")
            with_end = np.insert(ids.astype(np.uint16), starts[1:], end_id)
            held.append(with_end)
            names += part.column("id").to_pylist()
            sizes += (np.diff(starts) + 1).tolist()
            total += len(with_end)
            if total >= GROUP:
                yield group()
                held, names, sizes, total, number = [], [], [], 0, number + 1
        if names:
            yield group()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    coded = ordered.mapInArrow(run, "record binary")
    coded.select(F.col("record").cast("string").alias("value")).write.option("lineSep", MARK.decode()).option("maxRecordsPerFile", GROUPS_A_FILE).text(path)


def read(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked for, ids) of each document of the files below `path`.

    start counts the ids of all documents before it; ids_crc32 is of its ids as little-endian unsigned 32-bit integers.
    """

    columns = ["part", "group", "doc_id", "offset", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for partition, number, docs, sizes, ids in groups_of(content.as_py()):
                    ends = np.cumsum(sizes)
                    for at in range(0, len(docs), 1024):
                        lo, hi = (ends - sizes)[at : at + 1024], ends[at : at + 1024]
                        some = [pa.array([v] * len(lo), pa.int64()) for v in (partition, number)]
                        some += [pa.array(docs[at : at + 1024], pa.int64()), pa.array(lo), pa.array(hi - lo), pa.array([zlib.crc32(ids[a:b]) for a, b in zip(lo, hi, strict=True)], pa.int64())]
                        if with_ids:
                            some.append(pa.ListArray.from_arrays(pa.array(np.append(lo, hi[-1]) - lo[0], pa.int32()), pa.array(ids[lo[0] : hi[-1]].astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(some, names=columns)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    schema = "part long, group long, doc_id long, offset long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    found = files.select("content").mapInArrow(run, schema)
    if not with_ids:
        found = materialise(found, "token-rows")
    # A row a partition in one window, and a row a group in those of the partitions.
    groups = found.groupBy("part", "group").agg(F.sum("n_tokens").alias("all"))
    parts = groups.groupBy("part").agg(F.sum("all").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before_part"))
    before = groups.join(parts, "part").select("part", "group", (F.col("before_part") + F.sum("all").over(Window.partitionBy("part").orderBy("group")) - F.col("all")).alias("before"))
    out = found.join(before, ["part", "group"]).withColumn("start", (F.col("before") + F.col("offset")).cast("long"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, *, tokenizer_file: str) -> DataFrame:
    """Writes documents to a new path of the shared folder and reads the files back, without the ids themselves.

    Nulls, repeats and other columns are as in `write`; an empty table gives an empty one.
    """
    path = scratch_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_file=tokenizer_file)
    return read(docs.sparkSession, path, with_ids=False)
