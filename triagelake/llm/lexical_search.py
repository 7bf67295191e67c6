"""Ranked lexical search over an inverted index in segments.

A segment holds whole documents, about `SEGMENT` bytes of text of one input partition, numbered by ascending doc_id. Each of its terms has
one row: the numbers of its documents as differences, with its occurrences there, in variable-length bytes. Building it needs no shuffle.
Of the index a search reads the rows of the items' terms. Segment by segment and in blocks of items, the postings of an item's terms are merged document by
document through a heap of cursors, into a heap of the best results by score, then doc_id; the best of all segments are merged at the end.

Terms that cannot lift a document above the worst result held are taken out of the merge and only looked up: the results are the same, and
frequent words cost little.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush, heapreplace
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.common import materialise
from triagelake.llm.parts import slices

#: Terms are the longest runs of ASCII letters, digits and everything beyond ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text in a segment, about, and items searched together, about.
SEGMENT, BLOCK = 1 << 24, 256
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_IN_TERM, _LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER[0x41:0x5B] += 0x20
_INDEX = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("postings", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_terms", pa.list_(pa.int64()))])
_INDEX_DDL = "segment long, term string, n long, postings binary, doc_ids array<long>, doc_terms array<long>"


def terms_of(texts: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
    """All terms of texts (none null) in order, as strings, and the number of the text of each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    inside = _IN_TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # Where one text ends and the next begins a term ends too.
    edge = np.unique(bounds[(bounds > 0) & (bounds < len(data))])
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    del first, last
    sizes = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts))).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(_LOWER[data[inside]])])
    return terms, np.searchsorted(bounds, starts, side="right") - 1


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of 7 bits, the lowest first, all but a number's last with the high bit set; and where each begins, with the end."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        sizes += values >= 1 << bits
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    out = np.zeros(at[-1], np.uint8)
    left, place, rest = np.arange(len(values)), at[:-1].copy(), values.astype(np.int64)
    while len(left):
        more = rest >= 128
        out[place] = (rest & 127) | (more << 7)
        left, place, rest = left[more], place[more] + 1, rest[more] >> 7
    return out, at


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))
    shift = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * shift, starts) if len(raw) else np.zeros(0, np.int64)


def _segment(number: int, ids: pa.Array, texts: pa.StringArray) -> Iterator[pa.RecordBatch]:
    """The rows of a segment: its documents first (no term; n of them have terms), then a row for each term, in batches."""
    blank = np.asarray(ids.is_null())
    order = np.lexsort((np.asarray(ids.fill_null(0)), blank))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    terms, of = terms_of(texts)
    lengths = np.bincount(place[of], minlength=len(order))
    head = [[number], [None], [int((lengths > 0).sum())], [None], [ids.take(pa.array(order[: len(ids) - ids.null_count])).to_pylist()], [lengths.tolist()]]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(head, _INDEX.types, strict=True)], schema=_INDEX)
    coded = terms.dictionary_encode()
    both, counts = np.unique(np.asarray(coded.indices).astype(np.int64) * len(order) + place[of], return_counts=True)
    del of, terms
    codes, docs = np.divmod(both, max(len(order), 1))
    del both
    fresh = np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]))
    steps = np.where(fresh, docs, docs - np.concatenate((docs[:1], docs[:-1])))
    data, at = pack(np.stack((steps, counts), 1).ravel())
    del steps, docs, counts
    begins = np.flatnonzero(fresh)
    sizes = np.diff(np.append(begins, len(codes)))
    postings = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(np.append(at[::2][begins], at[-1]).astype(np.int32)), pa.py_buffer(data)])
    columns = [pa.array(np.full(len(begins), number)), coded.dictionary.take(pa.array(codes[begins])), pa.array(sizes), postings, *(pa.nulls(len(begins), t) for t in _INDEX.types[4:])]
    whole = pa.RecordBatch.from_arrays(columns, schema=_INDEX)
    for start in range(0, len(whole), 1 << 16):
        yield whole.slice(start, 1 << 16)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in slices(batches, "text"):
        held.append(batch)
        size += _bytes(batch.column("text"))
        if size >= SEGMENT:
            yield from _segment(number, *_joined(held))
            number, held, size = number + 1, [], 0
    if held:
        yield from _segment(number, *_joined(held))


def _bytes(texts: pa.StringArray) -> int:
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    return int(offsets[-1] - offsets[0])


def _joined(batches: list[pa.RecordBatch]) -> tuple[pa.Array, pa.StringArray]:
    return tuple(pa.concat_arrays([b.column(name) for b in batches]) for name in ("doc_id", "text"))


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index of all rows, to be written: (segment, term, n, postings), n documents of the segment have the term; and a row without
    term for each segment, with doc_ids (but for the null ones, which are last) and doc_terms (terms with repeats) by number, n of them with terms.

    Whole texts are read, a null text has no terms. Rows that repeat an id are documents of their own. Other columns aren't read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_indexed, _INDEX_DDL)


def best(lists: Sequence[tuple[int, list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """The k documents of highest score, above 0, of postings (largest gain, ascending documents, gains): (score, document), of equal scores the smallest."""
    lists = sorted(lists, key=lambda x: x[0])
    tops, docs, gains = ([x[i] for x in lists] for i in range(3))
    most = list(accumulate(tops))  # what the lists up to each give at most
    at, merged_from, worst = [0] * len(lists), 0, 0
    cursors, results = [(d[0], i) for i, d in enumerate(docs)], []
    heapify(cursors)
    while cursors:
        doc, score = cursors[0][0], 0
        while cursors and cursors[0][0] == doc:
            i = cursors[0][1]
            score += gains[i][at[i]]
            at[i] += 1
            if at[i] < len(docs[i]):
                heapreplace(cursors, (docs[i][at[i]], i))
            else:
                heappop(cursors)
        for i in range(merged_from - 1, -1, -1):
            if score + most[i] <= worst:
                break
            at[i] = p = bisect_left(docs[i], doc, at[i])
            if p < len(docs[i]) and docs[i][p] == doc:
                score += gains[i][p]
        if score <= worst:
            continue
        (heappush if len(results) < k else heapreplace)(results, (score, -doc))
        if len(results) == k and results[0][0] > worst:
            worst = results[0][0]
            if merged_from < len(lists) and most[merged_from] <= worst:
                while merged_from < len(lists) and most[merged_from] <= worst:
                    merged_from += 1
                cursors = [c for c in cursors if c[1] >= merged_from]
                heapify(cursors)
    return [(score, -doc) for score, doc in results]


def _searcher(n_docs: int, n_terms: int, k: int):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        """The best of one segment for the items of one block."""
        head = rows[rows["term"].isna()].iloc[0]
        ids, lengths = head["doc_ids"], np.asarray(head["doc_terms"], np.int64)
        spread = 100 - 50 + 50 * lengths * n_docs // max(n_terms, 1)
        lists: dict[int | None, list] = {}
        for weight, postings, items in rows.loc[rows["term"].notna(), ["weight", "postings", "items"]].itertuples(index=False):
            values = unpack(postings).reshape(-1, 2)
            docs, tf = np.cumsum(values[:, 0]), values[:, 1]
            gains = int(weight) * (1_000_000_000 * tf // (1000 * tf + 20 * spread[docs]))
            one = (int(gains.max()), docs.tolist(), gains.tolist())
            for item in items:
                lists.setdefault(item["item_id"], []).append(one)
        found = [(item, int(ids[doc]) if doc < len(ids) else None, score) for item, own in lists.items() for score, doc in best(own, k)]
        return pd.DataFrame({name: pd.array([row[i] for row in found], "Int64") for i, name in enumerate(("item_id", "doc_id", "score"))})

    return search


def search(indexed: DataFrame, items: DataFrame, *, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score for each item, equal scores by ascending doc_id, null ids last.

    `indexed` is an index that was written and is read back. An item's terms count once each; rows that repeat an item_id are one item,
    null is an id like another. Items without terms, or whose terms no document has, have no rows. A term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))),
    a document of n terms scores the sum of w * (10^9 tf div (1000 tf + 20 m)) with m = 50 + 50 n N div L, in whole numbers.
    """
    found = F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _UPPER.lower()), F.lit(TERM), 0)
    wanted = materialise(items.select(F.col(item_col).cast("long").alias("item_id"), F.explode(F.array_distinct(found)).alias("term")).distinct(), "search-terms")
    docs = indexed.filter("term IS NULL")
    n_docs, n_terms = docs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.aggregate("doc_terms", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    blocks = -(-wanted.select("item_id").distinct().count() // BLOCK)
    if not n_docs or not blocks:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    postings = indexed.filter("term IS NOT NULL").join(wanted.select("term").distinct(), "term", "left_semi")
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.sum("n") + 1))).cast("long")
    weights = postings.groupBy("term").agg(weight.alias("weight")).filter("weight > 0")
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")
    asked = wanted.groupBy(block, "term").agg(F.collect_list(F.struct("item_id")).alias("items")).join(weights, "term")
    # One copy of a term's postings goes to each block of items, with the list of those in it that have the term.
    rows = postings.select("segment", "term", "postings").join(asked, "term").select("segment", "block", "term", "weight", "postings", "items")
    heads = docs.select("segment", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "doc_ids", "doc_terms")
    scored = rows.unionByName(heads, allowMissingColumns=True).groupBy("segment", "block").applyInPandas(_searcher(n_docs, n_terms, k), "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
