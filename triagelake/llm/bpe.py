"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its encoding. `Prefixes` stores that token
for each prefix: the encoding is read off backwards, appending goes on from the last prefix, and after an edit only the
prefixes up to where the table falls in with the old one again are computed anew.

A token may follow another if merging the two together again parts them at the same place. `Vocabulary.fits` decides
that by taking both tokens' merges back from the latest to the earliest: no pair across the border may be mergeable
before the merges that closed it in.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.parts import Known, Lists, parts_of, slices


class Vocabulary:
    """Ranks of a byte-level BPE: the bytes of each token, and how it was merged."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.size = {r: len(b) for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self.known_fits: dict[tuple[int, int], bool] = {}
        self._automaton = ahocorasick.Automaton()
        self.made = {b: r for b, r in ranks.items() if len(b) == 1 or self.halves(r) is not None}
        for data, token in self.made.items():
            self._automaton.add_word(data.decode("latin-1"), (len(data), token))
        self._automaton.make_automaton()

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and tokens that merging never makes."""
        if token not in self._halves:
            data, ranks = self.bytes[token], self.ranks
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best, at = min((ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1))
                if best >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes together is these two tokens."""
        key = (left, right)
        known = self.known_fits.get(key)
        if known is None:
            if len(self.known_fits) > 400_000:
                self.known_fits.clear()
            known = self.known_fits[key] = self._check(left, right)
        return known

    def _check(self, left: int, right: int) -> bool:
        # Times of merges are ranks. `until`: the border's neighbours as they stand now exist only before that time, and
        # of two merges of one rank the one further left comes first.
        until = float("inf")
        while True:
            across = self.ranks.get(self.bytes[left] + self.bytes[right])
            if across is not None and across < until:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                until, left = left, a[1]
            else:
                until, right = right + 0.5, b[0]

    def matches(self, text: str, start: int) -> Iterator[tuple[int, tuple[int, int]]]:
        """(end - 1, (length, token)) of the tokens within text[start:], bytes as characters: by end, longest first."""
        return self._automaton.iter(text, start)


class Prefixes:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _extend(self, text: str, last: list[int], until: Callable[[int], bool] | None = None) -> None:
        """Appends the last token of each further prefix of `text` to `last`, as long as `until` of it doesn't say that this is enough."""
        known, fits = self.vocabulary.known_fits, self.vocabulary.fits
        end, put = len(last), last.append
        for at, (length, token) in self.vocabulary.matches(text, max(0, end - self.vocabulary.longest)):
            if at != end:
                if at < end:
                    continue
                break
            if length <= at:
                pair = (last[at - length], token)
                good = known.get(pair)
                if not (fits(*pair) if good is None else good):
                    continue
            put(token)
            end += 1
            if until is not None and until(token):
                return
        if end < len(text):
            raise ValueError(f"the vocabulary has no token that ends {text[: end + 1][-20:]!r}")

    def append(self, data: bytes) -> None:
        self.data += data
        self._extend(self.data.decode("latin-1"), self.last)

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Puts `data` in place of bytes start to stop; returns how many prefixes were computed."""
        old, changed = self.last, self.data[:start] + data + self.data[stop:]
        last, same, done = old[:start], 0, 0
        shift = len(data) - (stop - start)

        def until(token: int) -> bool:
            nonlocal same, done
            done += 1
            end = len(last)
            same = same + 1 if end > start + len(data) and token == old[end - 1 - shift] else 0
            return same >= self.vocabulary.longest

        self._extend(changed.decode("latin-1"), last, until)
        if len(last) < len(changed):
            last.extend(old[len(last) - shift :])
        self.data, self.last = changed, last
        return done

    def tokens(self) -> list[int]:
        out, at, last, size = [], len(self.data), self.last, self.vocabulary.size
        while at:
            token = last[at - 1]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out


class Encoder:
    """Text to ids and back. Parts of texts that repeat (see parts) are encoded once, by pieces of the pattern."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.lists = Lists(np.int32)
        self.known = Known(self.lists, vocabulary.known_fits)
        self._bytes = Lists(np.uint8)
        self._bytes.put(0, [vocabulary.bytes.get(i, b"") for i in range(max(vocabulary.bytes) + 1)])
        self._is_token = np.array([i in vocabulary.bytes for i in range(max(vocabulary.bytes) + 1)])

    def encode_piece(self, piece: str) -> Sequence[int]:
        data = piece.encode()
        token = self.vocabulary.made.get(data)
        return (token,) if token is not None else Prefixes(self.vocabulary, data).tokens()

    def _encode_parts(self, first: int, parts: list[bytes]) -> None:
        self.lists.put(first, [[i for piece in self.split(part.decode()) for i in self.encode_piece(piece)] for part in parts])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none null) one after the other, and where each text's start, with the end."""
        parts, before = parts_of(texts)
        ids, bounds = self.lists.take(self.known.rows(parts, self._encode_parts))
        return ids, bounds[before]

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text]))[0].tolist()

    def decode_all(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after the other, and where those of each run of ids start; an id that the vocabulary lacks is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self._is_token) or not self._is_token[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        data, bounds = self._bytes.take(ids)
        return data, bounds[starts]

    def decode(self, ids: Sequence[int]) -> bytes:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes()


@lru_cache(maxsize=2)
def load(ranks_file: str, pattern: str) -> Encoder:
    """The encoder of a rank file (base64 token and rank on each line), once a worker."""
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return Encoder(Vocabulary(ranks), pattern)


def encode_documents(docs: DataFrame, *, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each whole text, in an array. A null text counts as empty and has no ids.

    `ranks_file` is read on the executors, where the tokenizer is installed. No match of `pattern` may go on from other than white
    space to a space, nor from an ASCII letter to ASCII punctuation but for the apostrophe. Rows that repeat an id are
    all answered; an empty table gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(ranks_file, pattern)
        for part in slices(batches, "text"):
            ids, starts = encoder.encode_all(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, *, ranks_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) to (id, ids, decoded): the bytes that the ids stand for. An id that the vocabulary lacks is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(ranks_file, pattern)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                ids = part.column("ids")
                starts = ids.offsets.to_numpy()
                data, bounds = encoder.decode_all(ids.flatten().to_numpy(), starts - starts[0])
                decoded = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column("id"), ids, decoded], names=["id", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, *, ranks_file: str, pattern: str) -> DataFrame:
    """Encodes and decodes documents: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty. Repeated rows are all answered; an empty table gives an empty one; texts of any length are encoded whole; other
    columns are not read, whatever their names.
    """
    done = decode_documents(encode_documents(docs, ranks_file=ranks_file, pattern=pattern), ranks_file=ranks_file, pattern=pattern)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
