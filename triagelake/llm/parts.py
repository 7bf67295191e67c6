"""Texts as sequences of distinct parts, so that what depends on a part alone is computed once for each different one.

A text is cut before a space that follows other than white space, and before ASCII punctuation (but for the apostrophe) that
follows an ASCII letter. No word of letters goes on over such a place, and no piece of a byte-level BPE does. The parts
are views of Arrow's own buffer of the texts, and Arrow finds the distinct ones.
"""

from __future__ import annotations

import gc
import weakref
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, islice
from typing import ClassVar, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at once, about.
BATCH = 1 << 22
#: Distinct parts remembered at most, and the length in bytes from which one isn't.
REMEMBERED, LONG = 400_000, 64
_LETTER, _MARK, _SPACE = np.zeros(256, bool), np.zeros(256, bool), 0x20
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True
#: Byte pairs in which a character may end that is white space: those of U+0085, U+00A0, U+1680, U+2000 to U+203F and U+205F.
_MAY_BE_WHITE = np.zeros(1 << 16, bool)
_MAY_BE_WHITE[[0xC285, 0xC2A0, 0x9A80, 0x819F, *range(0x8000, 0x8100)]] = True


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of a text column at most (or one row), nulls in it as empty texts."""
    for part in cuts(batches, column, most):
        at = part.schema.get_field_index(column)
        yield part.set_column(at, part.schema.field(at), pc.fill_null(part.column(at), ""))


def cuts(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The batches in such slices as they are, with nulls."""
    for batch in filter(len, batches):
        ends, start = _offsets(batch.column(column)), 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)


def parts_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts (strings, none null) in order, as an array of binaries, and how many there are before each text and in all."""
    if not len(texts):
        return pa.array([], pa.binary()), np.zeros(1, np.int64)
    offsets = _offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts = (offsets - offsets[0]).astype(np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = _LETTER[data[:-1]] & _MARK[data[1:]]
    space = np.flatnonzero(data[1:] == _SPACE) + 1
    before = data[space - 1]
    pair = data[np.maximum(space - 2, 0)].astype(np.uint16) << 8 | before
    cut[space] = np.where(before < 0x80, (before > 0x20) & (before < 0x7F), ~_MAY_BE_WHITE[pair])
    cut[starts] = True
    cut[-1] = False
    first = np.flatnonzero(cut).astype(np.int32)
    ends = np.append(first, np.int32(len(data)))
    parts = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return parts, np.searchsorted(first, starts)


class Lists:
    """Lists of numbers by row, in one flat array."""

    def __init__(self, kind: type):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.flat, self.ends = np.zeros(1 << 12, self.kind), np.zeros(1 << 10, np.int64)

    def put(self, row: int, lists: Sequence[Sequence[int]]) -> None:
        """Appends lists as rows from `row` on; later rows are forgotten."""
        self.put_flat(row, chain.from_iterable(lists), [len(x) for x in lists])

    def put_flat(self, row: int, flat: Iterable[int], sizes: Sequence[int]) -> None:
        """The same with the lists one after the other, and their sizes."""
        ends = self.ends[row] + np.cumsum(sizes)
        while row + len(sizes) >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.ends[row] : ends[-1]] = np.fromiter(flat, self.flat.dtype, int(ends[-1] - self.ends[row]))
        self.ends[row + 1 : row + 1 + len(sizes)] = ends

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of rows one after the other, and where each starts, with the end."""
        width, kind = self.flat.itemsize, pa.large_binary()
        lists = pa.Array.from_buffers(kind, len(self.ends) - 1, [None, pa.py_buffer(self.ends * width), pa.py_buffer(self.flat)])
        found = lists.take(pa.array(rows, pa.int64()))
        bounds = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8) // width
        return np.frombuffer(found.buffers()[2] or b"", self.flat.dtype, bounds[-1]), bounds


class Clearable(Protocol):
    def clear(self) -> None: ...


class Short:
    """Numbers of parts of up to 7 bytes by these bytes and their count as one number, each in one place of a table, from which another may push it.

    Numpy looks many up at once; the parts that aren't found are for a dict.
    """

    _MIX, _KEPT = np.uint64(0x9E3779B97F4A7C15), np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)
    _SIZE = np.array([n << 56 for n in range(8)], np.uint64)

    def __init__(self, bits: int = 20):
        self.shift, self.keys, self.rows = np.uint64(64 - bits), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def keys_of(self, parts: pa.Array) -> np.ndarray:
        """The number that stands for each part, 0 for longer ones."""
        offsets = _offsets(parts)
        data = np.frombuffer((parts.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[offsets[0] : offsets[-1]] + bytes(8), np.uint8)
        sizes = np.diff(offsets)
        sizes[sizes > 7] = 0
        keys = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))[offsets[:-1] - offsets[0]]
        keys &= self._KEPT.take(sizes)
        keys |= self._SIZE.take(sizes)
        return keys

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each part, -1 if it isn't found."""
        at = (keys * self._MIX >> self.shift).view(np.int64)
        return np.where((self.keys.take(at) == keys) & (keys != 0), self.rows.take(at), -1)

    def put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        keys, rows = keys[keys != 0], rows[keys != 0]
        at = (keys * self._MIX >> self.shift).view(np.int64)
        self.rows[at], self.keys[at] = rows, keys

    def forget(self, kept: int) -> None:
        """Numbers from `kept` on stand for nothing."""
        self.keys[self.rows >= kept] = 0


class Known(dict):
    """Parts met so far by number. When too many are known the later half is forgotten, as frequent ones were met early; so are long ones, once used.

    A worker goes on to other operators' tasks, so only the memory used last is kept in a process: another that is used empties it, with what is
    held `beside` it by part. Nothing here refers to its owner, so that a memory goes as soon as its owner does.
    """

    _last: ClassVar[weakref.ref | None] = None

    def __init__(self, *beside: Clearable, most: int = REMEMBERED, short: Short | None = None):
        super().__init__()
        self.beside, self.most, self.kept, self.short = beside, most, 0, short

    def empty(self) -> None:
        self.clear()
        self.kept = 0
        if self.short is not None:
            self.short.forget(0)
        for held in self.beside:
            held.clear()

    def _alone(self) -> None:
        last = Known._last() if Known._last is not None else None
        if last is not self:
            if last is not None:
                last.empty()
            Known._last = weakref.ref(self)
            gc.collect()
            pa.default_memory_pool().release_unused()

    def forget(self, kept: int) -> None:
        for part in list(islice(self, kept, None)):
            del self[part]
        self.kept = kept
        if self.short is not None:
            self.short.forget(kept)

    def rows(self, parts: pa.Array, make: Callable[[int, list[bytes]], None]) -> np.ndarray:
        """The number of each part. `make(first, new)` is called for new ones, which get the numbers from `first` on."""
        self._alone()
        if len(self) > self.kept or self.kept > self.most:
            self.forget(self.kept if self.kept <= self.most else self.most // 2)
        if self.short is None:
            return self._rows(parts, make)
        keys = self.short.keys_of(parts)
        rows = self.short.find(keys)
        missed = np.flatnonzero(rows < 0)
        if len(missed):
            own = rows[missed] = self._rows(parts.take(pa.array(missed)), make)
            self.short.put(keys[missed], own)
        return rows

    def _rows(self, parts: pa.Array, make: Callable[[int, list[bytes]], None]) -> np.ndarray:
        coded = parts.dictionary_encode()
        bounds, data = _offsets(coded.dictionary).tolist(), (coded.dictionary.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        found = list(map(data.__getitem__, map(slice, bounds, bounds[1:])))
        rows = list(map(self.get, found))
        if None in rows:
            new = [p for p, row in zip(found, rows, strict=True) if row is None]
            new.sort(key=lambda p: len(p) >= LONG)
            first = len(self)
            make(first, new)
            self.update(zip(new, range(first, first + len(new)), strict=True))
            self.kept = first + sum(len(p) < LONG for p in new)
            rows = list(map(self.__getitem__, found))
        return np.array(rows, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
