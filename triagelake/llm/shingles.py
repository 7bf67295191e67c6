"""Hashed word shingles and minwise sketches, vectorised over the bytes of a text."""

from __future__ import annotations

import numpy as np

WORDS_PER_SHINGLE = 5
#: Coordinates of a sketch.
SKETCH = 128
_RNG = np.random.default_rng(20240521)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_PLACE = _RNG.integers(1, 2**63, WORDS_PER_SHINGLE, dtype=np.uint64) | np.uint64(1)
_FACTOR = _RNG.integers(1, 2**32, SKETCH, dtype=np.uint32) | np.uint32(1)
_SHIFT = _RNG.integers(0, 2**32, SKETCH, dtype=np.uint32)
#: Bytes hashed at once; a longer text is cut at white space.
CHUNK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to a power of two of at least n."""
    size = max(1 << 12, 1 << (n - 1).bit_length())
    if size not in _powers:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            both.append(np.multiply.accumulate(table))
        if size > CHUNK * 2:
            return both[0], both[1]
        _powers[size] = (both[0], both[1])
    return _powers[size]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each run of non-white bytes, without regard to the case of A-Z."""
    found, start = [], 0
    while start < len(data):
        end = min(len(data), start + CHUNK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        b = np.frombuffer(data, np.uint8, end - start, start)
        start = end
        edge = np.diff(np.concatenate(([0], (~_SPACE[b]).view(np.int8), [0])))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(first):
            continue
        power, inverse = _power_tables(len(b))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * power[: len(b)], dtype=np.uint64)))
        found.append(mixed((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of all words as one with fewer than five; none without words."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    width = min(WORDS_PER_SHINGLE, len(words))
    count = len(words) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out += words[k : k + count] * _PLACE[k]
    return np.unique(mixed(out))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The smallest 32-bit hash of the set under each of SKETCH hash functions."""
    best, short = np.full(SKETCH, 0xFFFFFFFF, np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 256):
        part = short[at : at + 256, None] * _FACTOR
        part += _SHIFT
        np.minimum(best, part.min(axis=0), out=best)
    return best
