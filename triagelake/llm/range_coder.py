"""An adaptive context-mixing range coder for token ids.

Ids are coded in blocks that start from nothing each and carry a checksum. A block is cut into STRANDS runs of ids of about equal length, which
are coded side by side, an id of each in a step, and learn together: they share all that the block knows. Within a block an id is known by its
slot, the number of different ids that came before its first appearance in order of steps (an id that is new in two strands of a step gets two).
Three predictions are mixed:

* order 2 and order 1 foretell the slot that last followed their context, with a confidence that grows as they are right;
* order 0 gives each slot its frequency in the block so far (as of the last refresh; 1 for slots that are newer).

The mix is w2 [s = p2] + w1 [s = p1] + w0 f(s), and the rest is for an id that the block has not had. The weights are learnt, a set
for each pair of confidences and agreement of the two. The new ids of a block, in order, are a stream of their own: they are coded by a
fixed law that falls with their rank, as the frequencies of a BPE's ids do, and no other step needs to know them. As the law is fixed, it is that of
a code of 256 classes of ids, about as likely each: a byte for the class, and then the bits that tell its ids apart.

All strands of a batch of blocks are coded in step, each a lane with digits of its own, so that numpy does the work. Ranges are
doubles that hold integers below 2^50: sums, products and quotients once rounded down are exact.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Ids of a block.
BLOCK = 4096
#: Ids are below this.
IDS = 1 << 16
#: Strands of a block, and blocks coded in step at most.
STRANDS, AT_ONCE = 8, 512
#: Steps of a block at which order 0 is counted anew.
REFRESH = frozenset(n // STRANDS for n in (64, 384, 1280, 2688))
_ONE = 1 << 15
#: Weights of order 2, 1 and 0 at first, 16 bits each. At each use they lose 1 / 2^_RATE, and what was right (or a new id) gains the most.
_LEAST, _RATE = 256, 5
_MOST = _ONE - 4 * _LEAST
_FIRST = np.array([_ONE // 4, _ONE // 8, _ONE // 4, 0], np.int16).view(np.int64)
_GAINS = np.array([[(_MOST if i == k else _LEAST) >> _RATE for i in range(3)] + [0] for k in range(4)], np.int16).view(np.int64).ravel()
_LOSS = int(np.full(4, (1 << 16 - _RATE) - 1, np.int16).view(np.int64)[0])
#: Three numbers of 15 bits in one of 64: sums of the first one, two and three; the bits above each; all bits.
_SUMS, _ABOVE, _THREE = 0x0001_0001_0001, 0x8000_8000_8000, (1 << 48) - 1
#: A range is at least _LOW after each id, and below _TOP; digits have 16 bits.
_LOW, _TOP, _DIGIT = 2.0**32, 2.0**48, 2.0**16
_STRIDE = BLOCK + 2
#: Of a coded block: ids, digits of slots (before them, how many those of each strand but the last are), pairs of bytes of new ids, checksum.
_HEAD = struct.Struct("<HHHI")


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First id and bits of each class of new ids, and the class of each id: halves of halves of all ids, by the law 1 / (id + 64) the likeliest cut first."""
    law = np.concatenate(([0], np.cumsum((1 << 22) // (np.arange(IDS, dtype=np.int64) + 64)))).tolist()
    heap = [(-law[IDS], 0, IDS)]
    while len(heap) < 256:
        _, first, size = heapq.heappop(heap)
        half = size // 2
        for at in (first, first + half):
            # One id is not cut.
            heapq.heappush(heap, (law[at] - law[at + half] if half > 1 else 1, at, half))
    firsts, sizes = map(np.array, zip(*sorted(x[1:] for x in heap), strict=True))
    return firsts, np.log2(sizes).astype(np.int64), np.repeat(np.arange(256), sizes).astype(np.uint8)


_CLASS_FIRST, _CLASS_BITS, _CLASS = _classes()
ORDER_2, ORDER_1, ORDER_0, NEW = range(4)
#: What a follower's entry gains by its confidence, when it was wrong and when it was right.
_TRUST = np.array([0, -1, -1, -1, 1, 1, 1, 0])
#: A byte of each strand of a block as one number, and what gives sums over the strands before each, and over all in the highest byte.
_BYTES = np.dtype(f"<u{STRANDS}")
_ALL = _BYTES.type(int.from_bytes(bytes([1]) * STRANDS, "little"))
_EARLIER, _LAST = _BYTES.type(int(_ALL) - 1), _BYTES.type(8 * STRANDS - 8)


class _Model:
    """The state of every lane. `predict` lays out a step's range, `learn` takes its slots, `interval` places what was coded."""

    def __init__(self, blocks: int, *, finds: bool):
        """finds: whether `find` will be called; else slot_at isn't kept."""
        self.blocks, self.finds = blocks, finds
        block = np.repeat(np.arange(blocks, dtype=np.int64), STRANDS)
        self.base, self.row, self.lane = block * _STRIDE, block * 32, np.arange(len(block))
        #: Of each slot what followed it, slot * 4 + confidence, in the lowest 16 bits, in the next its first place in order 0 and in the next how many
        #: it has. Of each context of order 2 what followed it.
        self.one, self.two = np.zeros(blocks * _STRIDE, np.int64), np.zeros(blocks * _STRIDE, np.uint16)
        #: Order 0: slot of each place, and counts since the block began.
        self.slot_at, self.counts = (np.zeros(blocks * _STRIDE if kept else 0, np.uint16) for kept in (finds, True))
        #: Slots of a lane's block and how many places they have; a slot newer than the last refresh has one, so many after its number.
        self.known, self.shift = np.zeros((2, len(block)), np.int64)
        # There is a place before there is a slot, so that there is something to divide by.
        self.total = np.ones(len(block))
        self.weights = np.repeat(_FIRST, blocks * 32)
        self.last, self.before, self.at, self.here = np.zeros_like(block), np.zeros_like(block), self.base, np.zeros_like(block)
        self._room()

    def _room(self) -> None:
        lanes = self.blocks * STRANDS
        self.entry, self.wide, self.choice = np.empty((2, lanes), np.int64), np.empty(lanes, np.uint16), np.empty((4, lanes), np.int64)

    def narrow(self, blocks: int) -> None:
        """Goes on with the first blocks only."""
        self.blocks = blocks
        for name in ("base", "row", "lane", "known", "shift", "total", "last", "before", "at", "here"):
            setattr(self, name, getattr(self, name)[: blocks * STRANDS])
        self._room()

    def predict(self, span: np.ndarray) -> None:
        """The parts of the range `span`: order 2's slot, order 1's, order 0 (a unit for each place), a new id."""
        entry = self.entry
        np.bitwise_and(self.here, 0xFFFF, out=entry[0])
        at2 = self.last * 0x9E5
        at2 += self.before
        at2 &= BLOCK - 1
        at2 += self.base
        self.at2 = at2
        entry[1] = self.two.take(at2, out=self.wide, mode="clip")
        self.trust = entry & 3
        mix = self.trust[1] << 2
        mix += self.trust[0]
        mix <<= 1
        mix += (entry[0] ^ entry[1]) < 4
        mix += self.row
        self.mix, self.w = mix, self.weights.take(mix, mode="clip")
        # Where parts 1 to 3 start, of _ONE.
        self.ends = self.w * _SUMS
        self.ends &= _THREE
        r = span * (1 / _ONE)
        self.r = np.floor(r, out=r)
        unit = (self.w >> 32).astype(np.float64)
        unit *= r
        unit /= self.total
        self.unit = np.floor(unit, out=unit)

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which part holds `value`, and the slot it stands for."""
        share = (value / self.r).astype(np.int64)
        np.minimum(share, _ONE - 1, out=share)
        share *= _SUMS
        share |= _ABOVE
        share -= self.ends
        share &= _ABOVE
        part = np.bitwise_count(share).astype(np.int64)
        place = (self.ends >> 16 & 0xFFFF).astype(np.float64)
        place *= self.r
        np.subtract(value, place, out=place)
        place /= self.unit
        np.fmin(place, self.total - 1, out=place)
        at = np.maximum(place, 0, out=place).astype(np.int64)
        at += self.base
        choice = self.choice
        np.right_shift(self.entry[::-1], 2, out=choice[:2])
        choice[2] = self.slot_at.take(at, out=self.wide, mode="clip")
        earlier = ((part == NEW).view(_BYTES) * _EARLIER).view(np.uint8)
        np.add(self.known, earlier, out=choice[3])
        return part, choice.ravel().take(part * len(part) + self.lane, mode="clip")

    def part_of(self, slot: np.ndarray) -> np.ndarray:
        """The part in which a slot is coded."""
        order1, order2 = ((self.entry ^ slot << 2) < 4).view(np.int8)
        part = (np.int8(ORDER_0) - order1) * (np.int8(1) - order2)
        return (part | (slot >= self.known).view(np.int8) * np.int8(NEW)).astype(np.int64)

    def learn(self, part: np.ndarray, slot: np.ndarray) -> None:
        """Takes the slots of a step and the parts they are in. Where two strands change the same entry, the later one's change stays."""
        w = self.w
        loss = w >> _RATE
        loss &= _LOSS
        w -= loss
        w += _GAINS.take(part, mode="clip")
        self.weights[self.mix] = w
        # An entry that was right gains confidence; one that was wrong loses it, or without any goes over to the slot.
        entry, follower = self.entry, slot << 2
        change = entry ^ follower
        kind = self.trust
        kind += (change < 4) * 4
        change *= kind == 0
        entry ^= change
        entry += _TRUST.take(kind, mode="clip")
        self.two[self.at2] = entry[1].astype(np.uint16)
        self.here &= ~0xFFFF
        self.here |= entry[0]
        self.one[self.at] = self.here
        self.at, fresh = slot + self.base, part == NEW
        new = np.flatnonzero(fresh)
        if len(new):
            own = slot[new]
            place = own + self.shift[new]
            self.one[self.at[new]] = (place << 16) + (1 << 32)
            if self.finds:
                self.slot_at[self.base[new] + place] = own
            count = ((fresh.view(_BYTES) * _ALL >> _LAST) * _ALL).view(np.uint8)
            self.known += count
            np.add(self.known, self.shift, out=self.total, casting="unsafe")
        self.here = self.one.take(self.at, mode="clip")
        self.before, self.last = self.last, slot

    def interval(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the range the learnt slots' intervals start and how long they are."""
        bits = part << 4
        first = self.ends << 16
        first >>= bits
        first &= 0xFFFF
        end = self.ends | -1 << 63
        end >>= bits
        end &= 0xFFFF
        end -= first
        start, size = first * self.r, end * self.r
        # Of order 0, its slot's share of the part; of others, the part.
        order0 = part == ORDER_0
        place = (self.here >> 16 & 0xFFFF).astype(np.float64)
        place *= self.unit
        place *= order0
        start += place
        return start, np.where(order0, (self.here >> 32) * self.unit, size)

    def refresh(self, slots: np.ndarray, done: int) -> None:
        """Counts order 0 anew from the slots of all `done` steps of each lane; `slots` are those since the last time, (steps, lanes)."""
        n, most, done = self.blocks * _STRIDE, int(self.known.max()), done * STRANDS
        counts, one = (x[:n].reshape(self.blocks, _STRIDE)[:, :most] for x in (self.counts, self.one))
        counts += np.bincount((slots + self.row // 32 * most).ravel(), minlength=self.blocks * most).reshape(self.blocks, most).astype(np.uint16)
        one &= 0xFFFF
        one |= np.cumsum(counts, axis=1, dtype=np.int64) - counts << 16
        one |= counts.astype(np.int64) << 32
        if self.finds:
            kinds = np.broadcast_to(np.arange(most, dtype=np.uint16), (self.blocks, most))
            self.slot_at[:n].reshape(self.blocks, _STRIDE)[:, :done] = np.repeat(kinds.ravel(), counts.ravel()).reshape(self.blocks, done)
        self.total[:], self.shift = done, done - self.known
        self.here = self.one.take(self.at, mode="clip")


class _Writer:
    """The ranges of every lane, and the digits that they give out: rows of digits with those lanes that they are of."""

    def __init__(self, lanes: int):
        self.low, self.span, self.rows = np.zeros(lanes), np.full(lanes, _TOP), []

    def code(self, start: np.ndarray, size: np.ndarray) -> None:
        """Goes on, in as many lanes as there are sizes, with these intervals of the ranges."""
        low = self.low[: len(size)]
        low += start
        while True:
            small = size < _LOW
            digit, given = np.floor(low * (1 / _LOW)), small.astype(np.float64)
            self.rows.append((digit.astype(np.int32), small))
            digit *= given
            digit *= _LOW
            low -= digit
            given *= _DIGIT - 1
            given += 1
            low *= given
            size *= given
            if size.min() >= _LOW:
                break
        self.span[: len(size)] = size

    def finish(self) -> list[np.ndarray]:
        """The digits of each lane."""
        lanes = len(self.low)
        # Every range holds a multiple of _LOW: one digit, as readers take zeros after the last.
        self.rows.append((np.ceil(self.low * (1 / _LOW)).astype(np.int32), np.ones(lanes, bool)))
        digits, given = np.zeros((lanes, len(self.rows)), np.int32), np.zeros((lanes, len(self.rows)), bool)
        for at in range(0, len(self.rows), 64):
            # Some rows at a time, so that turning them stays in the cache; rows get shorter as lanes end.
            some = self.rows[at : at + 64]
            block, mask = np.zeros((len(some), lanes), np.int32), np.zeros((len(some), lanes), bool)
            for i, (row, of) in enumerate(some):
                block[i, : len(row)], mask[i, : len(row)] = row, of
            digits[:, at : at + len(some)], given[:, at : at + len(some)] = block.T, mask.T
        ends = np.cumsum(np.count_nonzero(given, axis=1))
        digits = digits[given]
        # Digits of more than 16 bits carry into the one before, never out of a lane.
        while len(over := np.flatnonzero(digits >> 16)):
            carry = digits[over] >> 16
            digits[over] &= 0xFFFF
            digits[over - 1] += carry
        return np.split(digits.astype(">u2"), ends[:-1])


class _Reader:
    """The ranges of every lane, and where in them the next ids are."""

    def __init__(self, digits: list[np.ndarray]):
        lanes, width = len(digits), max(map(len, digits)) + 8
        rows = np.zeros((lanes, width), np.uint16)
        for row, some in zip(rows, digits, strict=True):
            row[: len(some)] = some
        self.digits, self.value, self.span, self.used = rows.ravel(), rows[:, :3] @ np.array([_LOW, _DIGIT, 1]), np.full(lanes, _TOP), np.arange(lanes, dtype=np.int64) * width + 3

    def code(self, start: np.ndarray, size: np.ndarray) -> None:
        """Goes on, in as many lanes as there are sizes, with these intervals of the ranges."""
        value, used = self.value[: len(size)], self.used[: len(size)]
        value -= start
        while True:
            small = size < _LOW
            # Damaged blocks may ask for more digits than there are.
            given, digit = small.astype(np.float64), self.digits.take(used, mode="clip").astype(np.float64)
            used += small
            digit *= given
            given *= _DIGIT - 1
            given += 1
            size *= given
            value *= given
            value += digit
            if size.min() >= _LOW:
                break
        self.span[: len(size)] = size


def _bits_at(bits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the bits of each new id start, and how many bytes those of each block take, which start at a byte."""
    ends = np.concatenate(([0], np.cumsum(bits)))
    stops = np.cumsum(sizes)
    base = ends[stops - sizes]
    length = ends[stops] - base + 7 >> 3
    return ends[:-1] + np.repeat(8 * (np.cumsum(length) - length) - base, sizes), length


def _encode_new(ids: list[np.ndarray]) -> list[bytes]:
    """Of each block the classes of its new ids, their bits, and a zero byte if the rest is odd."""
    sizes, every = np.array(list(map(len, ids))), np.concatenate(ids)
    kind = _CLASS.take(every)
    bits = _CLASS_BITS.take(kind)
    at, length = _bits_at(bits, sizes)
    # The bits of an id are 16 at most, so they lie in three bytes.
    window = every - _CLASS_FIRST.take(kind) << 24 - bits - (at & 7)
    at >>= 3
    packed = sum(np.bincount(at + i, window >> 16 - 8 * i & 255, int(length.sum()) + 3) for i in range(3)).astype(np.uint8)
    kinds, packed, out, a, b = kind.tobytes(), packed.tobytes(), [], 0, 0
    for size, n in zip(sizes.tolist(), length.tolist(), strict=True):
        out.append(kinds[a : a + size] + packed[b : b + n] + bytes(size + n & 1))
        a, b = a + size, b + n
    return out


def _decode_new(streams: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The new ids of each block, by slot."""
    if any(len(x) < n for x, n in zip(streams, sizes.tolist(), strict=True)):
        raise ValueError("a block of token ids is damaged")
    sizes = sizes.astype(np.int64)
    kind = np.concatenate([x[:n] for x, n in zip(streams, sizes, strict=True)])
    bits = _CLASS_BITS.take(kind)
    at, length = _bits_at(bits, sizes)
    if any(not 0 <= len(x) - n < 2 for x, n in zip(streams, (sizes + length).tolist(), strict=True)):
        raise ValueError("a block of token ids is damaged")
    packed = np.concatenate([*(x[n : n + m] for x, n, m in zip(streams, sizes, length, strict=True)), np.zeros(3, np.uint8)]).astype(np.int64)
    byte = at >> 3
    window = packed.take(byte) << 16 | packed.take(byte + 1) << 8 | packed.take(byte + 2)
    window >>= 24 - bits - (at & 7)
    window &= (1 << bits) - 1
    window += _CLASS_FIRST.take(kind)
    # Damaged blocks may have slots without an id.
    ids = np.zeros((len(streams), int(sizes.max()) + 1), np.uint16)
    ids[np.arange(ids.shape[1]) < sizes[:, None]] = window
    return ids


def _slots(ids: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each id of a block in order of steps, and whether it is new there; `seen` has room for a place of each id."""
    order = np.arange(len(ids), dtype=np.uint16)
    seen[ids[::-1]] = order[::-1]
    first = seen[ids]
    new = first // np.uint16(STRANDS) == order // np.uint16(STRANDS)
    number = np.cumsum(new, dtype=np.uint16) - np.uint16(1)
    return number[np.where(new, order, first)], new


def _lengths(n: np.ndarray) -> np.ndarray:
    """Ids of each strand of blocks of so many ids."""
    return (n[..., None] + np.arange(STRANDS - 1, -1, -1)) // STRANDS


def _by_steps(block: np.ndarray) -> np.ndarray:
    """The ids of a block in order of steps."""
    n, steps = len(block), -(-len(block) // STRANDS)
    if n % STRANDS:
        block = np.insert(block, np.cumsum(_lengths(np.array(n)))[n % STRANDS :], 0)
    return block.reshape(STRANDS, steps).T.ravel()[:n]


def _by_strands(found: np.ndarray) -> np.ndarray:
    """The reverse: what stands in order of steps, strand by strand."""
    n = len(found)
    return np.concatenate([found[i::STRANDS] for i in range(STRANDS)]) if n % STRANDS else found.reshape(-1, STRANDS).T.ravel()


def _steps(length: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | None]]:
    """Each step of blocks of such lengths, the longer ones first: its number, how many blocks have it, and which lanes of them, if not all have it."""
    own, shortest = -(-length // STRANDS), length // STRANDS
    active, full = len(length), _lengths(length)
    for t in range(int(own[0])):
        if own[active - 1] <= t:
            active = int(np.searchsorted(-own, -t, side="left"))
        yield t, active, None if shortest[active - 1] > t else full[:active].ravel() > t


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Codes blocks of 1 to BLOCK ids; longer ones must come first."""
    length = np.array([len(b) for b in blocks])
    if not len(blocks) or np.any(np.diff(length) > 0) or length[0] > BLOCK or length[-1] < 1:
        raise ValueError("blocks must hold 1 to BLOCK ids, longer ones first")
    if any(b.dtype != np.uint16 and (int(b.max()) >= IDS or int(b.min()) < 0) for b in blocks):
        raise ValueError(f"ids must be below {IDS}")
    return [r for at in range(0, len(blocks), AT_ONCE) for r in _encode(blocks[at : at + AT_ONCE], length[at : at + AT_ONCE])]


def _encode(blocks: list[np.ndarray], length: np.ndarray) -> list[bytes]:
    n, steps = len(blocks), -(-int(length[0]) // STRANDS)
    slots, fresh, seen = np.zeros((n, steps * STRANDS), np.uint16), [], np.empty(IDS, np.uint16)
    for row, b in zip(slots, blocks, strict=True):
        ordered = _by_steps(b)
        row[: len(b)], new = _slots(ordered, seen)
        fresh.append(ordered[new])
    slots = np.ascontiguousarray(slots.reshape(n, steps, STRANDS).transpose(1, 0, 2)).reshape(steps, n * STRANDS)
    model, coded, begun = _Model(n, finds=False), _Writer(n * STRANDS), 0
    for t, active, some in _steps(length):
        lanes = active * STRANDS
        if active < model.blocks:
            model.narrow(active)
        if t in REFRESH:
            model.refresh(slots[begun:t, :lanes], t)
            begun = t
        slot = slots[t, :lanes].astype(np.int64)
        span = coded.span[:lanes]
        model.predict(span)
        part = model.part_of(slot)
        if some is not None:
            part *= some
        model.learn(part, slot)
        start, size = model.interval(part)
        if some is not None:
            start, size = np.where(some, start, 0), np.where(some, size, span)
        coded.code(start, size)
    digits, out = coded.finish(), []
    for i, (b, of_new, own) in enumerate(zip(blocks, _encode_new(fresh), _lengths(length).tolist(), strict=True)):
        strands = [d if n else d[:0] for d, n in zip(digits[i * STRANDS : (i + 1) * STRANDS], own, strict=True)]
        of_slots = np.array([len(d) for d in strands[:-1]], ">u2").tobytes() + b"".join(d.tobytes() for d in strands)
        out.append(_HEAD.pack(len(b), len(of_slots) // 2, len(of_new) // 2, zlib.crc32(np.asarray(b, "<u4").tobytes())) + of_slots + of_new)
    return out


def record_size(data: bytes, at: int = 0) -> int:
    """Bytes of the coded block that starts there."""
    _, of_slots, of_new, _ = _HEAD.unpack_from(data, at)
    return _HEAD.size + 2 * (of_slots + of_new)


def decode(records: list[bytes]) -> list[np.ndarray]:
    """The ids of coded blocks, the longer ones first; raises if one doesn't fit its checksum."""
    return [ids for at in range(0, len(records), AT_ONCE) for ids in _decode(records[at : at + AT_ONCE])]


def _strands(digits: np.ndarray) -> list[np.ndarray]:
    """The digits of each strand of a block."""
    ends = np.cumsum(digits[: STRANDS - 1], dtype=np.int64) + STRANDS - 1
    if len(ends) < STRANDS - 1 or ends[-1] > len(digits):
        raise ValueError("a block of token ids is damaged")
    return np.split(digits[: len(digits)], [STRANDS - 1, *ends])[1:]


@np.errstate(over="ignore", invalid="ignore", divide="ignore")  # values of damaged blocks may leave their ranges until the checksum tells
def _decode(records: list[bytes]) -> list[np.ndarray]:
    n = len(records)
    heads = [_HEAD.unpack_from(r) for r in records]
    length = np.array([h[0] for h in heads])
    if length.max() > BLOCK or length.min() < 1 or np.any(np.diff(length) > 0):
        raise ValueError("a block of token ids is damaged")
    steps = -(-int(length[0]) // STRANDS)
    model, slots = _Model(n, finds=True), np.zeros((steps, n * STRANDS), np.uint16)
    known = model.known
    coded = _Reader([d for r, h in zip(records, heads, strict=True) for d in _strands(np.frombuffer(r, ">u2", h[1], _HEAD.size))])
    begun = 0
    for t, active, some in _steps(length):
        lanes = active * STRANDS
        if active < model.blocks:
            model.narrow(active)
        if t in REFRESH:
            model.refresh(slots[begun:t, :lanes], t)
            begun = t
        span = coded.span[:lanes]
        model.predict(span)
        part, slot = model.find(coded.value[:lanes])
        if some is not None:
            part, slot = part * some, slot * some
        model.learn(part, slot)
        start, size = model.interval(part)
        if some is not None:
            start, size = np.where(some, start, 0), np.where(some, size, span)
        coded.code(start, size)
        slots[t, :lanes] = slot
    ids = _decode_new([np.frombuffer(r, np.uint8, 2 * h[2], _HEAD.size + 2 * h[1]) for r, h in zip(records, heads, strict=True)], known[::STRANDS])
    slots, out = np.ascontiguousarray(slots.reshape(steps, n, STRANDS).transpose(1, 0, 2)).reshape(n, steps * STRANDS), []
    for own, at, (size, _, _, check) in zip(ids, slots, heads, strict=True):
        found = _by_strands(own[at[:size]]).astype("<u4")
        if zlib.crc32(found.tobytes()) != check:
            raise ValueError("a block of token ids does not fit its checksum")
        out.append(found)
    return out
