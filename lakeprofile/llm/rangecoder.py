"""Adaptive context-mixing range coder for token ids.

A block is coded on its own: its models start anew, so it can be read without any other block. For
each id three predictions are mixed into one distribution: order 2 (the id last seen after the two
ids before), order 1 (after the one id before) and order 0 (how often each id came so far). The
shares of orders 2 and 1 are learned: adaptive counts of which order was right, in the context of
both orders' confidence counters and of whether they agree. The rest goes to order 0, under which
every id has a share, so that every id can be coded in one step.

The ids of a block are cut into lanes, stretches that are coded side by side, each into words of its
own, with models in common that learn from all of them. So numpy codes an id of every lane at a time
and the loop in Python runs along a lane. Order 0 and the shares are brought up to date every
REFRESH ids of a lane.

A coded block: magic, number of ids, vocabulary, lanes, CRC-32 of these and of what follows; then
the number of 16-bit words of each lane, and the words. A block whose checksum fails is refused.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

HEAD = struct.Struct("<4sIIII")
MAGIC = b"CMR2"
LANES = 4096
#: A lane is at least so long, or a block has fewer lanes.
SHORTEST = 64
REFRESH = 8
SLOT_BITS = (17, 18)
ORDER0_BITS, SHARE_BITS = 18, 12
TOTAL_BITS = ORDER0_BITS + SHARE_BITS
LOW_BITS = 48
_LOW = (1 << LOW_BITS) - 1
_FLOOR = 1 << (LOW_BITS - 16)


class _Model:
    def __init__(self, vocabulary: int):
        self.vocabulary = vocabulary
        self.counts = np.zeros(vocabulary, np.int64)
        self.names = np.arange(vocabulary, dtype=np.uint16 if vocabulary <= 1 << 16 else np.int32)
        self.seen = [np.zeros(1 << bits, np.int32) for bits in SLOT_BITS]
        # Counts of (order 2, order 1, order 0) by confidence 2, confidence 1 and agreement.
        trust = np.arange(4)
        self.right = np.ones((4, 4, 2, 3), np.int64) * 20
        self.right[..., 0] = 2 + 8 * trust[:, None, None] ** 2
        self.right[..., 1] = 1 + 2 * trust[None, :, None]
        self.right = self.right.reshape(32, 3)
        self.heard: list[np.ndarray] = []
        self.cases: list[np.ndarray] = []
        self.refresh()

    def refresh(self) -> None:
        if self.heard:
            ids = np.concatenate(self.heard)
            self.heard.clear()
            self.counts += np.bincount(ids, minlength=self.vocabulary)
            if self.counts.sum() > 1 << 21:
                self.counts >>= 1
            self.right += np.bincount(np.concatenate(self.cases), minlength=96).reshape(32, 3)
            self.cases.clear()
        total = int(self.counts.sum())
        spare = (1 << ORDER0_BITS) - self.vocabulary
        cum = np.zeros(self.vocabulary + 1, np.int64)
        np.cumsum(self.counts * spare // max(1, total) + 1, out=cum[1:])
        cum[-1] = 1 << ORDER0_BITS
        self.cum = cum[:-1].astype(np.int32)
        self.width = np.diff(cum).astype(np.int32)
        full = self.right.sum(1) > 1 << 16
        self.right[full] = (self.right[full] + 1) >> 1
        sums = self.right.sum(1)
        units = (1 << SHARE_BITS) - 3
        first = self.right[:, 0] * units // sums + 1
        second = first + self.right[:, 1] * units // sums + 1  # end of order 1's share
        ends = np.stack((np.zeros_like(first), first, second, np.full_like(first, 1 << SHARE_BITS)), 1)
        #: Where the share of a case, 3 * state + kind, begins, and how large it is.
        self.begin, self.share = ends[:, :3].ravel().astype(np.int32), np.diff(ends).ravel().astype(np.int32)

    def inverse(self) -> np.ndarray:
        """The id that each unit of order 0 belongs to."""
        return np.repeat(self.names, self.width)

    @staticmethod
    def slots(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where orders 1 and 2 remember what came after `one`, and after `two` and `one`."""
        one, two = one.astype(np.uint32), two.astype(np.uint32)
        h2 = (one * np.uint32(0x85EBCA6B) ^ two * np.uint32(0xC2B2AE35)) * np.uint32(0x9E3779B1)
        one *= np.uint32(0x9E3779B1)
        return (one >> np.uint32(32 - SLOT_BITS[0])).astype(np.intp), (h2 >> np.uint32(32 - SLOT_BITS[1])).astype(np.intp)

    def look(self, at: tuple[np.ndarray, np.ndarray]) -> None:
        self.at = at
        v1, v2 = self.seen[0].take(at[0]), self.seen[1].take(at[1])
        self.found, self.trust = (v1, v2), (v1 & 3, v2 & 3)
        self.p1, self.p2 = v1 >> 2, v2 >> 2
        self.case = self.trust[1] * 24 + self.trust[0] * 6
        self.case += (self.p1 == self.p2) * np.int32(3)

    def interval(self, ids: np.ndarray, hits: tuple[np.ndarray, np.ndarray]):
        """Where an id's interval starts and its size, by which orders, 1 and 2, have predicted it."""
        kind = np.where(hits[1], np.int32(0), np.int32(2) - hits[0])
        self.case += kind
        share, rare = self.share.take(self.case), kind == 2
        start = self.begin.take(self.case) << ORDER0_BITS
        start += share * (self.cum.take(ids) * rare)
        return start, share * np.where(rare, self.width.take(ids), np.int32(1 << ORDER0_BITS))

    def learn(self, ids: np.ndarray, hits: tuple[np.ndarray, np.ndarray]) -> None:
        self.cases.append(self.case)
        fresh = ids << 2
        for seen, at, v, trust, hit in zip(self.seen, self.at, self.found, self.trust, hits):
            seen[at] = np.where(hit, v + (trust < 3), np.where(trust > 0, v - 1, fresh))
        self.heard.append(ids)


def _crc(count: int, vocabulary: int, lanes: int, body: bytes) -> int:
    return zlib.crc32(body, zlib.crc32(struct.pack("<III", count, vocabulary, lanes)))


def _lanes(n: int, lanes: int) -> np.ndarray:
    """How long the lanes of a block of n ids are; longer ones first."""
    return np.full(lanes, n // lanes) + (np.arange(lanes) < n % lanes)


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of ids below `vocabulary`, coded."""
    ids = np.asarray(ids, np.int64)
    if not 0 < vocabulary < 1 << (ORDER0_BITS - 1):
        raise ValueError(f"vocabularies up to {(1 << (ORDER0_BITS - 1)) - 1} ids can be coded")
    if len(ids) and (ids.min() < 0 or ids.max() >= vocabulary):
        raise ValueError("an id is outside of the vocabulary")
    lengths = _lanes(len(ids), max(1, min(LANES, len(ids) // SHORTEST)))
    n, steps = len(lengths), int(lengths[0])
    # A row for each step; rows 0 and 1 are the two ids 0 before a lane.
    rows = np.zeros((steps + 2, n), np.int32)
    begin = np.cumsum(lengths) - lengths
    for t in range(steps):
        m = n if t < lengths[-1] else int(np.count_nonzero(lengths > t))
        rows[t + 2, :m] = ids[begin[:m] + t]
    model = _Model(vocabulary)
    low, span = np.zeros(n, np.int64), np.full(n, _LOW, np.int64)
    out = np.zeros((2 * steps + 8, n), np.uint16)  # a column for each lane, as lanes fill up alike
    pos = np.zeros(n, np.int64)
    for t in range(steps):
        m = n if t < lengths[-1] else int(np.count_nonzero(lengths > t))
        now = rows[t + 2, :m]
        if t % REFRESH == 0:
            end = min(t + REFRESH, steps)
            slots = model.slots(rows[t + 1 : end + 1], rows[t:end])
        model.look((slots[0][t % REFRESH, :m], slots[1][t % REFRESH, :m]))
        hits = now == model.p1, now == model.p2
        start, size = model.interval(now, hits)
        part = span[:m] >> TOTAL_BITS
        at = low[:m] + part * start
        new = part * size
        carry = np.flatnonzero(at > _LOW)
        p = pos[carry]
        while len(carry):
            p = p - 1
            out[p, carry] += np.uint16(1)
            again = out[p, carry] == 0
            carry, p = carry[again], p[again]
        at &= _LOW
        small = np.flatnonzero(new < _FLOOR)
        while len(small):
            lows, p, wider = at[small], pos[small], new[small] << 16
            out[p, small] = lows >> (LOW_BITS - 16)
            pos[small] = p + 1
            at[small] = (lows << 16) & _LOW
            new[small] = wider
            small = small[wider < _FLOOR]
        low[:m], span[:m] = at, new
        model.learn(now, hits)
        if t % REFRESH == REFRESH - 1:
            model.refresh()
    for shift in (32, 16, 0):
        out[pos, np.arange(n)] = low >> shift & 0xFFFF
        pos += 1
    if not len(ids):
        pos[:] = 0
    body = pos.astype("<u4").tobytes() + b"".join(
        row[:k].astype("<u2").tobytes() for row, k in zip(out.T.copy(), pos.tolist())
    )
    return HEAD.pack(MAGIC, len(ids), vocabulary, n, _crc(len(ids), vocabulary, n, body)) + body


def decode(coded: bytes) -> np.ndarray:
    """The ids of a block; a damaged one raises."""
    if len(coded) < HEAD.size:
        raise ValueError("a block is cut short")
    magic, count, vocabulary, n, crc = HEAD.unpack_from(coded)
    body = coded[HEAD.size :]
    if magic != MAGIC or _crc(count, vocabulary, n, body) != crc:
        raise ValueError("a block is damaged")
    lengths = _lanes(count, n)
    if not count:
        return np.zeros(0, np.int64)
    sizes = np.frombuffer(body, "<u4", n).astype(np.int64)
    words = np.concatenate((np.frombuffer(body, "<u2", offset=4 * n), np.zeros(8, np.uint16)))
    pos = np.cumsum(sizes) - sizes
    begin = np.cumsum(lengths) - lengths
    out = np.zeros(count, np.int64)
    model = _Model(vocabulary)
    code = words[pos].astype(np.int64) << 32 | words[pos + 1].astype(np.int64) << 16 | words[pos + 2]
    pos += 3
    span = np.full(n, _LOW, np.int64)
    one, two = np.zeros(n, np.int32), np.zeros(n, np.int32)
    top = (1 << TOTAL_BITS) - 1
    whole = np.int32(1 << SHARE_BITS)
    for t in range(int(lengths[0])):
        m = n if t < lengths[-1] else int(np.count_nonzero(lengths > t))
        if t % REFRESH == 0:
            inverse = model.inverse()
        model.look(model.slots(one[:m], two[:m]))
        part = span[:m] >> TOTAL_BITS
        # Quotients of such small integers are never rounded up to the next one.
        value = np.minimum(code[:m] / part, top).astype(np.int32)
        share = value >> ORDER0_BITS
        first, second = model.begin.take(model.case + 1), model.begin.take(model.case + 2)
        now = np.where(share < first, model.p2, model.p1)
        other = np.flatnonzero(share >= second)
        second = second[other]
        now[other] = inverse[((value[other] - (second << ORDER0_BITS)) / (whole - second)).astype(np.intp)]
        hits = now == model.p1, now == model.p2
        start, size = model.interval(now, hits)
        at = code[:m] - part * start
        new = part * size
        small = np.flatnonzero(new < _FLOOR)
        while len(small):
            p, wider = pos[small], new[small] << 16
            at[small] = at[small] << 16 | words[p]
            pos[small] = p + 1
            new[small] = wider
            small = small[wider < _FLOOR]
        code[:m], span[:m] = at, new
        out[begin[:m] + t] = now
        model.learn(now, hits)
        if t % REFRESH == REFRESH - 1:
            model.refresh()
        two[:m], one[:m] = one[:m], now
    return out
