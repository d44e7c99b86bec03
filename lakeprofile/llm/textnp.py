"""Vectorised text helpers for tasks: words, word hashes and shingles of a batch of texts.

A batch is cut into runs of documents of about CHUNK bytes, so that the arrays a task holds stay
small; one very long text is a run of its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Letters are ASCII letters and every byte of other characters; `plain_runs` leaves no others that
#: are no letters, marks or digits.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
#: Everything but letters and digits.
SYMBOL = ~LETTER
SYMBOL[48:58] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = _VALUES[LOWER]
_TURNS = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, made as far as they were needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, CHUNK + 1)
            up = np.full(n, _BASE)
            down = np.full(n, _INVERSE)
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up), np.cumprod(down)
        return cls.up, cls.down


@dataclass
class Run:
    """Some documents of a batch: their rows in it, all bytes, and where each text starts."""

    first: int
    data: np.ndarray
    starts: np.ndarray  # one more than there are documents

    def __len__(self) -> int:
        return len(self.starts) - 1


def runs(texts: pa.Array, size: int = CHUNK) -> Iterator[Run]:
    """The texts as runs of bytes; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield Run(i, every[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


@cache
def _separators() -> np.ndarray:
    """For each code point whether it is white space, punctuation, a symbol, a control or format sign."""
    kinds = (unicodedata.category(chr(c)) for c in range(0x110000))
    return np.fromiter((k[0] in "ZPS" or k in ("Cc", "Cf") for k in kinds), bool, 0x110000)


def plain(run: Run) -> Run:
    """The same documents, where each separator beyond ASCII is one space."""
    data = np.concatenate((run.data, np.zeros(3, np.uint8)))
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xF4))
    if not len(lead):
        return run
    length = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    code = data[lead].astype(np.int32) & (0xFF >> (length + 1))
    valid = np.ones(len(lead), bool)
    for i in (1, 2, 3):
        more = length > i
        code[more] = code[more] << 6 | data[lead[more] + i] & 0x3F
        valid[more] &= data[lead[more] + i] & 0xC0 == 0x80
    hit = valid & _separators()[np.minimum(code, 0x10FFFF)]
    lead, length = lead[hit], length[hit]
    keep = np.ones(len(data), bool)
    keep[len(run.data) :] = False
    for i in (1, 2, 3):
        keep[lead[length > i] + i] = False
    data[lead] = 0x20
    return Run(run.first, data[keep], np.concatenate(([0], np.cumsum(keep)))[run.starts])


def plain_runs(texts: pa.Array, size: int = CHUNK) -> Iterator[Run]:
    """Runs for words told apart by Unicode's classes, not by bytes alone."""
    return map(plain, runs(texts, size))


def words(run: Run, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each document the number of its first word (and the
    total at the end). `space` tells for each byte whether it separates words."""
    inside = np.zeros(len(run.data) + 2, bool)
    inside[1:-1] = ~space[run.data]
    own = run.starts[:-1][np.diff(run.starts) > 0]  # a text always starts and ends a word
    begin = inside[1:-1] & ~inside[:-2]
    begin[own] = inside[1:-1][own]
    end = inside[1:-1] & ~inside[2:]
    last = own[1:] - 1
    end[last] = inside[1:-1][last]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, run.starts)


def word_hashes(run: Run, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lowered if asked for."""
    up, down = _Powers.upto(len(run.data) + 1)
    sums = np.zeros(len(run.data) + 1, np.uint64)
    np.cumsum((_LOWERED if lower else _VALUES)[run.data] * up[: len(run.data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _TURNS[63])


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row; none where there are fewer."""
    if len(hashes) < k:
        return hashes[:0]
    out = hashes[: len(hashes) - k + 1] * _TURNS[0]
    for i in range(1, k):
        out = out + hashes[i : len(hashes) - k + 1 + i] * _TURNS[i % 62]
    return mix(out)


def shingles(run: Run, k: int, space: np.ndarray = SPACE) -> list[np.ndarray]:
    """Of each document its shingles in order: k words each, or all words where there are fewer."""
    starts, ends, first = words(run, space)
    hashes = word_hashes(run, starts, ends)
    every = shingle_hashes(hashes, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(every[a : b - k + 1])
        elif b > a:
            whole = shingle_hashes(hashes[a:b], b - a) ^ _TURNS[20 + (b - a) % 40]
            out.append(whole)
        else:
            out.append(every[:0])
    return out


def sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingles of each text."""
    for run in runs(texts):
        for i, s in enumerate(shingles(run, k)):
            yield run.first + i, np.unique(s)
