"""Cuts texts into segments: runs of windows of equal length that share their smallest gram."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lakeprofile.llm import textnp

#: Low bits of a gram's key hold its place; Arrow texts have fewer bytes.
_PLACE = np.uint64(31)
_SECOND = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Sums:
    """Prefix sums of a run, from which any stretch of it has a hash in a few operations."""

    def __init__(self, data: np.ndarray, values: np.ndarray = textnp._VALUES):
        self.up, self.down = textnp._Powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * self.up[: len(data)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Unmixed hash of each stretch of a length."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return textnp.mix(raw + (ends - starts).astype(np.uint64))


@dataclass
class Segments:
    """Per segment its document in the run, first window (offset in the document), number of
    windows, the place of its gram in the document, the gram's hash and the hash of its bytes."""

    doc: np.ndarray
    start: np.ndarray
    n: np.ndarray
    gram_at: np.ndarray
    gram: np.ndarray
    content: np.ndarray


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def segments(run: textnp.Run, window: int, gram: int) -> Segments | None:
    """The segments of a run's documents; none where no text has a whole window.

    The smallest gram of a window, the leftmost of equals, depends on its bytes alone, so equal
    windows have equal grams at equal places.
    """
    n = len(run.data)
    if n < window:
        return None
    sums = Sums(run.data)
    raw = sums.every(gram) * np.uint64(0xD6E8FEB86659FD93)
    raw ^= raw >> np.uint64(32)
    raw *= np.uint64(0xD6E8FEB86659FD93)
    place = np.arange(len(raw), dtype=np.uint64)
    key = (raw >> _PLACE << _PLACE) | place
    least = sliding_min(key, window - gram + 1)
    at = (least & np.uint64((1 << 31) - 1)).astype(np.int64)
    whole = np.zeros(n + 1, np.int8)  # where a window fits into its text
    lengths = np.diff(run.starts)
    fits = lengths >= window
    begin, stop = run.starts[:-1][fits], run.starts[1:][fits] - window + 1
    if not len(begin):
        return None
    whole[begin] += 1
    whole[stop] -= 1
    inside = np.cumsum(whole[: len(at)], dtype=np.int8).astype(bool)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    new[begin] = True
    starts = np.flatnonzero(new)
    n_windows = np.diff(starts, append=len(at))
    keep = inside[starts]
    starts, n_windows = starts[keep], n_windows[keep]
    doc = np.searchsorted(run.starts, starts, "right") - 1
    # Empty texts before a document start where it does; the last of them is the document.
    return Segments(
        doc, starts - run.starts[doc], n_windows, at[starts] - run.starts[doc],
        textnp.mix(raw[at[starts]]), sums.of(starts, starts + n_windows + window - 1),
    )
