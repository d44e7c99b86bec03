"""The encoding of text that is not UTF-8, by the likelihood of what it would say.

Each candidate encoding has a score for every character: how often its writers use such characters,
by rule (letters in the order of their frequency, areas of a double-byte table in the order of their
use). A file's lines are decoded by every candidate inside the tasks, scores are summed over all
lines, and the best sum wins; files whose best two differ in what they say and hardly in score are
undecided. Only one row per file, task and candidate is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The name given to files that no candidate explains clearly better than the others.
UNDECIDED = "undecided"
#: How much the best score has to be ahead, in natural logarithms.
MARGIN = 1.0
#: Files are scored in pieces of this many bytes.
PIECE = 1 << 20

_WESTERN = "éäöüáíóèàçãñßåêâôõúøæîùûëïìòœýþðÿ"
_CENTRAL = "áéíłęóąśżěčšřžýćůúńöüőűźăâîţťňďäôľĺŕçđş"
_CYRILLIC = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёіїєґў"
_GREEK = "αοιετσνηυρπκμλςωάίόέήγδύθχφβώξζψϊΐϋΰ"
_TURKISH = "ıişüğçöİâîû"
_SIGNS = "’“”–—„…«»°§€£·•‘²³½©®№"


@dataclass(frozen=True)
class Candidate:
    """An encoding with the letters of its writers, or with the areas of its table: first and last
    lead byte, first trail byte, and their share among double-byte characters."""

    name: str
    prior: float
    letters: str = ""
    areas: tuple[tuple[int, int, int, float], ...] = ()


# Candidates, the first of equals wins.
CANDIDATES = (
    Candidate("cp1252", 0.0, _WESTERN),
    Candidate("iso8859-15", -1.0, _WESTERN),
    Candidate("cp1250", -2.0, _CENTRAL),
    Candidate("iso8859-2", -3.0, _CENTRAL),
    Candidate("cp1251", -2.0, _CYRILLIC),
    Candidate("koi8-r", -3.0, _CYRILLIC),
    Candidate("cp1253", -3.0, _GREEK),
    Candidate("cp1254", -3.0, _TURKISH),
    Candidate("cp932", -2.0, areas=(
        (0x81, 0x81, 0x40, 0.06), (0x82, 0x82, 0x4F, 0.03), (0x82, 0x82, 0x9F, 0.43), (0x83, 0x83, 0x40, 0.12),
        (0x88, 0x97, 0x40, 0.35), (0x98, 0xEA, 0x40, 0.01),
    )),
    Candidate("euc_jp", -2.0, areas=(
        (0xA1, 0xA2, 0xA1, 0.06), (0xA3, 0xA3, 0xA1, 0.03), (0xA4, 0xA4, 0xA1, 0.43), (0xA5, 0xA5, 0xA1, 0.12),
        (0xB0, 0xCF, 0xA1, 0.35), (0xD0, 0xF4, 0xA1, 0.01),
    )),
    Candidate("gb18030", -2.0, areas=(
        (0xA1, 0xA3, 0xA1, 0.06), (0xB0, 0xD7, 0xA1, 0.91), (0xD8, 0xF7, 0xA1, 0.025), (0x81, 0xFE, 0x40, 0.005),
    )),
    Candidate("big5", -2.0, areas=((0xA1, 0xA3, 0x40, 0.06), (0xA4, 0xC6, 0x40, 0.92), (0xC9, 0xF9, 0x40, 0.02))),
    Candidate("cp949", -2.0, areas=(
        (0xA1, 0xA3, 0xA1, 0.05), (0xB0, 0xC8, 0xA1, 0.935), (0xCA, 0xFD, 0xA1, 0.01), (0x81, 0xC6, 0x41, 0.005),
    )),
)
WIDE = {c.name for c in CANDIDATES if c.areas}

# What a character costs that no one writes, one that cannot be decoded, a capital at the start of a
# word and one inside, a letter beside one of another alphabet, and two Latin letters or signs beyond ASCII in a row.
_RARE, _BROKEN, _CAPITAL, _INNER, _MIXED, _ACCENTS = -14.0, -25.0, -1.0, -5.0, -4.0, -2.5
_SIZE = 0x10000
#: How fast letters get rarer with their rank.
FALL = 1.5


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its alphabet (0 no letter, 1 Latin, 2 another one), and if it is a capital."""
    kind, capital = np.zeros(_SIZE, np.int8), np.zeros(_SIZE, bool)
    for code in range(0x3000):
        c = chr(code)
        if c.isalpha():
            kind[code] = 1 if code < 0x250 else 2
            capital[code] = c.isupper()
    return kind, capital


@cache
def _scores(candidate: Candidate) -> np.ndarray:
    """The score of every character: letters by a power of their rank, areas evenly."""
    scores = np.full(_SIZE, _RARE, np.float32)
    scores[0xFFFD] = _BROKEN
    scores[0x80:0xA0] = _BROKEN  # controls
    shares = (np.arange(len(candidate.letters)) + 2.0) ** -FALL
    for c, share in zip(candidate.letters, shares / max(shares.sum(), 1e-9)):
        for form in {c, c.upper()}:
            if len(form) == 1:
                scores[ord(form)] = np.log(0.94 * share)
    for first, last, trail, share in reversed(candidate.areas):
        pairs = b"".join(bytes((a, b)) + b"\n" for a in range(first, last + 1) for b in range(trail, 0xFF) if b != 0x7F)
        text = pairs.decode(candidate.name, errors="ignore").replace("\n", "")
        codes = np.array([ord(c) for c in set(text) if 0x80 <= ord(c) < _SIZE and not 0xE000 <= ord(c) < 0xF900])
        scores[codes] = np.log(share / len(codes))
    if not candidate.areas:
        for c in _SIGNS:
            scores[ord(c)] = max(scores[ord(c)], np.log(0.06 / len(_SIGNS)))
    return scores


def score(data: bytes, candidate: Candidate) -> tuple[float, int]:
    """The score of some bytes, and a sum that is equal where candidates read the same."""
    text = data.decode(candidate.name, errors="replace")
    codes = np.frombuffer(text.encode("utf-32-le", errors="replace"), np.uint32)
    codes = np.minimum(codes, 0xFFFF).astype(np.int64)
    at = np.flatnonzero(codes >= 0x80)
    own, before, after = codes[at], np.where(at > 0, codes[at - 1], 0), np.append(codes, 0)[at + 1]
    total = float(_scores(candidate)[own].sum(dtype=np.float64))
    if not candidate.areas:
        kind, capital = _kinds()
        k, b, a = kind[own], kind[before], kind[after]
        word, lower = (k > 0) & (b > 0), (b > 0) & ~capital[before]
        total += _CAPITAL * np.sum(capital[own] & (b == 0)) + _INNER * np.sum(capital[own] & lower)
        total += _MIXED * (np.sum(word & (k != b)) + np.sum((k > 0) & (a > 0) & (a != k) & (after < 0x80)))
        total += _ACCENTS * np.sum((k < 2) & (before >= 0x80))
    return total, zlib.crc32(text.encode(errors="replace"))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, str], list] = {}

    def add(path: str, lines: list[bytes]) -> None:
        data = b"\n".join(lines)
        for candidate in CANDIDATES:
            total, read = score(data, candidate)
            own = sums.setdefault((path, candidate.name), [0.0, 0])
            own[0] += total
            own[1] += read

    for batch in batches:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for path, line in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.setdefault(path, []).append(line.as_py())
            sizes[path] = sizes.get(path, 0) + len(held[path][-1])
            if sizes[path] > PIECE:
                add(path, held.pop(path))
                sizes[path] = 0
        for path, lines in held.items():
            add(path, lines)
    keys = list(sums)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
            pa.array([sums[k][0] for k in keys], pa.float64()), pa.array([sums[k][1] for k in keys], pa.int64()),
        ],
        ["path", "encoding", "score", "reading"],
    )


def encoding_scores(lines: DataFrame) -> DataFrame:
    """(path, encoding, score, reading) of files' lines (path, value as bytes). Candidates with an
    equal `reading` read a file alike."""
    found = lines.select("path", "value").mapInArrow(
        _scored, "path string, encoding string, score double, reading long"
    )
    prior = F.create_map(*[F.lit(v) for c in CANDIDATES for v in (c.name, c.prior)])
    return found.groupBy("path", "encoding").agg(
        (F.sum("score") + F.first(prior[F.col("encoding")])).alias("score"), F.sum("reading").alias("reading")
    )


def best_encodings(lines: DataFrame) -> DataFrame:
    """(path, encoding): the likeliest encoding, or UNDECIDED."""
    place = F.array_position(F.array(*[F.lit(c.name) for c in CANDIDATES]), F.col("encoding"))
    each = F.struct("score", (-place).alias("place"), "encoding", "reading")
    ranked = encoding_scores(lines).groupBy("path").agg(F.reverse(F.array_sort(F.collect_list(each))).alias("all"))
    top = F.col("all")[0]
    rival = F.exists(
        "all", lambda e: (e["reading"] != top["reading"]) & (e["score"] > top["score"] - F.lit(MARGIN))
    )
    return ranked.select("path", F.when(rival, UNDECIDED).otherwise(top["encoding"]).alias("encoding"))
