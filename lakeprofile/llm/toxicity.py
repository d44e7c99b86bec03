"""Toxicity with noisy-channel deobfuscation: Viterbi decoding under a character language model.

1. A character trigram model is counted over all documents: Latin letters, other letters, and the
   end of a word.
2. A lexicon is learned from labelled texts, at most SAMPLE of each label, those with the smallest
   hashes, copies once: words and word beginnings that hardly occur in texts labelled clean, chosen
   one after another by how many toxic texts they explain that fewer than TIMES earlier ones do. An
   entry must explain SHARE of the toxic texts: the words of one text that was copied don't.
3. In every whole text, spans that look disguised are found: letters mixed with signs that stand for
   letters, letters set apart one by one, letters repeated three times or more. Each is a lattice:
   a sign may be one of some letters or nothing, a repeated letter may be kept or dropped, and
   between letters set apart a word may end. Viterbi decoding finds the likeliest reading, of what
   the channel costs and what the language model says, in which the lexicon's words are mixed.
4. The restored words are read with the plain ones: each lexicon entry found is independent
   evidence of its precision, score = 1 - (1 - rest) * product(1 - precision), where rest is the
   share of toxic texts among those with no entry.

Defined results: null and empty texts have no entry and score `rest`, as every text without one;
without labels, or with labels of one kind, nothing is learned and every text scores the share of
toxic labels (0 without any). Texts and words of any length take time in proportion to it. White space,
punctuation and symbols beyond ASCII, such as curly quotes and no-break spaces, are spaces. Labels that repeat count once,
toxic if any says so; labels of null are left out. Rows that repeat are scored alike. Other columns are not read; scoring sees text only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm import shared, textnp, windows

SAMPLE = 2048
#: An entry explains so many sampled toxic texts at least, such a share of them, texts explained less
#: than so many times before, and is so precise among labelled texts.
SUPPORT, SHARE, TIMES, PRECISION = 4, 0.01, 3, 0.9
BEGINNINGS = (4, 5, 6, 7)
CUTOFF = 0.3

#: Signs and the letters they stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h",
}
GAPS = " .-_*~"
#: What the channel costs, as negative logarithms.
SIGN, MASK, DROP_REPEAT, DROP_DOUBLE, DROP_GAP, DROP_SIGN, WORD_END = 0.5, 3.0, 0.2, 2.5, 0.1, 4.0, 4.0

_NOT_LETTER = ~textnp.LETTER
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in GAPS]] = True

# Codes of the language model: 0 ends a word, 1 to 26 are Latin letters, 27 is any other letter.
_CODES = np.zeros(256, np.int64)
_CODES[97:123] = _CODES[65:91] = np.arange(1, 27)
_CODES[128:] = 27
_N = 28

_SIGNS = re.escape("".join(LEET))
_APART = re.compile(
    rf"(?<![^\W_])(?:[^\W\d_]|[{_SIGNS}])(?:[{re.escape(GAPS)}](?:[^\W\d_]|[{_SIGNS}])){{3,}}(?![^\W_])"
)
# A letter with signs after it, or signs before a letter; the rest of the word is found from there.
_MIXED = re.compile(rf"[^\W\d_][{_SIGNS}]{{1,2}}(?=[^\W\d_]|\b|\s|$)|[{_SIGNS}]{{1,2}}(?=[^\W\d_])")
_MIXED_BEFORE, _MIXED_AFTER = re.compile(rf"[^\W_{_SIGNS}]"), re.compile(rf"[\w{_SIGNS}]*")
_REPEATED = re.compile(r"([^\W\d_])\1\1", re.IGNORECASE)
_REPEATED_BEFORE, _REPEATED_AFTER = re.compile(r"[^\W\d_]"), re.compile(r"[^\W\d_]*")
#: Longer spans are not remembered, so that what a worker remembers stays small.
REMEMBERED = 64


@dataclass
class Language:
    """Logarithms of trigram probabilities, smoothed by bigrams and letters."""

    logs: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, words: list[str] = (), share: float = 0.2) -> Language:
        """From counts of a corpus, in which listed words make up a share."""
        counts = counts.astype(float) + 1e-9
        own = np.zeros((_N, _N, _N))
        for word in words:
            codes = [0, 0, *(_CODES[min(b, 255)] for b in word.encode()), 0]
            for a, b, c in zip(codes, codes[1:], codes[2:]):
                own[a, b, c] += 1
        if own.sum():
            counts = (1 - share) * counts / counts.sum() + share * own / own.sum()
        counts = counts / counts.sum()
        one = counts.sum((0, 1)) + 1e-6
        two = counts.sum(0) + 1e-9
        three = counts + 1e-12
        p = 0.02 * one / one.sum() + 0.18 * two / two.sum(1, keepdims=True) + 0.8 * three / three.sum(2, keepdims=True)
        return cls(np.log(p))


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_N**3, np.int64)
    for batch in batches:
        for run in textnp.plain_runs(batch.column(0)):
            codes = np.zeros(len(run.data) + 3, np.int64)
            codes[2:-1] = _CODES[run.data]
            cells = (codes[:-2] * _N + codes[1:-1]) * _N + codes[2:]
            counts += np.bincount(cells, minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["cell", "n"])


def language_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """How often three characters follow each other, over all texts; a table of fixed size."""
    found = docs.select(text_column).mapInArrow(_trigrams, "cell long, n long")
    counts = np.zeros(_N**3, np.int64)
    for r in found.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    counts[0] = 0  # nothing after nothing
    return counts.reshape(_N, _N, _N)


def lattice(span: str, apart: bool | None = None) -> list[list[tuple[str, float]]]:
    """For each character of a span its readings and their costs; '' is nothing, '#' a word's end.
    Whether its letters are set apart one by one is given where the span is a piece of one."""
    low = span.lower()
    if apart is None:
        apart = bool(_APART.fullmatch(low))
    out, before, run = [], "", 0
    for i, c in enumerate(low):
        run = run + 1 if c == before else 1
        before = c
        drop = DROP_REPEAT if run > 2 or low[i + 1 : i + 2] == c else DROP_DOUBLE
        if c.isalpha():
            out.append([(c, 0.0)] + ([("", drop)] if run > 1 else []))
        elif apart and c in GAPS:
            out.append([("", DROP_GAP), ("#", WORD_END)])
        elif c in LEET:
            readings = [(x, MASK if c == "*" else SIGN) for x in LEET[c]]
            out.append([*readings, ("", drop if run > 1 else DROP_SIGN)])
        else:
            out.append([("", DROP_SIGN), ("#", WORD_END)])
    return out


def _code(letter: str) -> int:
    return 0 if letter == "#" else ord(letter) - 96 if "a" <= letter <= "z" else 27


def restored(span: str, language: Language) -> str:
    """The likeliest reading of a span, words separated by spaces.

    Two letters in a row that can only be themselves leave one state of the language model, whatever
    was read before. The lattice is cut there: pieces are decoded one by one, equal ones once, and
    what is certain between them is copied, so that the work grows with the span's length. Of
    readings that cost the same, the one whose last different letter is less.
    """
    low = span.lower()
    apart = bool(_APART.fullmatch(low))
    unsure = [i for i, (a, c) in enumerate(zip("\0" + low, low)) if a == c or not c.isalpha()]
    known: dict[tuple[int, int, str, bool], str] = {}
    out, done, i = [], 0, 0
    while i < len(unsure):
        first = last = unsure[i]
        while i < len(unsure) and unsure[i] - last <= 2:
            last = unsure[i]
            i += 1
        stop = min(last + 3, len(low))
        ends = stop == len(low)
        before = [0, 0, *map(_code, low[max(0, first - 2) : first])]
        key = (before[-2], before[-1], low[max(0, first - 1) : stop], ends)
        text = known.get(key)
        if text is None:
            readings = lattice(key[2], apart)[min(first, 1) :]
            text = _decoded(readings, before[-2:], ends, language)
            if len(key[2]) <= REMEMBERED and len(known) < 100_000:
                known[key] = text
        out += [low[done:first], text]
        done = stop
    out.append(low[done:])
    return " ".join("".join(out).replace("#", " ").split())


def _decoded(readings: list[list[tuple[str, float]]], before: list[int], ends: bool, language: Language) -> str:
    """Viterbi over a lattice, from the codes of the two letters before it; the end of a word follows
    if it `ends`. A path's letters are linked from the last one back, so paths share what they share."""
    logs = language.logs
    paths: dict[tuple[int, int], tuple] = {(before[0], before[1]): (0.0, "", None)}
    for choices in [*readings, [("#", 0.0)]] if ends else readings:
        after: dict[tuple[int, int], tuple] = {}
        for (a, b), path in paths.items():
            for letter, paid in choices:
                c = _code(letter) if letter else 0
                if c == 0 and (b == 0 or not letter):
                    state, total, now = (a, b), path[0] + paid, path
                else:
                    state, total, now = (0, 0) if c == 0 else (b, c), path[0] + paid - logs[a, b, c], None
                best = after.get(state)
                if best is not None and (best[0], best[1]) <= (total, letter if now is None else path[1]):
                    continue
                after[state] = (total, letter, path) if now is None else (total, path[1], path[2])
        paths = after
    path = min(paths.values(), key=lambda p: p[:2])
    letters = []
    while path[2] is not None:
        letters.append(path[1])
        path = path[2]
    return "".join(reversed(letters))


def _around(text: str, core: re.Pattern, before: re.Pattern, after: re.Pattern) -> Iterator[str]:
    """Each match of a short pattern with all that fits before and after it; in linear time."""
    at = 0
    while m := core.search(text, at):
        start, end = m.start(), after.match(text, m.end()).end()
        while start > at and before.match(text, start - 1):
            start -= 1
        yield text[start:end]
        at = end


def disguised(text: str) -> list[str]:
    """Spans of a text that look disguised, each once."""
    spans = [m.group() for m in _APART.finditer(text)]
    spans += _around(text, _MIXED, _MIXED_BEFORE, _MIXED_AFTER)
    spans += _around(text, _REPEATED, _REPEATED_BEFORE, _REPEATED_AFTER)
    return [s for s in dict.fromkeys(spans) if any(c.isalpha() for c in s)]


def _suspects(run: textnp.Run) -> np.ndarray:
    """Documents of a run that may hold a disguised span: a test that `disguised` never needs more."""
    data = run.data
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64)
    letter, sign, gap = (t[np.concatenate((data, np.zeros(8, np.uint8)))] for t in (textnp.LETTER, _SIGN, _GAP))
    low = textnp.LOWER[data]
    same = np.zeros(n, bool)
    same[2:] = letter[2:n] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    either = letter | sign
    apart = either[:n] & gap[1 : n + 1] & either[2 : n + 2] & gap[3 : n + 3] & either[4 : n + 4]
    apart[1:] &= ~letter[: n - 1]
    mixed = np.zeros(n, bool)
    mixed[1:] = sign[1:n] & letter[: n - 1]  # a sign after a letter: not a third one, nor the end of prose
    plain = np.zeros(n + 8, bool)
    plain[:n] = data == ord("!")
    mixed &= ~(plain[:n] & ~letter[1 : n + 1])
    mixed &= ~(sign[:n] & sign[1 : n + 1] & sign[2 : n + 2])
    mixed |= sign[:n] & letter[1 : n + 1]
    at = np.flatnonzero(same | apart | mixed)
    return np.unique(np.searchsorted(run.starts, at, "right") - 1)


def _hashes(run: textnp.Run) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a run and of their beginnings, and the document of each."""
    starts, ends, first = textnp.words(run, _NOT_LETTER)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if not len(starts):
        return np.zeros(0, np.uint64), doc
    sums = windows.Sums(run.data, textnp._LOWERED)
    hashes, docs = [_marked(sums.of(starts, ends), 0)], [doc]
    for n in BEGINNINGS:
        long = ends - starts > n
        hashes.append(_marked(sums.of(starts[long], starts[long] + n), n))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


def _marked(h: np.ndarray, length: int) -> np.ndarray:
    """A hash with the length of the beginning it stands for in its low bits, 0 for a whole word."""
    return h & ~np.uint64(7) | np.uint64(length)


@dataclass
class Model:
    """The lexicon (entries, their hashes and precisions), the share of toxic texts without an
    entry, and the language model."""

    entries: list[str] = field(default_factory=list)
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    precisions: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rest: float = 0.0
    language: Language | None = None


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the distinct hashes of its words and beginnings."""
    for batch in batches:
        out = []
        for run in textnp.plain_runs(batch.column(1)):
            h, doc = _hashes(run)
            order = np.argsort(doc, kind="stable")
            h, ends = h[order], np.searchsorted(doc[order], np.arange(len(run) + 1))
            out += [np.unique(h[a:b]).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["toxic", "hashes"])


def _each_feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of `_features`, a row each."""
    for batch in _features(batches):
        for hashes in batch.column(1):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes.as_py(), np.int64))], ["h"])


def _named(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The spelling of wanted hashes."""
    for batch in batches:
        names: dict[int, str] = {}
        for run in textnp.plain_runs(batch.column(1)):
            starts, ends, _ = textnp.words(run, _NOT_LETTER)
            if not len(starts):
                continue
            sums = windows.Sums(run.data, textnp._LOWERED)
            for n in (0, *BEGINNINGS):
                stop = ends if n == 0 else starts + n
                fits = ends - starts > n
                h = _marked(sums.of(starts[fits], stop[fits]), n)
                for i in np.flatnonzero(np.isin(h, wanted)).tolist():
                    a, b = int(starts[fits][i]), int(stop[fits][i])
                    word = textnp.LOWER[run.data[a:b]].tobytes().decode(errors="replace")
                    names.setdefault(int(h[i]), word + ("-" if n else ""))
        yield pa.RecordBatch.from_arrays(
            [pa.array([np.uint64(h).astype(np.int64) for h in names], pa.int64()), pa.array(list(names.values()), pa.string())],
            ["h", "name"],
        )


def cover(toxic: list[np.ndarray], clean: list[np.ndarray], share: float):
    """Entries that explain the toxic texts: hashes, precisions, and the share of toxic among
    texts with no entry. `share` is that of toxic among all labelled texts."""
    found, n = np.unique(np.concatenate(toxic), return_counts=True)
    found, n = found[n >= SUPPORT], n[n >= SUPPORT]
    against = np.zeros(len(found), np.int64)
    for hashes in clean:
        at = np.searchsorted(hashes, found)
        against += hashes[np.minimum(at, len(hashes) - 1)] == found if len(hashes) else 0
    hit = share * (n + 0.5) / (len(toxic) + 1)
    miss = (1 - share) * (against + 0.05) / (len(clean) + 0.1)
    precise = hit / (hit + miss)
    good = precise >= PRECISION
    found, precise = found[good], precise[good]
    inside = np.stack([np.isin(found, t) for t in toxic]) if len(found) else np.zeros((len(toxic), 0), bool)
    explained, chosen = np.zeros(len(toxic), np.int64), []
    least = max(SUPPORT, SHARE * len(toxic))
    whole = (found & np.uint64(7)) == 0
    while len(found):
        gain = inside[explained < TIMES].sum(0)
        gain[chosen] = 0
        best = int(gain.argmax())
        if gain[best] < least:
            break
        # Of entries that explain as much: a whole word, else the longest beginning.
        same = np.flatnonzero(gain >= 0.98 * gain[best])
        length = np.where(whole[same], 8, (found[same] & np.uint64(7)).astype(np.int64))
        best = int(same[np.lexsort((found[same], -gain[same], -length))[0]])
        # What stands in almost the same texts is the same evidence.
        alike = (inside & inside[:, [best]]).sum(0) >= 0.9 * np.maximum(inside.sum(0), inside[:, best].sum())
        chosen.append(best)
        explained += inside[:, best]
        inside = inside & ~(alike & (np.arange(len(found)) != best))
    left = explained == 0
    missed = share * (left.sum() + 0.5) / (len(toxic) + 1)
    rest = missed / (missed + (1 - share))
    return found[chosen], precise[chosen], float(min(rest, CUTOFF / 2))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> Model:
    """A model of all texts and of the labels (id, label 0 or 1) given, which are for training."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    marks = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("toxic"))
    marks = shared.cut(
        marks.where("id is not null and toxic is not null").groupBy("id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)"), "labels",
    )
    totals = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    counts = language_counts(rows)
    model = Model(rest=share, language=Language.of(counts))
    if len(totals) < 2:
        return model
    chosen = None
    for toxic, many in ((1, sample), (0, 4 * sample)):
        part = marks.where(F.col("toxic") == toxic).orderBy(F.xxhash64("id"), "id").limit(many)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 5 * sample ids, by the limits above.
    some = shared.cut(rows.join(F.broadcast(chosen), "id").select("toxic", "text").distinct(), "labelled")
    texts = {0: [], 1: []}
    # Counted in Spark: the driver sees what enough toxic texts share, not whole texts. What fewer
    # share can't become an entry (`cover` takes those that explain 0.98 of the best one's texts).
    toxic = some.where("toxic = 1")
    least = max(SUPPORT, int(0.98 * SHARE * toxic.count()))
    counted = toxic.mapInArrow(_each_feature, "h long").groupBy("h").agg(F.count("*").alias("n"))
    often = np.array([r["h"] for r in counted.where(F.col("n") >= least).select("h").collect()], np.int64)
    often = np.sort(often.view(np.uint64))
    if not len(often):
        return model

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _features(batches):
            own = [np.frombuffer(h, np.uint64) for h in batch.column(1).to_pylist()]
            kept = [np.intersect1d(h, often, assume_unique=True).tobytes() for h in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], ["toxic", "hashes"])

    for r in some.mapInArrow(wanted, "toxic int, hashes binary").collect():
        texts[r["toxic"]].append(np.frombuffer(r["hashes"], np.uint64))
    if not texts[0] or not texts[1]:
        return model
    hashes, precisions, rest = cover(texts[1], texts[0], share)
    named = some.where("toxic = 1").mapInArrow(lambda b: _named(b, hashes), "h long, name string")
    names = {r["h"] & 0xFFFFFFFFFFFFFFFF: r["name"] for r in named.distinct().collect()}
    entries = [names.get(int(h), "") for h in hashes]
    order = np.argsort(hashes)
    return Model(
        [entries[i] for i in order], hashes[order], precisions[order], rest,
        Language.of(counts, [e.rstrip("-") for e in entries if e and not e.endswith("-")]),
    )


def _found(h: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Number of the entry of each hash, -1 without one."""
    if not len(hashes):
        return np.full(len(h), -1)
    low = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[low] == h, low, -1)


def evidence(texts: pa.Array, model: Model) -> Iterator[tuple[int, set[int], list[str]]]:
    """Row, entries found in the restored text, and what was restored, where there is either."""
    language = model.language
    known: dict[str, str] = {}
    # No beginning longer than the longest entry can be one.
    longest = max(map(len, model.entries), default=0)
    for run in textnp.plain_runs(texts):
        h, doc = _hashes(run)
        entry = _found(h, model.hashes)
        hits: dict[int, set[int]] = {}
        for d, e in set(zip(doc[entry >= 0].tolist(), entry[entry >= 0].tolist())):
            hits.setdefault(d, set()).add(e)
        readings: dict[int, list[str]] = {}
        if len(model.hashes):
            owners, spans = [], []
            for d in _suspects(run).tolist():
                text = run.data[run.starts[d] : run.starts[d + 1]].tobytes().decode(errors="replace")
                for span in disguised(text):
                    reading = known.get(span)
                    if reading is None:
                        reading = restored(span, language)
                        if len(span) <= REMEMBERED:
                            if len(known) > 100_000:
                                known.clear()
                            known[span] = reading
                    if reading and reading != span.lower():
                        owners.append(d)
                        spans.append(reading)
            if spans:
                # A disguised word may go on after an entry: its beginnings count as words too.
                read = [
                    " ".join([s, *(w[:n] for w in s.split() for n in range(4, min(len(w), longest + 1)))])
                    for s in spans
                ]
                for again in textnp.plain_runs(pa.array(read)):
                    h, at = _hashes(again)
                    entry = _found(h, model.hashes)
                    for i, e in set(zip(at[entry >= 0].tolist(), entry[entry >= 0].tolist())):
                        d = owners[again.first + i]
                        hits.setdefault(d, set()).add(e)
                        readings.setdefault(d, []).append(spans[again.first + i])
        for d in sorted(hits):
            yield run.first + d, hits[d], sorted(set(readings.get(d, [])))


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, score, entries (found in the restored text), restored (what
    disguised spans with an entry were read as)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(len(batch), model.rest)
            entries: list[list[str]] = [[] for _ in range(len(batch))]
            read: list[list[str]] = [[] for _ in range(len(batch))]
            for i, found, spans in evidence(batch.column(1), model):
                at = sorted(found)
                score[i] = 1 - (1 - model.rest) * float(np.prod(1 - model.precisions[at]))
                entries[i], read[i] = [model.entries[e] for e in at], spans
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(entries, strings), pa.array(read, strings)],
                ["doc_id", "score", "entries", "restored"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, score double, entries array<string>, restored array<string>")
