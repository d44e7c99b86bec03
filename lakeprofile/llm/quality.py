"""Quality classifier from weak labels: EM over heuristic labellers, then a hashed linear scorer.

1. Seven labellers (`LABELLERS`) look at each whole text and vote good, bad or nothing. Their votes
   form a pattern; the documents of each pattern are counted over all documents.
2. Expectation-maximisation on these counts (at most 3 ** 7, whatever the corpus) estimates how
   often each labeller votes what on good texts and on bad ones, and the share of good texts. No true
   label is read. A labeller knows one kind of fault and finds texts with another one good, so bad
   texts are a class for each labeller, and votes are taken as independent within a class, no vote says nothing. It
   starts from the view that complaints hold. What comes out is each labeller's accuracy, and for each
   pattern the posterior of good.
3. A linear scorer is trained on hashed features of words (shape, ending, whether a word repeats its
   neighbour or a passage of the document) with the posterior of the text's pattern as soft label,
   by gradient descent on a sample of at most SAMPLE documents, those with the smallest hashes.
4. The scorer reads every whole text; `keep` is a score of at least THRESHOLD.

Defined results: null, empty or blank texts have no words; their score is 0 and they are rejected.
In an empty table nothing is fitted and nothing scored. Rows that repeat are scored alike. Other
columns are not read; `kept` returns all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm import textnp

SAMPLE = 8192
FEATURES = 1 << 11
THRESHOLD = 0.5
ROUNDS = 100

#: Name, and the measure's range that is voted bad and good: (bad from, bad to, good from, good to).
LABELLERS = {
    "case": (0.5, 2.0, -1.0, 0.15),
    "symbols": (0.05, 2.0, -1.0, 0.015),
    "neighbours": (0.15, 2.0, -1.0, 0.02),
    "passages": (0.4, 2.0, -1.0, 0.1),
    "wordless": (0.15, 2.0, -1.0, 0.03),
    "endings": (0.3, 2.0, -1.0, 0.05),
    "length": (0.5, 2.0, -1.0, 0.5),
}
#: Least share of the texts with a fault of which its labeller complains.
COMPLAINS = 0.95
#: Fewer words give no vote about repetition, fewer letters none about case.
FEW_WORDS, FEW_LETTERS = 10, 20

_SIGNS = np.zeros(256, bool)  # symbols that prose has little of
_SIGNS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = True
_CLASS = np.zeros(256, np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
for _i in range(33, 127):
    if not _CLASS[_i]:
        _CLASS[_i] = _i


@dataclass
class Measured:
    """Measures of the documents of a run, and the hashed features of their words."""

    words: np.ndarray
    measures: dict[str, np.ndarray]
    usable: dict[str, np.ndarray]
    features: np.ndarray  # two for each word
    first: np.ndarray


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def measured(run: textnp.Run) -> Measured:
    data = run.data
    starts, ends, first = textnp.words(run)
    n = np.diff(first)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return np.diff(sums[run.starts])

    def per_doc_words(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return np.diff(sums[first])

    two = np.zeros(len(data), bool)  # after the first byte of Latin letters with marks
    two[1:] = data[:-1] == 0xC3
    upper = ((data >= 65) & (data < 91)) | (two & (data >= 0x80) & (data < 0x9F))
    lower = ((data >= 97) & (data < 123)) | (two & (data >= 0x9F) & (data < 0xC0))
    signs = _SIGNS[data]
    hashes = textnp.word_hashes(run, starts, ends)
    doc = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    # A word is repeated if the three words that end with it came before in the document.
    seen = np.zeros(len(hashes), bool)
    triples = textnp.shingle_hashes(hashes, 3)
    if len(triples):
        key = (doc[2:].astype(np.uint64) << np.uint64(40)) | (triples >> np.uint64(24))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        seen[2:] = again & (doc[2:] == doc[:-2])
    letters = np.concatenate(([0], np.cumsum(textnp.LETTER[data], dtype=np.int64)))
    wordless = letters[ends] == letters[starts]
    last = data[ends - 1] if len(ends) else data[:0]
    length = ends - starts
    mean = _share(per_doc_words_sum(length, first), n)
    n_upper, n_lower = per_doc(upper), per_doc(lower)
    filled = per_doc(~textnp.SPACE[data])
    enough = n >= FEW_WORDS
    measures = {
        "case": _share(n_upper, n_upper + n_lower),
        "symbols": _share(per_doc(signs), filled),
        "neighbours": _share(per_doc_words(same), n),
        "passages": _share(per_doc_words(seen), n),
        "wordless": _share(per_doc_words(wordless), n),
        "endings": _share(per_doc_words(_SIGNS[last]), n),
        "length": ((mean < 2.5) | (mean > 14)).astype(float),
    }
    usable = {name: n > 0 for name in measures}
    usable["case"] = n_upper + n_lower >= FEW_LETTERS
    usable["neighbours"] = usable["passages"] = usable["length"] = enough
    c = _CLASS[data]
    shape = np.zeros(len(starts), np.uint64)
    if len(starts):
        for i, at in enumerate((starts, np.minimum(starts + 1, ends - 1), np.maximum(ends - 2, starts), ends - 1)):
            shape = shape + c[at] * textnp._TURNS[i]
        shape = shape + np.minimum(length, 15).astype(np.uint64) * textnp._TURNS[5]
    flags = (same * 2 + seen).astype(np.uint64)
    ending = (flags + np.uint64(1)) * textnp._TURNS[6] + (c[ends - 1] if len(ends) else shape) * textnp._TURNS[7]
    size = np.uint64(FEATURES)
    features = np.stack([textnp.mix(shape) % size, textnp.mix(ending) % size], 1).astype(np.int64)
    return Measured(n, measures, usable, features, first)


def per_doc_words_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return np.diff(sums[first])


def votes(m: Measured) -> np.ndarray:
    """Per document and labeller 2 for good, 1 for bad, 0 for no vote."""
    out = np.zeros((len(m.words), len(LABELLERS)), np.int64)
    for i, (name, (bad, bad_to, good, good_to)) in enumerate(LABELLERS.items()):
        x = m.measures[name]
        vote = np.where((x >= bad) & (x <= bad_to), 1, np.where((x >= good) & (x < good_to), 2, 0))
        out[:, i] = np.where(m.usable[name], vote, 0)
    return out


_PLACES = 3 ** np.arange(len(LABELLERS))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.zeros(3 ** len(LABELLERS), np.int64)
        for run in textnp.runs(batch.column(0)):
            m = measured(run)
            own = (votes(m) * _PLACES).sum(1)[m.words > 0]
            counts += np.bincount(own, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["pattern", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {"h": [], "pattern": [], "n": [], "at": [], "times": []}
        for run in textnp.runs(batch.column(1)):
            m = measured(run)
            own = (votes(m) * _PLACES).sum(1)
            for i in np.flatnonzero(m.words).tolist():
                at, times = np.unique(m.features[m.first[i] : m.first[i + 1]], return_counts=True)
                for name, value in zip(rows, (batch.column(0)[run.first + i].as_py(), int(own[i]),
                                              int(m.words[i]), at.tolist(), times.tolist())):
                    rows[name].append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS):
    """Posterior of good for each pattern, share of good texts, and each labeller's accuracy: how
    often it is right where it votes."""
    v = patterns[:, None] // _PLACES[None, :] % 3
    bad, each = v == 1, np.arange(len(LABELLERS))
    complaints = bad.sum(1, keepdims=True)
    good = np.where(complaints > 0, 0.1 / complaints.clip(1), np.where((v == 2).any(1, keepdims=True), 0.9, 0.5))
    kinds = np.where(complaints > 0, bad / complaints.clip(1), 1 / len(LABELLERS))
    share = np.concatenate((good, (1 - good) * kinds), axis=1)  # of the good class, and of the bad ones
    for _ in range(rounds):
        weight = counts[:, None] * share
        prior = (weight.sum(0) + 0.01) / (weight.sum() + 0.01 * weight.shape[1])
        complains = (weight.T @ bad + 0.1) / (weight.T @ (v > 0) + 0.2)  # of the votes, by class
        # The labeller of a bad class complains of it nearly always.
        complains[each + 1, each] = np.maximum(complains[each + 1, each], COMPLAINS)
        odds = np.log(prior) + bad @ np.log(complains).T + (v == 2) @ np.log(1 - complains).T
        odds = np.exp(odds - odds.max(1, keepdims=True))
        now = odds / odds.sum(1, keepdims=True)
        moved = np.abs(now - share).max()
        share = now
        if moved < 1e-9:
            break
    good = share[:, 0]
    right = counts @ ((v == 2) * good[:, None] + bad * (1 - good[:, None]))
    voted = counts @ (v > 0)
    accuracy = dict(zip(LABELLERS, (right / np.maximum(voted, 1)).tolist()))
    return good, float((counts * good).sum() / counts.sum()), accuracy


@dataclass
class Model:
    """Posterior by vote pattern, share of good texts, labellers' accuracies, weights and offset."""

    posterior: dict[int, float]
    prior: float
    accuracy: dict[str, float]
    weights: np.ndarray
    offset: float


def _trained(every: np.ndarray, y: np.ndarray, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam; both classes weigh alike."""
    used = np.flatnonzero(every.any(0))
    x = np.ascontiguousarray(every[:, used])
    share = min(max(float(y.mean()), 0.01), 0.99)
    weight = (y * 0.5 / share + (1 - y) * 0.5 / (1 - share)).astype(np.float32) / len(y)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        e = (p - y) * weight
        g = np.concatenate((x.T @ e + 1e-5 * w, [e.sum()])).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    out = np.zeros(every.shape[1])
    out[used] = w
    return out, float(b)


def fit(docs: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> Model | None:
    """The model of a table of documents; None if none of them has a word."""
    rows = docs.select(
        F.xxhash64(id_column, text_column).alias("h"), F.col(text_column).alias("text")
    )
    found = rows.select("text").mapInArrow(_patterns, "pattern long, n long")
    found = found.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not found:
        return None
    patterns, counts = (np.array([r[i] for r in found], np.int64) for i in (0, 1))
    good, prior, accuracy = expectation_maximisation(patterns, counts)
    posterior = dict(zip(patterns.tolist(), good.tolist()))
    # Hashes are even, so this bound leaves about as many documents as wanted; the limit is exact.
    share = min(1.0, sample / counts.sum())
    bound = int(min((1 << 63) - 1, share * (1 << 64) - (1 << 63)))
    ddl = "h long, pattern long, n long, at array<long>, times array<long>"
    some = rows.where(F.col("h") <= bound).mapInArrow(_examples, ddl)
    some = some.orderBy("h", "pattern", "n").limit(sample).collect()
    x = np.zeros((len(some), FEATURES), np.float32)
    for i, r in enumerate(some):
        x[i, r["at"]] = np.array(r["times"]) / r["n"]
    y = np.array([posterior[r["pattern"]] for r in some], np.float32)
    weights, offset = _trained(x, y) if len(some) else (np.zeros(FEATURES), 0.0)
    return Model(posterior, prior, accuracy, weights, offset)


def _scores(texts: pa.Array, model: Model):
    """Score, posterior of the labellers, and words of each text."""
    for run in textnp.runs(texts):
        m = measured(run)
        sums = np.concatenate(([0.0], np.cumsum(model.weights[m.features].sum(1))))
        mean = _share(np.diff(sums[m.first]), m.words)
        score = np.where(m.words > 0, 1 / (1 + np.exp(-np.clip(mean + model.offset, -30, 30))), 0.0)
        own = (votes(m) * _PLACES).sum(1)
        weak = np.array([model.posterior.get(p, model.prior) for p in own.tolist()])
        yield run.first, score, np.where(m.words > 0, weak, 0.0), m.words


def scored(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score (of the scorer), weak_label (posterior of the labellers), n_words, keep."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, score double, weak_label double, n_words long, keep boolean"
    if model is None:
        none = F.lit(0.0)
        return rows.select("doc_id", none.alias("score"), none.alias("weak_label"),
                           F.lit(0).cast("long").alias("n_words"), F.lit(False).alias("keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_scores(batch.column(1), model))
            score, weak, n = (np.concatenate([f[i] for f in found] or [np.zeros(0)]) for i in (1, 2, 3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(weak), pa.array(n.astype(np.int64)),
                 pa.array(score >= THRESHOLD)],
                ["doc_id", "score", "weak_label", "n_words", "keep"],
            )

    return rows.mapInArrow(run, ddl)


def kept(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """The rows of docs that the scorer keeps, with all their columns."""
    if model is None:
        return docs.limit(0)
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([s for _, s, _, _ in _scores(batch.column(place), model)] or [np.zeros(0)])
            yield batch.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
