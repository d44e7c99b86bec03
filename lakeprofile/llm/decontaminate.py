"""Benchmark decontamination: SimHash of item-sized windows, multi-index search, exact similarity.

Words are runs of letters and digits (by Unicode class), lowered; shingles are `k` of them in a row (the whole item,
where it has fewer words), and the similarity of a window and an item is the weighted Jaccard
coefficient of their shingles, each weighing as often as it occurs: sum of minima over sum of
maxima. A window is laid wherever a document's shingle also stands in an item, so that the two stand
at the same place, and is as long as the item: a window without any shingle of the item has
similarity 0. Each window gets a 64-bit SimHash. Its eight bytes are looked up in eight tables: two
fingerprints within RADIUS = 23 bits have a byte in which they differ in 2 bits at most, so the
tables give every item within the radius, and the full distance settles which these are. The exact
similarity decides. (Windows as similar as `least` = 0.75 differ in 11 of 64 bits on average.)

The items are the query set: they are collected in blocks of at most ITEMS, and every block is held
against all documents; documents are read where they lie and never shuffled.

Defined results: null and empty texts or items match nothing; items that are equal are all
reported; of equally similar windows the first counts; rows with one id are one document in `leaks`,
while `clean` judges row by row. Other columns are not read, and `clean` returns all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm import textnp

K = 5
LEAST = 0.75
RADIUS = 23
ITEMS = 4096


@dataclass
class Items:
    """A block of items: ids, sizes in words, bags of shingles, fingerprints and their tables."""

    ids: list
    words: np.ndarray
    bags: list[tuple[np.ndarray, np.ndarray]]
    prints: np.ndarray
    near: np.ndarray
    #: For each shingle length: sorted shingles, and the item and place of each.
    shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def fingerprints(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each stretch of shingles; a bit is set where more of them have it."""
    out = np.zeros(len(ends), np.uint64)
    begin = np.concatenate(([0], ends[:-1]))
    for i in range(0, len(ends), 4096):
        a, b = int(begin[i]), int(ends[min(i + 4096, len(ends)) - 1])
        bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
        sums = np.add.reduceat(bits, begin[i : i + 4096] - a, axis=0)
        out[i : i + 4096] = np.packbits(sums > 0, axis=1).view(np.uint64)[:, 0]
    return out


def _near(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each byte of a fingerprint and each of its values the items that close in that byte."""
    parts = prints.view(np.uint8).reshape(-1, 8)
    apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[None, :, None] ^ parts.T[:, None, :])
    return apart <= radius // 8


def _item_shingles(run: textnp.Run, k: int) -> list[np.ndarray]:
    return textnp.shingles(run, k, textnp.SYMBOL)


def prepared(rows: list[tuple], k: int = K, radius: int = RADIUS) -> Items | None:
    """A block of items, from (id, text) rows; items without words are left out."""
    texts = pa.array([t for _, t in rows], pa.string())
    ids, words, found = [], [], []
    for run in textnp.plain_runs(texts):
        starts, _, first = textnp.words(run, textnp.SYMBOL)
        for i, s in enumerate(_item_shingles(run, k)):
            if len(s):
                ids.append(rows[run.first + i][0])
                words.append(int(first[i + 1] - first[i]))
                found.append(s)
    if not ids:
        return None
    words = np.array(words)
    lists: dict[int, tuple[list, list, list]] = {}
    for j, s in enumerate(found):
        at = lists.setdefault(min(k, int(words[j])), ([], [], []))
        at[0].append(s)
        at[1].append(np.full(len(s), j))
        at[2].append(np.arange(len(s)))
    tables = {}
    for length, parts in lists.items():
        x, j, o = (np.concatenate(p) for p in parts)
        order = np.argsort(x, kind="stable")
        tables[length] = x[order], j[order], o[order]
    prints = fingerprints(np.concatenate(found), np.cumsum([len(s) for s in found]))
    bags = [np.unique(s, return_counts=True) for s in found]
    return Items(ids, words, bags, prints, _near(prints, radius), tables)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard coefficient of two bags (sorted shingles, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / (int(a[1].sum()) + int(b[1].sum()) - least)


def _windows(items: Items, hashes: np.ndarray, first: np.ndarray, k: int):
    """Windows (document, first word, words, shingle length) that stand over a shared shingle."""
    total = len(hashes)
    found = []
    doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for length, (x, item, place) in items.shingles.items():
        every = textnp.shingle_hashes(hashes, length)
        if length < k:  # as a whole text of so many words is hashed
            every = every ^ textnp._TURNS[20 + length % 40]
        if not len(every):
            continue
        low = np.minimum(np.searchsorted(x, every), len(x) - 1)
        at = np.flatnonzero(x[low] == every)
        at = at[doc_of[at] == doc_of[np.minimum(at + length - 1, total - 1)]]
        if not len(at):
            continue
        lo, hi = np.searchsorted(x, every[at], "left"), np.searchsorted(x, every[at], "right")
        many = hi - lo
        which = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        at = np.repeat(at, many)
        doc = doc_of[at]
        begin = np.maximum(at - place[which], first[doc])
        stop = np.minimum(at - place[which] + items.words[item[which]], first[doc + 1])
        found.append(np.stack([doc, begin, stop - begin, np.full(len(at), length)], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)


def matches(texts: pa.Array, items: Items, k: int, least: float, radius: int) -> Iterator[tuple]:
    """(row, item, similarity, distance, first word, words), best window of each row and item."""
    for run in textnp.plain_runs(texts):
        starts, ends, first = textnp.words(run, textnp.SYMBOL)
        if not len(starts):
            continue
        hashes = textnp.word_hashes(run, starts, ends)
        spans = _windows(items, hashes, first, k)
        best: dict[tuple[int, int], tuple] = {}
        for length in np.unique(spans[:, 3]).tolist():
            own = spans[spans[:, 3] == length]
            own = own[own[:, 2] >= length]
            if not len(own):
                continue
            every = textnp.shingle_hashes(hashes, length)
            if length < k:
                every = every ^ textnp._TURNS[20 + length % 40]
            many = own[:, 2] - length + 1
            ends_at = np.cumsum(many)
            at = np.repeat(own[:, 1] - (ends_at - many), many) + np.arange(int(ends_at[-1]))
            shingles = every[at]
            prints = fingerprints(shingles, ends_at)
            for i in range(0, len(own), 512):
                some = prints[i : i + 512]
                parts = some.view(np.uint8).reshape(-1, 8)
                close = items.near[0][parts[:, 0]]
                for b in range(1, 8):
                    close = close | items.near[b][parts[:, b]]
                window, item = np.nonzero(close)
                apart = np.bitwise_count(some[window] ^ items.prints[item])
                within = apart <= radius
                bag, bag_of = None, -1
                for w, j, d in zip(window[within].tolist(), item[within].tolist(), apart[within].tolist()):
                    if bag_of != w:
                        a, b = int(ends_at[i + w] - many[i + w]), int(ends_at[i + w])
                        bag, bag_of = np.unique(shingles[a:b], return_counts=True), w
                    score = similarity(bag, items.bags[j])
                    if score >= least:
                        doc, begin, size, _ = own[i + w].tolist()
                        key = (doc, j)
                        value = (-score, begin - int(first[doc]), size, d)
                        if key not in best or value < best[key]:
                            best[key] = value
        for (doc, j), (score, begin, size, d) in sorted(best.items()):
            yield run.first + doc, j, -score, d, begin, size


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, k: int, radius: int):
    """The items in blocks of a bounded size."""
    rows = benchmark.select(F.col(item_column).alias("i"), F.col(text_column).alias("t"))
    n = -(-rows.count() // (ITEMS // 2)) or 1  # blocks by hash hold half of the bound on average
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        made = prepared([tuple(r) for r in part.collect()], k, radius)
        if made is not None:
            yield made


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    k: int = K,
    least: float = LEAST,
    radius: int = RADIUS,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, similarity, distance, first_word,
    n_words (place and length of the best window)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kinds = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    ddl = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, distance int, first_word long, n_words long"

    def against(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(matches(batch.column(1), items, k, least, radius))
                at = pa.array([f[0] for f in found], pa.int64())
                names = [items.ids[f[1]] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array(names, _arrow(items.ids)),
                     pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int32()),
                     pa.array([f[4] for f in found], pa.int64()), pa.array([f[5] for f in found], pa.int64())],
                    ["doc_id", "item_id", "similarity", "distance", "first_word", "n_words"],
                )

        return run

    out = None
    for items in _blocks(benchmark, item_column, item_text_column, k, radius):
        part = rows.mapInArrow(against(items), ddl)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], ddl)
    order = F.struct((-F.col("similarity")).alias("s"), "first_word", "n_words", "distance")
    return out.groupBy("doc_id", "item_id").agg(F.min(order).alias("b")).select(
        "doc_id", "item_id", (-F.col("b.s")).alias("similarity"), "b.distance", "b.first_word", "b.n_words"
    )


def _arrow(values: list) -> pa.DataType:
    return pa.array(values).type


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    k: int = K,
    least: float = LEAST,
    radius: int = RADIUS,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, with all their columns."""
    place = docs.columns.index(text_column)
    out = docs
    for items in _blocks(benchmark, item_column, item_text_column, k, radius):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = np.ones(len(batch), bool)
                for found in matches(batch.column(place), items, k, least, radius):
                    held[found[0]] = False
                yield batch.filter(pa.array(held))

        out = out.mapInArrow(run, docs.schema)
    return out
