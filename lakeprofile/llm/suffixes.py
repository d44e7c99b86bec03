"""Removal of repeated text by bucket-pointer refinement of suffixes.

Every byte goes that a string of `window` bytes covers which also starts earlier, in a smaller
document or further left. All windows are judged on the input.

Initial buckets: the smallest of the `gram`-byte grams of a window (by hash) names its bucket, so
equal windows share one, and neighbouring windows with the same smallest gram travel as one segment.

1. Grams in very many different segments are counted over all documents (a table of fixed size).
2. Segments are dealt by bucket. All but the first of equal segments are removed. Where a bucket
   holds one distinct segment, nothing else in it repeats. Copies within a batch are settled before
   the shuffle, so many copies of one text cost no more there than one.
3. The other distinct segments bring their bytes to their bucket and are refined (`refined`):
   positions get the pointer of their gram's bucket; sorting on the pair of pointers at a position
   and `gram` further gives pointers for twice the length, and these are used again for four times
   it, until the length of a window is reached. Positions that are alone in a bucket drop out at
   every level. Buckets of very frequent grams could be as large as the input; their windows are
   dealt one by one, by their hash, after those that repeat within a batch are settled.
4. Removed windows are merged into spans for each text.

Defined results: null is an empty text; texts shorter than the window keep all; text is UTF-8 and a
span may cut a character in two, so what is kept is bytes. Rows that agree in id and text are one
document; rows that agree in id alone are ordered by a hash of their text. Null ids come first.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm import shared, textnp, windows

WINDOW = 100
GRAM = 20
#: A gram in so many different segments is frequent; its table keeps the most frequent ones.
FREQUENT = 256
FREQUENT_TABLE = 1 << 18
#: Bytes of whole buckets that a task refines at once.
GROUP = 1 << 20

REMOVED, OPEN, OPEN_FREQUENT = 0, 1, 2
FOUND = pa.schema([("g", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()),
                   ("kind", pa.int8())])
FOUND_DDL = "g long, key long, start int, n int, kind byte"
PIECE_DDL = "kind byte, g long, key long, start int, n int, data binary"
PIECE = pa.schema([("kind", pa.int8()), ("g", pa.int64()), ("key", pa.int64()), ("start", pa.int32()),
                   ("n", pa.int32()), ("data", pa.binary())])


def _batch(schema: pa.Schema, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema)


def _of_batch(texts: pa.Array, window: int, gram: int):
    """All segments of a batch: row, start, n, gram hash, content hash."""
    found = []
    for run in textnp.runs(texts):
        s = windows.segments(run, window, gram)
        if s is not None:
            found.append((s.doc + run.first, s.start.astype(np.int32), s.n.astype(np.int32), s.gram, s.content))
    return [np.concatenate(a) for a in zip(*found)] if found else None


def _frequent(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _of_batch(batch.column(0), window, gram)
            if found is None:
                continue
            pairs = np.unique(np.stack(found[3:], 1).view([("m", "u8"), ("s", "u8")]))
            m, n = np.unique(pairs["m"], return_counts=True)
            often = n >= 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(m[often].view(np.int64)), pa.array(n[often])], ["m", "n"]
            )

    return run


def _firsts(group: np.ndarray, content: np.ndarray, key: np.ndarray, start: np.ndarray):
    """Sort order by group, content, key and start, and which rows are the first of their content."""
    order = np.lexsort((start, key, content, group))
    group, content = group[order], content[order]
    first = np.ones(len(order), bool)
    first[1:] = (group[1:] != group[:-1]) | (content[1:] != content[:-1])
    return order, first


def _dealt(window: int, gram: int, frequent: np.ndarray, buckets: int):
    """Packs of segments by bucket; repeats within a batch are already settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _of_batch(batch.column(1), window, gram)
            if found is None:
                continue
            doc, start, n, m, s = found
            key = batch.column(0).to_numpy(zero_copy_only=False)[doc]
            order, first = _firsts(m, s, key, start)
            doc, start, n, m, s, key = (a[order] for a in (doc, start, n, m, s, key))
            often = np.zeros(len(m), bool)
            if len(frequent):
                often = frequent[np.minimum(np.searchsorted(frequent, m), len(frequent) - 1)] == m
            by = np.where(often, s, m) >> np.uint64(32)
            bucket = (by * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            kind = np.where(first, np.where(often, OPEN_FREQUENT, OPEN), REMOVED).astype(np.int8)
            low = (np.where(often, s, m) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            order = np.lexsort((start, key, kind, bucket))
            bucket, kind = bucket[order], kind[order]
            low, s, key, start, n = (a[order] for a in (low, s, key, start, n))
            turn = np.flatnonzero((np.diff(bucket, prepend=-1, append=-1) != 0)
                                  | (np.diff(kind, prepend=-1, append=-1) != 0))
            rows = {c: [] for c in PACK.names}
            for a, b in zip(turn[:-1].tolist(), turn[1:].tolist()):
                gone = kind[a] == REMOVED
                for name, value in zip(PACK.names, (
                    int(bucket[a]), int(kind[a]), b"" if gone else low[a:b].tobytes(),
                    b"" if gone else s[a:b].tobytes(), key[a:b].tobytes(), start[a:b].tobytes(),
                    n[a:b].astype(np.uint8).tobytes(),
                )):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, PACK)

    return run


PACK = pa.schema([("bucket", pa.int32()), ("kind", pa.int8())]
                 + [(c, pa.binary()) for c in ("low", "s", "key", "start", "n")])
PACK_DDL = "bucket int, kind byte, low binary, s binary, key binary, start binary, n binary"


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's packs the removed segments, and those to be refined."""
    held = []
    for batch in batches:
        for bucket, kind, low, s, key, start, n in zip(*(batch.column(i).to_pylist() for i in range(7))):
            key, start = np.frombuffer(key, np.int64), np.frombuffer(start, np.int32)
            n = np.frombuffer(n, np.uint8).astype(np.int32)
            if kind == REMOVED:
                yield _batch(FOUND, np.zeros(len(key), np.int64), key, start, n, np.zeros(len(key), np.int8))
            else:
                g = (np.frombuffer(low, np.uint32).astype(np.int64) << 24) | bucket << 2 | kind
                held.append((g, np.frombuffer(s, np.uint64), key, start, n))
    if not held:
        return
    g, s, key, start, n = (np.concatenate(a) for a in zip(*held))
    held.clear()
    order, first = _firsts(g, s, key, start)
    g, s, key, start, n = (a[order] for a in (g, s, key, start, n))
    kind = (g & 3).astype(np.int8)
    new = np.flatnonzero(np.diff(g, prepend=g[0] - 1, append=g[-1] - 1))
    distinct = np.repeat(np.add.reduceat(first.astype(np.int64), new[:-1]), np.diff(new))
    wanted = ~first | (distinct > 1) | (kind == OPEN_FREQUENT)
    kind[~first] = REMOVED
    for i in range(0, int(wanted.sum()), 100_000):
        at = np.flatnonzero(wanted)[i : i + 100_000]
        yield _batch(FOUND, g[at], key[at], start[at], n[at], kind[at])


def _ranks(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New bucket pointers from pairs of pointers below 2**32, and how many share each."""
    both = parts[0] if len(parts) == 1 else parts[0].astype(np.uint64) << np.uint64(32) | parts[1].astype(np.uint64)
    _, to, n = np.unique(both, return_inverse=True, return_counts=True)
    return to, n[to]


def refined(data: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket-pointer refinement of the windows that start at `at` in `data`.

    Returns which of them share all their bytes with another one, as numbers into `at`, and a
    pointer that is equal for equal windows.
    """
    own = np.arange(len(at))
    grams = windows.Sums(data).every(gram)
    pointer, many = _ranks(grams)
    steps = range(0, window - gram + 1, gram)
    for step in steps:  # a window with a gram of its own is alone
        own = own[many[at[own] + step] > 1]
    have = gram  # `pointer` holds for this length at every place of `places`
    places, known = None, pointer
    while True:
        look = (lambda p, k=known, at_=places: k[p] if at_ is None else k[np.searchsorted(at_, p)])
        if 2 * have > window or not len(own):
            break
        ends = range(0, window - 2 * have + 1, 2 * have)
        wanted = np.unique(np.concatenate([at[own] + e for e in ends]))
        pair, shared_by = _ranks(look(wanted), look(wanted + have))
        if have == gram:
            base = look
        places, known, have = wanted, pair, 2 * have
        for e in ends:
            own = own[shared_by[np.searchsorted(places, at[own] + e)] > 1]
    if not len(own):
        return own, own
    # What is left of a window beyond the last doubled lengths is covered by grams.
    look = (lambda p, k=known, at_=places: k[p] if at_ is None else k[np.searchsorted(at_, p)])
    first = look if places is None else base
    last = look(at[own])
    covered = have
    while covered < window:
        step = have if places is not None and covered + have <= window else gram
        step_at = min(covered, window - step)
        source = look if step == have and step_at % have == 0 else first
        last, _ = _ranks(last, source(at[own] + step_at))
        covered = step_at + step
    _, to, n = np.unique(last, return_inverse=True, return_counts=True)
    return own[n[to] > 1], to[n[to] > 1]


def _pieces(window: int, buckets: int):
    """Bytes of open segments; of those of frequent grams the hashes of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = {c: [] for c in PIECE.names}
            often = []
            for key, z, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = unpack.decompress(z)
                for x in found:
                    data = text[x["start"] : x["start"] + x["n"] + window - 1]
                    if x["kind"] == OPEN_FREQUENT:
                        often.append((key, x["start"], x["n"], data))
                        continue
                    for name, value in zip(PIECE.names, (OPEN, x["g"], key, x["start"], x["n"], data)):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, PIECE)
            if often:
                yield from spread(often)

    def spread(often):
        data = np.frombuffer(b"".join(o[3] for o in often), np.uint8)
        key, start, n = (np.array([o[i] for o in often], np.int64) for i in range(3))
        at, own = _window_starts(n, np.array([len(o[3]) for o in often]))
        start = start[own] + at - np.repeat(_offsets(np.array([len(o[3]) for o in often])), n)
        key = key[own]
        h = windows.Sums(data).of(at, at + window)
        h2 = windows.Sums(data, windows._SECOND).of(at, at + window)
        order, first = _firsts(h, h2, key, start)
        h, h2, key, start = (a[order] for a in (h, h2, key, start))
        yield from _merged(key[~first], start[~first], lambda k, s, n: _batch(
            PIECE, np.full(len(k), REMOVED), k, k, s, n, np.full(len(k), b"", object)))
        h, h2, key, start = (a[first] for a in (h, h2, key, start))
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        turn = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        rows = {c: [] for c in PIECE.names}
        for a, b in zip(turn[:-1].tolist(), turn[1:].tolist()):
            packed = b"".join(x[a:b].tobytes() for x in (h, h2, key, start))
            for name, value in zip(PIECE.names, (OPEN_FREQUENT, int(bucket[a]), 0, 0, b - a, packed)):
                rows[name].append(value)
        yield pa.RecordBatch.from_pydict(rows, PIECE)

    return run


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _window_starts(n: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows of segments laid end to end, and the segment of each."""
    own = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(_offsets(n), n) + _offsets(lengths)[own], own


def _merged(key: np.ndarray, start: np.ndarray, out) -> Iterator[pa.RecordBatch]:
    """Windows one by one as runs of neighbours."""
    if len(key):
        order = np.lexsort((start, key))
        key, start = key[order], start[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
        at = np.flatnonzero(new)
        yield out(key[at], start[at].astype(np.int32), np.diff(at, append=len(key)).astype(np.int32))


def _groups(segments: list[tuple]) -> Iterator[list[tuple]]:
    """Whole buckets of segments, of about GROUP bytes together: equal windows lie in one bucket, and
    refinement takes many times the bytes that it works on. Given segments are forgotten."""
    segments.sort(key=lambda s: s[0], reverse=True)
    while segments:
        group, size = [], 0
        while segments and (size < GROUP or segments[-1][0] == group[-1][0]):
            group.append(segments.pop())
            size += len(group[-1][4])
        yield group


def _refined(window: int, gram: int):
    def removed(k, s, n):
        return _batch(FOUND, np.zeros(len(k), np.int64), k, s, n, np.zeros(len(k), np.int8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, hashed = [], []
        for batch in batches:
            for kind, g, key, start, n, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if kind == REMOVED:
                    yield removed(*(np.array([x]) for x in (key, start, n)))
                elif kind == OPEN:
                    segments.append((g, key, start, n, data))
                else:
                    parts = [np.frombuffer(data, t, n, 8 * n * i)
                             for i, t in enumerate((np.uint64, np.uint64, np.int64, np.int64))]
                    hashed.append(parts)
        for group in _groups(segments):
            data = np.frombuffer(b"".join(s[4] for s in group), np.uint8)
            lengths = np.array([len(s[4]) for s in group])
            key, start, n = (np.array([s[i] for s in group], np.int64) for i in (1, 2, 3))
            at, own = _window_starts(n, lengths)
            which, pointer = refined(data, at, window, gram)
            own = own[which]
            key, start = key[own], start[own] + at[which] - _offsets(lengths)[own]
            order, first = _firsts(pointer, pointer, key, start)
            yield from _merged(key[order][~first], start[order][~first], removed)
        if hashed:
            h, h2, key, start = (np.concatenate(a) for a in zip(*hashed))
            order, first = _firsts(h, h2, key, start)
            yield from _merged(key[order][~first], start[order][~first], removed)

    return run


def _cut_out(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = {"key": [], "kept": [], "n_bytes": [], "spans": []}
            for key, z, gone in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = unpack.decompress(z)
                spans = []
                for x in sorted(gone or (), key=lambda x: x["start"]):
                    a, b = x["start"], x["start"] + x["n"] + window - 1
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                kept = text if not spans else b"".join(
                    text[a:b] for a, b in zip([0] + [s[1] for s in spans], [s[0] for s in spans] + [len(text)])
                )
                for name, value in zip(rows, (key, kept, len(text), [{"start": a, "stop": b} for a, b in spans])):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, OUT)

    return run


OUT = pa.schema([("key", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()),
                 ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
OUT_DDL = "key long, kept binary, n_bytes long, spans array<struct<start: long, stop: long>>"


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, text) with one row per document, and the rows' keys where ids do not serve as keys."""
    simple = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    n, distinct = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if simple and n == distinct:
        return docs.select(F.col("doc_id").cast("long").alias("key"), "text"), None
    hashed = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.sha2("text", 256))
    once = shared.ranked(hashed.dropDuplicates(["doc_id", "h"]), [F.col("doc_id"), F.col("h")], "key")
    once = shared.cut(once, "keyed")
    keys = hashed.alias("a").join(
        once.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.h = b.h")
    ).select("a.doc_id", "b.key")
    return once.select("key", "text"), keys


def deduplicated(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, kept (bytes), n_bytes, spans (start and stop of what went)."""
    if not 1 < gram <= window or window - gram > 250:
        raise ValueError("a gram is at most a window long, and at least 250 bytes shorter are too many")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    keyed, keys = _keyed(rows)
    top = (
        keyed.select("text").mapInArrow(_frequent(window, gram), "m long, n long")
        .groupBy("m").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
        .orderBy(F.desc("n"), "m").limit(FREQUENT_TABLE)
    )
    frequent = np.sort(np.array([r[0] for r in top.select("m").collect()], np.int64).view(np.uint64))
    buckets = min(shared.parts(spark, rows.count(), 5000), 1 << 20)
    packs = keyed.mapInArrow(_dealt(window, gram, frequent, buckets), PACK_DDL)
    found = shared.cut(packs.repartition(buckets, "bucket").mapInArrow(_settled, FOUND_DDL), "segments")

    texts = shared.packed_texts(keyed, "key", "text")
    wanted = found.where(F.col("kind") > 0).groupBy("key").agg(
        F.collect_list(F.struct("g", "start", "n", "kind")).alias("found")
    )
    pieces = texts.join(wanted, "key").select("key", "z", "found").mapInArrow(_pieces(window, buckets), PIECE_DDL)
    more = pieces.repartition(buckets, "g").mapInArrow(_refined(window, gram), FOUND_DDL)
    more = shared.cut(more.select("key", "start", "n"), "refined")

    gone = found.where(F.col("kind") == 0).select("key", "start", "n").unionByName(more)
    gone = gone.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    out = texts.join(gone, "key", "left").select("key", "z", "gone").mapInArrow(_cut_out(window), OUT_DDL)
    if keys is None:
        return out.withColumnRenamed("key", "doc_id")
    return keys.join(out, "key").drop("key")
