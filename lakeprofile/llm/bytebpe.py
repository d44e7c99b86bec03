"""Byte-level BPE over a corpus: long texts in overlapping chunks, stitched where pre-tokens agree.

A text is cut into pre-tokens by `PATTERN`, and each is encoded on its own by a table of ranks. A text
of at most CHUNK bytes is one chunk and is encoded where it is read. A longer one becomes chunks that
overlap by OVERLAP bytes and spread over the cluster:

1. Each chunk is pre-tokenised by itself.
2. Two neighbours are stitched at the first place of their overlap where both have a boundary. A
   boundary counts if the chunk's end can't move it, and if SETTLED pre-tokens of its chunk lie before
   it: a chunk that starts inside a pre-token has a false boundary after two of them at most (a
   contraction read from its apostrophe on), since an end of letters, digits or signs before white
   space, and of letters or digits before anything else, is a boundary whatever stands before.
3. What lies between two stitches is a part, and the pre-tokens of a part are encoded. Where an overlap
   has no common boundary (one pre-token fills it) its chunks make one part and are cut anew together,
   so a part is longer than a chunk only by the length of single pre-tokens.

Which characters are letters, digits and white space is read from tiktoken, whose Unicode tables may
be newer or older than Python's. Decoding concatenates the bytes of the ids.

Defined results: null is an empty text, of no ids; null and repeated ids are documents like others, each
row with its own result; an empty table gives an empty one. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeprofile.llm import shared, textnp

#: The pattern of pre-tokens, as the ranks were made for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1 << 15
OVERLAP = 1 << 10
SETTLED = 3
#: Pre-tokens that a worker remembers, and their longest.
REMEMBERED, LONGEST = 200_000, 64

LETTER, DIGIT, SIGN, SPACE = range(4)


@cache
def classes() -> np.ndarray:
    """The class of every code point, as tiktoken has it."""
    own = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, SIGN, np.uint8)
    for name, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=own, special_tokens={})
        text = bytes(found.encode_ordinary(every)).decode()  # only what the pattern matches
        table[np.frombuffer(text.encode("utf-32-le"), np.uint32)] = name
    return table


def pretokens(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of some texts start, as places in their bytes laid end to end, and the
    end of all. `starts` are the places of the texts, with the end of the last."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(at)
    if not n:
        return np.zeros(1, np.int64)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = classes()[code]
    first = np.zeros(n + 1, bool)  # a text starts here
    first[np.searchsorted(at, starts)] = True
    begin = np.ones(n, bool)
    begin[1:] = (kind[1:] != kind[:-1]) | first[1:n]

    run = np.flatnonzero(begin)
    stop = np.append(run[1:], n)
    followed = ~first[stop]  # by another run of the same text
    followed[-1] = False
    what = kind[run]

    # White space before something else: its last character is by itself, or joins if it is a blank.
    gap = np.flatnonzero((what == SPACE) & followed)
    blank = code[stop[gap] - 1] == 0x20
    begin[stop[gap] - 1] = True
    begin[stop[gap[blank]]] = False
    joined = np.zeros(len(run) + 1, bool)
    joined[gap[blank] + 1] = True

    # A lone apostrophe that starts a pre-token, before letters that make a contraction.
    quote = (what == SIGN) & followed & (stop - run == 1) & (code[run] == 0x27) & ~joined[:-1]
    quote = np.flatnonzero(quote)
    quote = quote[what[quote + 1] == LETTER]
    a, end = stop[quote], stop[quote + 1]
    one = code[a]
    two = np.where(a + 1 < end, code[np.minimum(a + 1, n - 1)], 0)
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    short = np.isin(one, [ord(c) for c in "stmd"])
    for hit, length in ((short, 1), (long, 2)):
        begin[a[hit]] = False
        rest = a[hit] + length
        begin[rest[rest < n]] = True
    return np.append(at[begin], len(data))


class Encoder(dict):
    """Ids of pre-tokens, as little-endian 32-bit numbers, remembered by the pre-token's bytes."""

    def __init__(self, ranks: str):
        super().__init__()
        pairs = (line.split() for line in ranks.encode().splitlines() if line.strip())
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        # The whole of what it is given is one pre-token.
        self.whole = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=table, special_tokens={})
        self.bytes = {rank: token for token, rank in table.items()}

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(self.whole.encode_ordinary(piece.decode()), "<u4").tobytes()
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def ids(self, data: bytes, places: list[int]) -> bytes:
        """The ids of the pre-tokens between each place and the next."""
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join([self[data[a:b]] for a, b in zip(places, places[1:])])

    def text(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def encoder(ranks: str) -> Encoder:
    return Encoder(ranks)


def ids_of(texts: pa.Array, own: Encoder) -> Iterator[bytes]:
    """The ids of each text, in order."""
    for run in textnp.runs(texts):
        places = pretokens(run.data, run.starts)
        cut = np.searchsorted(places, run.starts).tolist()
        places, data = places.tolist(), run.data.tobytes()
        for a, b in zip(cut, cut[1:]):
            yield own.ids(data, places[a : b + 1])


def _short(docs: DataFrame, ranks: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        for batch in shared.sliced(batches, 512):
            ids = pa.array(ids_of(batch.column(1), own), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


# Long texts


def chunk_places(data: bytes, chunk: int) -> list[int]:
    """Where the chunks of a text start, each at a whole character, and its end."""
    places = []
    for at in range(0, len(data), chunk):
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        if at < len(data):
            places.append(at)
    return [*dict.fromkeys(places), len(data)]


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(doc, doc_id, chunk, last, start, core, data): of each text its chunks; `core` is where the next starts."""
    kind = docs.schema["doc_id"].dataType
    names = ["doc", "doc_id", "chunk", "last", "start", "core", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.sliced(batches, 1):
            if not len(batch):
                continue
            text = batch.column(2)[0].as_py().encode()
            places = chunk_places(text, chunk)
            starts, cores = places[:-1], places[1:]
            n = len(starts)
            stops = chunk_stops(text, cores, overlap)
            data = [text[a:b] for a, b in zip(starts, stops)]
            for i in range(0, n, 64):
                k = min(64, n - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([0] * k)), batch.column(1).take(pa.array([0] * k)),
                     pa.array(range(i, i + k), pa.int32()), pa.array([j == n - 1 for j in range(i, i + k)]),
                     pa.array(starts[i : i + k], pa.int64()), pa.array(cores[i : i + k], pa.int64()),
                     pa.array(data[i : i + k], pa.binary())], names,
                )

    # Equal texts with equal ids are one document here; how often it stands is counted with its chunks.
    doc = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"), 256)
    schema = f"doc string, doc_id {kind.simpleString()}, chunk int, last boolean, start long, core long, data binary"
    return docs.select(doc.alias("doc"), "doc_id", "text").mapInArrow(run, schema)


def chunk_stops(text: bytes, cores: list[int], overlap: int) -> list[int]:
    """Where each chunk ends: the overlap beyond the start of the next, at a whole character."""
    stops = []
    for core in cores:
        at = min(core + overlap, len(text))
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        stops.append(at)
    return stops


def seams(places: np.ndarray, chunk: int, last: bool, start: int, core: int, overlap: int):
    """Boundaries of a chunk, in the text's bytes, that may be stitched to the chunk before and to the next.

    `places` are the pre-tokens' places within the chunk, with its end."""
    settled = places[SETTLED if chunk else 0 : -1]  # the end of the chunk is no boundary of the text
    head = settled[settled <= overlap]
    tail = places[:0]
    if not last:
        # Whatever ends before the end of the chunk, and not from an apostrophe too near to it.
        begin, end = places[:-1], places[1:]
        sure = end[(end < places[-1]) & (begin + 3 <= places[-1])]
        sure = sure[sure >= core - start]
        tail = sure[np.isin(sure, settled)]
    return (head + start if chunk else places[:0]), tail + start


_PRETOKENISED = "doc string, doc_id {}, chunk int, last boolean, start long, core long, copies long, data binary, lengths binary, head array<long>, tail array<long>"


def _pretokenised(chunks: DataFrame, overlap: int) -> DataFrame:
    """Each chunk once, with the lengths of its pre-tokens and the boundaries for its seams."""
    schema = _PRETOKENISED.format(chunks.schema["doc_id"].dataType.simpleString())
    names = [part.split()[0] for part in schema.split(", ")]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the latest row, and how often it came

        def made() -> pa.RecordBatch:
            row, copies = held
            data = row.column(6)[0].as_py()
            chunk, last, start, core = (row.column(i)[0].as_py() for i in (2, 3, 4, 5))
            places = pretokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            head, tail = seams(places, chunk, last, start, core, overlap)
            more = [pa.array([copies], pa.int64()), row.column(6),
                    pa.array([np.diff(places).astype("<u4").tobytes()], pa.binary()),
                    pa.array([head], pa.list_(pa.int64())), pa.array([tail], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*row.columns[:6], *more], names)

        for row in shared.sliced(batches, 1):
            if not len(row):
                continue
            key = row.column(0)[0].as_py(), row.column(2)[0].as_py()
            if held and key == latest:
                held = held[0], held[1] + 1
                continue
            if held:
                yield made()
            held, latest = (row, 1), key
        if held:
            yield made()

    each = chunks.repartition("doc", "chunk").sortWithinPartitions("doc", "chunk")
    return each.mapInArrow(run, schema)


def _stitched(tokens: DataFrame) -> DataFrame:
    """(doc, chunk, part, parted, until): of each chunk its part, where its own bytes of it start and end."""
    before = tokens.where("chunk > 0").select(
        "doc", (F.col("chunk") - 1).alias("chunk"), F.col("head").alias("a"), F.lit(None).cast("array<long>").alias("b"),
        F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("core"),
    )
    own = tokens.select("doc", "chunk", F.lit(None).cast("array<long>").alias("a"), F.col("tail").alias("b"), "start", "core")
    seam = before.unionByName(own).groupBy("doc", "chunk").agg(
        F.array_min(F.array_intersect(F.first("a", True), F.first("b", True))).alias("sync"),
        F.first("start", True).alias("start"), F.first("core", True).alias("core"),
    )
    order = Window.partitionBy("doc").orderBy("chunk")  # a few numbers a chunk
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = (F.col("chunk") == 0) | F.col("synced").isNotNull()
    return seam.withColumn("synced", F.lag("sync").over(order)).select(
        "doc", "chunk", F.sum(F.when(opens, 1).otherwise(0)).over(sofar).cast("int").alias("part"),
        F.coalesce("synced", "start").alias("parted"), F.coalesce("sync", "core").alias("until"),
    )


def _parts(tokens: DataFrame, ranks: str) -> DataFrame:
    """(doc, doc_id, copies, part, ids): the ids of each part of the long texts."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    schema = f"doc string, doc_id {kind}, copies long, part int, ids binary"
    rows = tokens.drop("head", "tail", "last", "core").join(_stitched(tokens), ["doc", "chunk"])
    rows = rows.select("doc", "doc_id", "copies", "part", "chunk", "start", "parted", "until", "data", "lengths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        held, latest = [], None

        def made() -> pa.RecordBatch:
            row = held[0]
            pieces = [[r.column(i)[0].as_py() for i in (5, 6, 7, 8, 9)] for r in held]
            if len(pieces) == 1:
                start, parted, until, data, lengths = pieces[0]
                places = np.concatenate(([0], np.cumsum(np.frombuffer(lengths, "<u4").astype(np.int64)))) + start
                inside = places[(places >= parted) & (places <= until)] - start
            else:  # no boundary between chunks: cut them anew together
                data = b"".join(d[a - s : b - s] for s, a, b, d, _ in pieces)
                inside = pretokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            ids = own.ids(data, inside.tolist())
            return pa.RecordBatch.from_arrays([*row.columns[:4], pa.array([ids], pa.binary())],
                                              ["doc", "doc_id", "copies", "part", "ids"])

        for row in shared.sliced(batches, 1):
            if not len(row):
                continue
            key = row.column(0)[0].as_py(), row.column(3)[0].as_py()
            if held and key != latest:
                yield made()
                held = []
            held.append(row)
            latest = key
        if held:
            yield made()

    by = rows.repartition("doc", "part").sortWithinPartitions("doc", "part", "chunk")
    return by.mapInArrow(run, schema)


# The operator


def encode(
    docs: DataFrame, ranks: str, pattern: str = PATTERN, key: str = "doc_id", text: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, doc, copies, part, ids, chunked): ids as little-endian 32-bit numbers, in order of `part`.

    A text of one chunk is one row, with `doc` null. The parts of a longer one (`chunked`) share `doc`,
    and `copies` tells how many rows of the input they stand for. `ranks` is the text of a rank file.
    """
    if pattern != PATTERN:
        raise ValueError(f"pre-tokens are cut by {PATTERN} only")
    if not 16 <= overlap <= chunk:
        raise ValueError("the overlap is 16 bytes at least and a chunk at most")
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = _short(docs.where(size <= chunk), ranks).select(
        "doc_id", F.lit(None).cast("string").alias("doc"), F.lit(1).cast("long").alias("copies"),
        F.lit(0).alias("part"), "ids", F.lit(False).alias("chunked"),
    )
    tokens = shared.cut(_pretokenised(_chunks(docs.where(size > chunk), chunk, overlap), overlap), "pretokens")
    return short.unionByName(_parts(tokens, ranks).withColumn("chunked", F.lit(True)))


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """The rows of `encode` with the bytes that their ids stand for, as `bytes`."""
    place = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        for batch in shared.sliced(batches, 512):
            text = pa.array([own.text(ids) for ids in batch.column(place).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "bytes"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, bytes binary")


def digests(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): a row for each document, its parts in order.

    A digest runs over the parts one by one; no long document is put together for it. Either side is
    chosen before it is decoded, where `chunked` is a constant, so that neither is made for the other.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    count = (F.octet_length("ids") / 4).cast("long")
    short = decode(encoded.where("not chunked"), ranks).select(
        "doc_id", count.alias(names[1]), F.sha2("ids", 256).alias(names[2]), F.sha2("bytes", 256).alias(names[3])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = latest = None

        def made() -> pa.RecordBatch:
            more = [pa.array([n], pa.int64()), pa.array([a.hexdigest()]), pa.array([b.hexdigest()])]
            return pa.RecordBatch.from_arrays([first.column(1), first.column(2), *more], ["copies", *names])

        for row in shared.sliced(batches, 1):
            if not len(row):
                continue
            key = row.column(0)[0].as_py()
            if first is None or key != latest:
                if first is not None:
                    yield made()
                first, latest, n, a, b = row, key, 0, hashlib.sha256(), hashlib.sha256()
            ids = row.column(4)[0].as_py()
            n += len(ids) // 4
            a.update(ids)
            b.update(row.column(5)[0].as_py())
        if first is not None:
            yield made()

    kind = encoded.schema["doc_id"].dataType.simpleString()
    dealt = encoded.where("chunked").repartition("doc").sortWithinPartitions("doc", "part")
    rows = decode(dealt, ranks).select("doc", "copies", "doc_id", "part", "ids", "bytes")
    long = rows.mapInArrow(run, f"copies long, doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    every = long.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return short.unionByName(every.select(*names))
