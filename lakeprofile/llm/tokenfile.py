"""Token ids of a corpus in range-coded files: written in order of the document ids, read back.

Texts are sorted by id in ranges, one range for each task. A task tokenizes its documents, ends each
with the end id, and codes the stream of ids in blocks (`rangecoder`); a block row holds the coded
block and which documents it holds how many ids of. Block rows are written by Spark's Parquet
writer, which survives lost executors and knows any file system; the block itself is this library's
own format with its own checksum. A task reads its blocks one by one, so memory is bounded by
a block and by a document.

Words are tokenized once and remembered: the tokenizer splits at white space and between letters or
digits and ASCII punctuation before anything else, so a text's ids are its words' ids in order.
`safe_to_split` refuses tokenizers for which this does not hold. Texts of `PLAIN` characters alone,
for which lower case and the tokenizer's own pattern mean the same to Arrow, are lowered and cut by
Arrow in whole chunks; the tokenizer's model then sees each new piece once. Other texts are cut at
spaces, and the whole tokenizer sees each new word.

Defined results: null is an empty text, which is the end id alone; null ids come first; rows with
equal ids are documents of their own, ordered by the 64-bit hash (Spark's xxhash64) of their text, which
keeps texts out of the range bounds; an empty table gives an empty file. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeprofile.llm import rangecoder, shared

END_ID = 2
BLOCK = 1 << 20
#: Documents to a task.
EACH = 5000
#: Words and cores remembered by a worker, and pieces, of which half are kept when there are more.
REMEMBERED, PIECES = 150_000, 200_000
#: Pieces that the model sees at once, which bounds what it holds of them.
LEARNED = 4096
#: Texts and bytes of text to a chunk, which is at least one text.
CHUNK, CHUNK_BYTES = 1024, 1 << 22
TAIL = ".,!?"

#: Characters that NFC leaves alone whatever stands beside them, whose lower case is one character, and
#: which are a letter, digit, white space or neither by any version of Unicode, as a class of RE2.
PLAIN = (
    r"\t\n\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{17e}\x{388}-\x{38a}\x{38c}\x{38e}-\x{3a1}\x{3a3}-\x{3ce}"
    r"\x{400}-\x{482}\x{48a}-\x{4ff}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bd}\x{2190}-\x{2328}"
    r"\x{2500}-\x{27bf}\x{3001}-\x{3003}\x{3008}-\x{3020}\x{3041}-\x{3096}\x{30a1}-\x{30ff}\x{4e00}-\x{9fa5}"
    r"\x{ac00}-\x{d7a3}\x{ff01}-\x{ff0f}\x{1f300}-\x{1f3fa}\x{1f400}-\x{1f64f}"
)

#: What a tokenizer may do to a text if its words can be tokenized one by one.
_NORMAL = {"NFC", "Lowercase"}


def safe_to_split(text: str) -> None:
    """Raises unless this tokenizer, as JSON, cuts words apart as `Words` does."""
    made = json.loads(text)
    normal = made.get("normalizer") or {"normalizers": []}
    steps = normal.get("normalizers", [normal])
    spaced = [s for s in steps if s.get("type") == "Replace" and s["pattern"].get("Regex") == r"\s+"]
    others = [s["type"] for s in steps if s not in spaced]
    cuts = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    pattern = cuts[0].get("pattern", {}).get("Regex", "")
    fine = pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and cuts[0].get("behavior") == "Removed"
    strip = any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in made.get("added_tokens", []))
    if not fine or strip or not set(others) <= _NORMAL or made.get("post_processor"):
        raise ValueError("this tokenizer does not split words at white space first")


class Pieces:
    """Ids of chunks of plain texts: Arrow cuts them as the tokenizer would, its model sees new pieces."""

    SUFFIX = "</w>"

    def __init__(self, made: dict):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work out already
        cuts = made["pre_tokenizer"]["pretokenizers"]
        spaces = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *cuts[1:]]}
        own = made | {"normalizer": None, "pre_tokenizer": spaces, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(own))
        vocabulary = made["model"]["vocab"]
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(self.SUFFIX)]] = True
        #: What ends a run of letters; letters themselves need no cut.
        ends = cuts[0]["pattern"]["Regex"].replace(r"[\p{L}]+|", "")
        self.cut = ends.replace("'s|'t|'re|'ve|'m|'ll|'d|", "'(?:s|t|re|ve|m|ll|d)|")  # the same, faster
        added = [re.escape(t["content"]) for t in made.get("added_tokens") or []]
        self.odd = f"[^{PLAIN}]" + "".join(f"|(?i:{a})" for a in added)
        self.slots = {"": 0}
        self.pool, self.starts = np.zeros(0, "<u4"), np.zeros(2, np.int64)
        self.hits = np.zeros(1, np.int64)  # chunks that held the piece, fewer after each forgetting

    @classmethod
    def of(cls, made: dict) -> Pieces | None:
        """None for tokenizers that lower case or cut in other ways, or whose ids do not tell ends."""
        from tokenizers import pre_tokenizers

        steps = [s["type"] for s in (made.get("normalizer") or {}).get("normalizers", [])]
        cuts = made["pre_tokenizer"].get("pretokenizers", [])
        bytewise = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        if steps != ["NFC", "Replace", "Lowercase"] or cuts[1:] != [bytewise]:
            return None
        model = made["model"]
        ends = {c + cls.SUFFIX for c in pre_tokenizers.ByteLevel.alphabet()}
        whole = model["type"] == "BPE" and model.get("end_of_word_suffix") == cls.SUFFIX
        whole = whole and not model.get("dropout") and ends <= model["vocab"].keys()
        return cls(made) if whole else None

    def _forget(self) -> None:
        """Keeps the pieces that most chunks held."""
        kept = np.argsort(-self.hits, kind="stable")[: PIECES // 2]
        counts = np.diff(self.starts)[kept]
        kept = np.union1d([0], kept[np.cumsum(counts) <= 8 * PIECES])  # the empty piece stays
        counts = np.diff(self.starts)[kept]
        starts = np.concatenate(([0], np.cumsum(counts)))
        self.pool = self.pool[np.arange(starts[-1]) + np.repeat(self.starts[kept] - starts[:-1], counts)]
        names = list(self.slots)
        self.slots = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.starts, self.hits = starts, self.hits[kept] >> 1

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Which of the texts can be cut by Arrow."""
        return ~pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)

    def _learn(self, new: list[str]) -> None:
        ids = np.array(self.model.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("the tokenizer cut a piece that it should not")
        self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new))))
        self.starts = np.concatenate((self.starts, ends + len(self.pool)))
        self.pool = np.concatenate((self.pool, ids))
        self.hits = np.concatenate((self.hits, np.zeros(len(new), np.int64)))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and where each text's end."""
        if len(self.slots) > PIECES or len(self.pool) > 16 * PIECES:
            self._forget()
        low = pc.replace_substring_regex(pc.utf8_lower(texts), self.cut, r" \0 ")
        cut = pc.ascii_split_whitespace(low)
        words = cut.flatten().dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.slots.get, known, repeat(-1)), np.int64, len(known))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.slots), len(self.slots) + len(new))
            for i in range(0, len(new), LEARNED):
                self._learn([known[n] for n in new[i : i + LEARNED].tolist()])
        self.hits[at] += 1
        at = at[words.indices.to_numpy()]
        begin = self.starts[at]
        count = self.starts[at + 1] - begin
        ends = np.concatenate(([0], np.cumsum(count)))
        found = np.repeat(begin - ends[:-1], count)
        found += np.arange(len(found))
        return self.pool[found], ends[cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()]


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in chunks of few rows and bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().tolist()
    begin = held = 0
    for i, size in enumerate(sizes):
        if i > begin and (i - begin == CHUNK or held + size > CHUNK_BYTES):
            yield texts.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield texts.slice(begin)


class Words:
    """Ids of texts by a tokenizer, each word once; one is kept for each worker and tokenizer."""

    made: dict[int, Words] = {}

    def __init__(self, text: str):
        self.text, made = text, json.loads(text)
        added = [re.escape(t["content"]) for t in made.get("added_tokens") or []]
        #: Added tokens match raw text only, so a word that holds one in any case is not lowered.
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE)
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.pieces = Pieces.of(made)

    @cached_property
    def tokenizer(self):
        """The whole tokenizer, which plain texts do without."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.text)

    @classmethod
    def of(cls, text: str) -> Words:
        key = zlib.crc32(text.encode())
        if key not in cls.made:
            cls.made[key] = cls(text)
        return cls.made[key]

    def split(self, word: str) -> tuple[str, str]:
        """A word as a core and punctuation at its end, where the tokenizer cuts between them."""
        low = word.lower() if word.isascii() and not self.added.search(word) else word
        core = low.rstrip(TAIL)
        return (core, low[len(core) :]) if core and core[-1].lower()[-1].isalnum() else (low, "")

    def _learn(self, new: list[str]) -> None:
        if len(self.cores) > REMEMBERED:
            self.cores.clear()
        halves = [self.split(w) for w in new]
        unknown = [p for p in dict.fromkeys(p for h in halves for p in h if p) if p not in self.cores]
        if unknown:
            coded = self.tokenizer.encode(unknown, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(coded.ids, np.uint32).tobytes()
            ends = np.searchsorted(np.array(coded.word_ids, np.int64), np.arange(len(unknown) + 1)).tolist()
            for p, a, b in zip(unknown, ends, ends[1:]):
                self.cores[p] = ids[4 * a : 4 * b]
        for word, (core, tail) in zip(new, halves):
            self.words[word] = self.cores[core] + self.cores[tail] if tail else self.cores[core]

    def _by_word(self, text: str) -> bytes:
        if len(self.words) > REMEMBERED:  # between texts, as a text's words are needed together
            self.words.clear()
        words = text.replace("\n", " ").split(" ")
        found = list(map(self.words.get, words))
        if None in found:
            self._learn([w for w in dict.fromkeys(words) if w and w not in self.words])
            self.words.setdefault("", b"")
            found = [self.words[w] for w in words]
        return b"".join(found)

    def ids(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        for chunk in _chunks(texts):
            chunk = pc.fill_null(chunk, "")
            plain = self.pieces.plain(chunk) if self.pieces else np.zeros(len(chunk), bool)
            ids, begin = b"", 0
            if plain.any():
                found, ends = self.pieces.ids(chunk.filter(pa.array(plain)))
                ids, ends = found.tobytes(), iter((4 * ends).tolist())
            others = iter(chunk.filter(pa.array(~plain)).to_pylist())
            for by_piece in plain.tolist():
                if by_piece:
                    end = next(ends)
                    yield ids[begin:end]
                    begin = end
                else:
                    yield self._by_word(next(others))


def _coded(tokenizer: str, end_id: int, vocabulary: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, number, ordinal = Words.of(tokenizer), None, 0, 0
        stream, held, docs = [], 0, []  # pieces of ids, their number, and (ordinal, id, ids here)
        end = np.array([end_id], "<u4").tobytes()

        def flush(schema):
            nonlocal number
            ids = np.frombuffer(b"".join(stream), "<u4")
            row = [[part], [number], [rangecoder.encode(ids, vocabulary)]]
            row += [[[d[i] for d in docs]] for i in range(3)]
            number += 1
            stream.clear()
            docs.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                schema = _schema(batch.schema.field(1).type)
            if part is None and len(batch):
                part = batch.column(0)[0].as_py()
            keys = batch.column(1).to_pylist()
            for key, ids in zip(keys, words.ids(batch.column(2))):
                ids += end
                n = len(ids) // 4
                at = 0
                while at < n:
                    take = min(n - at, block - held)
                    stream.append(ids[4 * at : 4 * (at + take)])
                    docs.append((ordinal, key, take))
                    at, held = at + take, held + take
                    if held == block:
                        yield flush(schema)
                        held = 0
                ordinal += 1
        if held:
            yield flush(schema)

    return run


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("part", pa.int32()), ("number", pa.int32()), ("block", pa.binary()),
        ("ordinals", pa.list_(pa.int64())), ("doc_ids", pa.list_(kind)), ("counts", pa.list_(pa.int64())),
    ])


def write(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    end_id: int = END_ID,
    block: int = BLOCK,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Tokenize the texts with a tokenizer, given as JSON, and write their ids to `path`."""
    safe_to_split(tokenizer)
    made = json.loads(tokenizer)
    used = [*made["model"]["vocab"].values(), *(t["id"] for t in made.get("added_tokens", [])), end_id]
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    n = shared.parts(docs.sparkSession, rows.count(), EACH)
    # Bounds of the ranges are sampled to the driver, so texts are no part of them.
    by = [F.asc_nulls_first("doc_id"), F.asc("th")]
    rows = rows.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    placed = rows.repartitionByRange(n, *by).sortWithinPartitions(*by, F.asc_nulls_first("text"))
    placed = placed.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    coded = placed.mapInArrow(
        _coded(tokenizer, end_id, max(used) + 1, block),
        f"part int, number int, block binary, ordinals array<long>, doc_ids array<{kind}>, counts array<long>",
    )
    coded.write.option("compression", "uncompressed").parquet(path)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            part, number, block, ordinals, keys, counts = (batch.column(k)[i] for k in range(6))
            ids = rangecoder.decode(block.as_py()).astype("<u4")
            many = counts.values.to_numpy()
            ends = np.cumsum(many)
            if ends[-1] != len(ids):
                raise ValueError("a block and its list of documents disagree")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - many).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(crc), part.as_py(), np.int32)), ordinals.values, keys.values,
                 pa.array(np.full(len(crc), number.as_py(), np.int32)), counts.values, pa.array(crc, pa.int64())],
                ["part", "ordinal", "doc_id", "number", "n", "crc"],
            )


POLYNOMIAL = 0xEDB88320  # fixed value: that of CRC-32, lowest bit first


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ POLYNOMIAL if b & 1 else b >> 1
    return out


def crc_of_both(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings end to end, from theirs and the second one's length."""
    power, step = 1 << 31, 1 << 23  # 1, and x to the 8
    while length:
        if length & 1:
            power = _times(power, step)
        step = _times(step, step)
        length >>= 1
    return _times(power, first) ^ second


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = []
        for pieces in batch.column(3).to_pylist():
            total = pieces[0]["crc"]
            for p in pieces[1:]:
                total = crc_of_both(total, p["crc"], 4 * p["n"])
            crc.append(total)
        columns = [batch.column(i) for i in range(3)] + [pa.array(crc, pa.int64()), batch.column(4)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "ordinal", "doc_id", "ids_crc32", "n_tokens"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    pieces = blocks.select("part", "number", "block", "ordinals", "doc_ids", "counts").mapInArrow(
        _pieces, f"part int, ordinal long, doc_id {kind}, number int, n long, crc long"
    )
    docs = pieces.groupBy("part", "ordinal").agg(
        F.first("doc_id").alias("doc_id"),
        F.sort_array(F.collect_list(F.struct("number", "n", "crc"))).alias("pieces"),
        F.sum("n").alias("n_tokens"),
    )
    docs = docs.mapInArrow(
        _joined, f"part int, ordinal long, doc_id {kind}, ids_crc32 long, n_tokens long"
    )
    docs = shared.cut(docs, "token-docs")
    # One row per range of documents.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = docs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    own = Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return (
        docs.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
        .join(parts, "part")
        .select("doc_id", (F.col("own") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """part, number and the ids of every block, for a reader that wants the stream itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [rangecoder.decode(b).astype(np.int32) for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))],
                ["part", "number", "ids"],
            )

    blocks = spark.read.parquet(path).select("part", "number", "block")
    return blocks.mapInArrow(run, "part int, number int, ids array<int>")
