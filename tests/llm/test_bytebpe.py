"""Byte-level BPE against tiktoken itself."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeprofile.llm import bytebpe, queries, textnp

RANKS = queries.byte_ranks()


def own() -> tiktoken.Encoding:
    pairs = (line.split() for line in RANKS.splitlines())
    table = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return tiktoken.Encoding("own", pat_str=bytebpe.PATTERN, mergeable_ranks=table, special_tokens={})


OWN = own()
#: What the pattern tells apart, with characters that Unicode versions class differently.
PIECES = st.sampled_from(["'", "'s", "'re", "'ll", "'r", "s", "abc", "é", "日本", "1", "٣", "²", " ", "  ", "\n", "\t", " ",
                          "　", "\x1c", "\x85", "!", "--", "́", "՘", "Ᲊ", "😀", "<|endoftext|>", "ll", "d"])
TEXTS = st.one_of(st.lists(PIECES, max_size=30).map("".join), st.text(max_size=30))


def digest(text: str) -> tuple:
    ids = OWN.encode_ordinary(text)
    code = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    return len(ids), code, hashlib.sha256(text.encode()).hexdigest()


@given(st.lists(TEXTS, max_size=8))
@settings(max_examples=200, deadline=None)
def test_ids_are_those_of_the_library(texts):
    coder = bytebpe.Encoder(RANKS)
    found = [np.frombuffer(ids, "<u4").tolist() for ids in bytebpe.ids_of(pa.array(texts, pa.string()), coder)]
    assert found == [OWN.encode_ordinary(t) for t in texts]
    assert [coder.text(np.array(i, "<u4").tobytes()).decode() for i in found] == texts


def test_every_character_alone_and_in_the_middle():
    every = [chr(c) for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b 'x{c} {c}{c} 1{c}" for c in every]
    coder = bytebpe.Encoder(RANKS)
    for ids, text in zip(bytebpe.ids_of(pa.array(texts), coder), texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == OWN.encode_ordinary(text), repr(text)


def places(text: str) -> list[int]:
    data = text.encode()
    return bytebpe.pretokens(np.frombuffer(data, np.uint8), np.array([0, len(data)])).tolist()


@given(st.lists(PIECES, min_size=10, max_size=120).map("".join), st.integers(16, 60))
@settings(max_examples=200, deadline=None)
def test_stitches_are_boundaries_of_the_whole(text, chunk):
    """Whatever two neighbours agree on is a boundary of the text."""
    data, true = text.encode(), set(places(text))
    cut = bytebpe.chunk_places(data, chunk)
    starts, cores = cut[:-1], cut[1:]
    stops = bytebpe.chunk_stops(data, cores, 16)
    tail = None
    for i, (a, core, b) in enumerate(zip(starts, cores, stops)):
        part = np.frombuffer(data[a:b], np.uint8)
        found = bytebpe.pretokens(part, np.array([0, len(part)]))
        head, after = bytebpe.seams(found, i, i == len(starts) - 1, a, core, 16)
        if tail is not None:
            assert set(np.intersect1d(head, tail).tolist()) <= true
        tail = after


def corpus() -> list[tuple]:
    rng = random.Random(5)
    words = ["word", "it's", "naïve", "日本語", "42", "--", "we're", "  ", "\n\n", " ", "😀", "''s's"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 5, 40, 200, 900, 2000)]
    texts += ["x" * 700, " " * 500, "a" * 300 + " end " + "'" * 400 + "s" + "\n" * 90, "é" * 333, None, "", "1" * 40]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [docs[5], docs[5], (5, texts[6]), (None, texts[5]), (None, texts[5]), (None, None), (3, texts[3])]
    return docs


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (1000, 100), (1 << 15, 1 << 10)])
def test_documents_in_chunks(spark, chunk, overlap):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, doc string, ids int").repartition(3)
    encoded = bytebpe.encode(df, RANKS, chunk=chunk, overlap=overlap)
    got = Counter(tuple(r.values()) for r in rows(bytebpe.digests(encoded, RANKS)))
    assert got == Counter((i, *digest(t or "")) for i, t in docs)
    if chunk == 64:
        assert encoded.where("doc is not null").select("part").distinct().count() > 20


def test_one_very_long_text_of_one_pretoken(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ACGT") for _ in range(300_000)), "日" * 100_000, "word " * 60_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r.values())[1:] for r in rows(bytebpe.digests(bytebpe.encode(df, RANKS), RANKS))}
    assert got == {i: digest(t) for i, t in enumerate(texts)}


def test_empty_table_and_refusals(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows(bytebpe.digests(bytebpe.encode(df, RANKS), RANKS)) == []
    with pytest.raises(ValueError):
        bytebpe.encode(df, RANKS, pattern=r"\w+")
    with pytest.raises(ValueError):
        bytebpe.encode(df, RANKS, chunk=8, overlap=16)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r.values())[1:] for r in rows(queries.op11_byte_bpe(spark, sf))}
    assert got == {i: digest(t) for i, t in texts.items()}


def test_pretokens_of_several_texts():
    texts = ["a b", "", " 'll", "'ll", " ", "x "]
    (run,) = textnp.runs(pa.array(texts))
    found = bytebpe.pretokens(run.data, run.starts).tolist()
    base, want = 0, []
    for t in texts:
        want += [base + p for p in places(t)[:-1]] if t else []
        base += len(t.encode())
    assert found == [*want, base]
