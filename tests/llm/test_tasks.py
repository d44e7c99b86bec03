"""The numpy helpers against plain Python."""

from __future__ import annotations

import itertools
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeprofile.llm import (
    decontaminate, hamming, jaccard, rangecoder, suffixes, textnp, tokenfile, toxicity, windows,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text: str | None, k: int) -> set:
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) >= k:
        return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)}
    return {tuple(found)} if found else set()


@given(st.lists(st.one_of(st.none(), st.text("aAbé \t\n\x0b", max_size=40)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_shingle_sets(texts):
    found = dict(textnp.sets(pa.array(texts, pa.string()), 5))
    assert sorted(found) == list(range(len(texts)))
    want = [plain_set(t, 5) for t in texts]
    assert [len(found[i]) for i in range(len(texts))] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(found[i], found[j])) == len(want[i] & want[j])


def test_long_texts_span_runs():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n") for _ in range(n)) for n in (10, textnp.CHUNK + 5, 3, 0, textnp.CHUNK - 1)]
    found = dict(textnp.sets(pa.array(texts), 3))
    assert [len(found[i]) for i in range(5)] == [len(plain_set(t, 3)) for t in texts]


def test_segments_cover_each_window_once():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 99, 100, 101, 350, 0, 1000)]
    (run,) = textnp.runs(pa.array(texts, pa.binary()))
    found = windows.segments(run, 100, 20)
    seen = defaultdict(list)
    for d, a, n in zip(found.doc, found.start, found.n):
        seen[int(d)] += range(int(a), int(a + n))
    assert {d: s for d, s in seen.items()} == {
        d: list(range(len(t) - 99)) for d, t in enumerate(texts) if len(t) >= 100
    }
    # Equal windows have equal grams at equal places.
    names = {}
    for d, a, n, at, gram in zip(found.doc, found.start, found.n, found.gram_at, found.gram):
        for p in range(int(a), int(a + n)):
            assert names.setdefault(texts[d][p : p + 100], (int(at) - p, int(gram))) == (int(at) - p, int(gram))


@pytest.mark.parametrize("window, gram", [(100, 20), (30, 7), (50, 20), (64, 16), (20, 20), (33, 5)])
def test_refinement_finds_equal_windows(window, gram):
    rng = np.random.default_rng(window)
    base = rng.integers(0, 3, 300).astype(np.uint8)
    data = np.concatenate([base, rng.integers(0, 3, 200), base[20:250], base[5:180], np.zeros(150)]).astype(np.uint8)
    at = np.arange(len(data) - window + 1)
    own, pointer = suffixes.refined(data, at, window, gram)
    want, got = defaultdict(list), defaultdict(list)
    for a in at.tolist():
        want[data[a : a + window].tobytes()].append(a)
    for o, p in zip(own.tolist(), pointer.tolist()):
        got[p].append(o)
    assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1)


@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=25), min_size=1, max_size=12),
       st.sets(st.integers(0, 40), min_size=1, max_size=25))
@settings(max_examples=150, deadline=None)
def test_t_occurrence_search(members, query):
    found = [np.array(sorted(m), np.uint64) for m in members]
    sizes = np.array([len(m) for m in found])
    every = np.concatenate(found)
    order = np.argsort(every, kind="stable")
    owner = np.repeat(np.arange(len(found)), sizes)
    got = jaccard.search(every[order], owner[order], sizes, np.array(sorted(query), np.uint64))
    want = [i for i, m in enumerate(members) if 100 * len(m & query) >= 75 * len(m | query)]
    assert got.tolist() == want


def test_t_occurrence_search_sets_long_lists_aside():
    rng = np.random.default_rng(0)
    common = np.arange(40)
    members = [np.unique(np.concatenate((common, rng.integers(100, 10**6, n)))) for n in rng.integers(1, 40, 300)]
    sizes = np.array([len(m) for m in members])
    every = np.concatenate(members).astype(np.uint64)
    order = np.argsort(every, kind="stable")
    owner = np.repeat(np.arange(300), sizes)
    for q in members[:50]:
        got = jaccard.search(every[order], owner[order], sizes, q.astype(np.uint64))
        want = [i for i, m in enumerate(members)
                if 100 * len(np.intersect1d(m, q)) >= 75 * len(np.union1d(m, q))]
        assert got.tolist() == want


@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=40), min_size=1, max_size=10),
       st.sets(st.integers(0, 60), min_size=1, max_size=40), st.integers(0, 9))
@settings(max_examples=150, deadline=None)
def test_sieve_keeps_all_links(members, query, shift):
    """Also where upper halves of different hashes agree."""
    sets = [np.array(sorted(m), np.uint64) << np.uint64(32 - shift // 3) for m in members]
    own = np.array(sorted(query), np.uint64) << np.uint64(32 - shift // 3)
    sieve = jaccard.Sieve([jaccard.low_part(m, 75) for m in sets], [len(m) for m in sets], 75)
    kept = sieve.passes(jaccard.low_part(own, 75), len(own)).tolist()
    want = [i for i, m in enumerate(members) if 100 * len(m & query) >= 75 * len(m | query)]
    assert set(want) <= set(kept)


@given(st.lists(st.integers(0, 300), max_size=700), st.integers(1, 4))
@settings(max_examples=40, deadline=None)
def test_range_coder_round_trip(ids, repeat):
    ids = np.array(ids * repeat, np.int64)
    assert (rangecoder.decode(rangecoder.encode(ids, 301)) == ids).all()


def test_range_coder_compresses_and_notices_damage():
    rng = np.random.default_rng(2)
    ids = np.tile(rng.integers(0, 49408, 500), 300)
    coded = rangecoder.encode(ids, 49408)
    assert (rangecoder.decode(coded) == ids).all()
    assert len(coded) < len(ids) / 2  # 16 bits each before
    for at in (5, 30, len(coded) - 1):
        bad = bytearray(coded)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rangecoder.decode(bytes(bad))
    with pytest.raises(ValueError):
        rangecoder.decode(coded[:10])
    with pytest.raises(ValueError):
        rangecoder.encode(np.array([7]), 7)


def test_every_id_can_be_coded_at_any_time():
    ids = np.concatenate((np.zeros(50_000, np.int64), np.arange(49408), np.full(9, 49407)))
    assert (rangecoder.decode(rangecoder.encode(ids, 49408)) == ids).all()


def test_words_are_forgotten_between_texts(monkeypatch):
    from tokenizers import Tokenizer

    from lakeprofile.llm import queries

    monkeypatch.setattr(tokenfile, "REMEMBERED", 20)
    rng = random.Random(3)
    texts = [" ".join(f"{rng.choice('abc')}{rng.randrange(60)}{rng.choice(['', '.', '!!'])}" for _ in range(n))
             for n in (5, 40, 90, 3, 70, 70)]
    text = queries.tokenizer_json()
    got = [np.frombuffer(b, "<u4").tolist() for b in tokenfile.Words(text).ids(texts)]
    assert got == [e.ids for e in Tokenizer.from_str(text).encode_batch(texts, add_special_tokens=False)]


def test_plain_texts_are_cut_as_the_tokenizer_cuts(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from lakeprofile.llm import queries

    monkeypatch.setattr(tokenfile, "PIECES", 60)
    monkeypatch.setattr(tokenfile, "LEARNED", 11)
    monkeypatch.setattr(tokenfile, "CHUNK", 7)
    monkeypatch.setattr(tokenfile, "CHUNK_BYTES", 400)
    text = queries.tokenizer_json()
    words, whole = tokenfile.Words(text), Tokenizer.from_str(text)
    rng = random.Random(8)
    plain = list("'" * 4 + "sstremvld  \n\t\r.,!?09aAÉéßÑñ²½-<|>ΣσЙй漢字가’“—€🙂ŸĿ") + ["'LL", "don't", "''" + "'s", "it'stree", "<|EndOf"]
    odd = ["\u0301", "\u00a0", "\x0b", "\u2028", "İ", "ſ", "K", "\x00", "<|endoftext|>", "<|STARTOFTEXT|>"]
    mixed = ["".join(rng.choice(plain) for _ in range(rng.randrange(70))) for _ in range(300)]
    assert words.pieces.plain(pa.array(mixed)).all()
    want = [e.ids for e in whole.encode_batch(mixed, add_special_tokens=False)]
    got = [np.frombuffer(b, "<u4").tolist() for b in words.ids(mixed)]
    assert got == want and len(words.pieces.slots) < 600
    assert "tokenizer" not in vars(words)  # plain texts do not load the whole tokenizer
    for i in range(0, 300, 3):
        mixed[i] += rng.choice(odd) + rng.choice(plain)
    got = [np.frombuffer(b, "<u4").tolist() for b in words.ids([*mixed, None, ""])]
    assert got == [*(e.ids for e in whole.encode_batch(mixed, add_special_tokens=False)), [], []]


def test_lanes_of_a_block_are_read_from_it(monkeypatch):
    ids = np.random.default_rng(4).integers(0, 70_000, 40_003)
    coded = rangecoder.encode(ids, 70_000)
    monkeypatch.setattr(rangecoder, "LANES", 16)
    assert (rangecoder.decode(coded) == ids).all()
    assert (rangecoder.decode(rangecoder.encode(ids, 70_000)) == ids).all()


@given(st.binary(max_size=50), st.binary(max_size=300))
def test_crc_of_both(a, b):
    import zlib

    assert tokenfile.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@given(st.integers(0, 2**32), st.integers(1, 200), st.integers(1, 12), st.integers(1, 3))
@settings(max_examples=25, deadline=None)
def test_hamming_index(seed, n, k, width):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 2**63, (n, width), dtype=np.uint64) & rng.integers(0, 2**63, (n, width), dtype=np.uint64)
    codes[: n // 3] = codes[0]
    index = hamming.Index(codes)
    found, apart = index.search(codes[n // 2], k)
    every = np.bitwise_count(codes ^ codes[n // 2]).sum(1)
    limit = np.sort(every)[min(k, n) - 1]
    assert sorted(found.tolist()) == np.flatnonzero(every <= limit).tolist()
    assert (every[found] == apart).all()


SIGNS = ["\u00a0", "\u201c", "\u2019", "\u2014", "\u2026", "\u200b", "\u3000", "\u300c", "\u00ab", "\U0001f600"]


@pytest.mark.parametrize("sign", SIGNS)
def test_separators_beyond_ascii_are_spaces(sign):
    texts = [f"{sign}naïve{sign}", "", f"a{sign}日本語 e\u0301x²", sign, "plain"]
    (run,) = textnp.plain_runs(pa.array(texts))
    got = [run.data[a:b].tobytes().decode() for a, b in zip(run.starts[:-1], run.starts[1:])]
    assert got == [t.replace(sign, " ") for t in texts]


@pytest.mark.parametrize("sign", SIGNS)
def test_toxic_words_and_items_next_to_such_signs(sign):
    (word,) = textnp.plain_runs(pa.array(["vilething"]))
    whole = toxicity._hashes(word)[0][:1]
    language = toxicity.Language(np.zeros((28, 28, 28)))
    model = toxicity.Model(["vilething"], whole, np.array([0.9]), 0.0, language)
    text = f"so {sign}vilething{sign} and{sign}vilething"
    assert [(i, e) for i, e, _ in toxicity.evidence(pa.array([text, "a fine thing"]), model)] == [(0, {0})]
    item = "one two three four five six seven eight nine ten"
    items = decontaminate.prepared([(1, item)])
    leak = f"before {sign}{item.replace(' ', sign)}{sign} after"
    found = list(decontaminate.matches(pa.array([leak]), items, 5, 0.75, 23))
    assert [(m[0], m[2]) for m in found] == [(0, 1.0)]


def test_added_tokens_match_raw_text_only():
    from tokenizers import Tokenizer

    from lakeprofile.llm import queries

    text = queries.tokenizer_json()
    own = Tokenizer.from_str(text)
    texts = ["a <|EndOfText|> b", "<|ENDOFTEXT|>", "X<|endoftext|>Y", "Word<|StartOfText|>Word!", "<|startoftext|>Q.",
             "<|EndOfText|><|endoftext|>", "PLAIN Words <|endof"]
    got = [np.frombuffer(b, "<u4").tolist() for b in tokenfile.Words(text).ids(texts)]
    assert got == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_groups_hold_whole_buckets(monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", 50)
    rng = random.Random(4)
    segments = [(rng.randrange(40), i, 0, 1, bytes(rng.randrange(1, 30))) for i in range(300)]
    groups = list(suffixes._groups(list(segments)))
    assert sorted(s for g in groups for s in g) == sorted(segments) and len(groups) > 10
    of = [{s[0] for s in g} for g in groups]
    assert sum(map(len, of)) == len({s[0] for s in segments})
    assert all(sum(len(s[4]) for s in g if s[0] != g[-1][0]) < 50 for g in groups)
    assert list(suffixes._groups([])) == []


@pytest.mark.parametrize("span", ["v1le", "b@@d", "w o r d", "niiice", "*x*1", "a!!b", "ab1cd|ef", "3éé"])
def test_decoding_finds_the_cheapest_of_all_readings(span):
    counts = np.random.default_rng(5).integers(0, 99, (28, 28, 28))
    language = toxicity.Language.of(counts, ["vile", "word"])
    best = None
    for readings in itertools.product(*toxicity.lattice(span)):
        cost, a, b, text = 0.0, 0, 0, ""
        for letter, paid in (*readings, ("#", 0.0)):
            cost += paid
            c = toxicity._code(letter) if letter else 0
            if letter and (c or b):
                cost -= language.logs[a, b, c]
                a, b, text = (b, c, text + letter) if c else (0, 0, text + " ")
        if best is None or cost < best[0]:
            best = (cost, text.strip())
    assert toxicity.restored(span, language) == best[1]


@pytest.mark.parametrize("letters", ["ACGT", "".join(map(chr, range(0xE01, 0xE2F))), "一二三四五六七"])
def test_long_runs_of_letters_take_time_in_proportion(letters):
    word = next(textnp.plain_runs(pa.array(["vilething"])))
    language = toxicity.Language.of(np.ones((28, 28, 28)), ["vilething"])
    model = toxicity.Model(["vilething"], toxicity._hashes(word)[0][:1], np.array([0.9]), 0.0, language)
    drawn = np.random.default_rng(2).choice(list(letters), 1_000_000 // len(letters[0].encode()))
    start = time.process_time()
    found = list(toxicity.evidence(pa.array(["".join(drawn) + " v!lething"]), model))
    assert [(i, e) for i, e, _ in found] == [(0, {0})]
    assert time.process_time() - start < 10  # patterns that try each start take hours
