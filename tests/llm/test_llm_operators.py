"""The operators against brute force, on small tables and on the disordered one."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeprofile.llm import (
    components, decontaminate, hamming, jaccard, licences, mixing, quality, queries, rollups, shared,
    suffixes, tokenfile, toxicity,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng: random.Random, n: int, of: int = 5000) -> str:
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def shingles(text: str | None, k: int = 5) -> frozenset:
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) >= k:
        return frozenset(tuple(found[i : i + k]) for i in range(len(found) - k + 1))
    return frozenset([tuple(found)] if found else [])


def plain_components(texts: dict) -> dict:
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


# N-gram Jaccard join


def near_copies(rng: random.Random) -> dict[int, str]:
    """Copies with edits of all degrees, a passage that many share, and a big group of copies."""
    texts: dict[int, str] = {}
    base = [f"b{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(60)]
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        texts[i] = " ".join(copy)
    for i in range(150, 260):  # mostly the passage, and between them hardly linked
        texts[i] = " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 25))])
    for i in range(260, 300):
        texts[i] = sentence(rng, rng.randrange(1, 40))
        texts[i + 100] = texts[i] if i % 2 else texts[i].upper()
    texts[500], texts[501], texts[502] = "", None, " \n"
    return texts


def test_jaccard_components(spark):
    texts = near_copies(random.Random(3))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard.linked(df))}
    assert got == plain_components(texts)
    stay = {r["doc_id"] for r in rows(jaccard.representatives(df))}
    assert stay == {i for i, (_, c) in got.items() if c == i}


def test_jaccard_without_frequent_table_and_short_lists(spark, monkeypatch):
    """The steering tables and block sizes change the work, never the links."""
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "SHORT", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    texts = near_copies(random.Random(4))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard.linked(df))}
    assert got == plain_components(texts)


def test_jaccard_null_ids(spark):
    """Documents without an id are linked like others, as bridges too, and one of a group stays."""
    rng = random.Random(8)
    words = [f"n{i}" for i in range(100)]
    bridge = " ".join(words)
    ends = " ".join(["x"] * 13 + words[13:]), " ".join(words[:87] + ["y"] * 13)  # too far apart to link
    copies, alone, repeated = sentence(rng, 60), sentence(rng, 50), [sentence(rng, 40) for _ in range(2)]
    docs = [
        (1, ends[0]), (2, ends[1]), (None, bridge), (None, bridge),
        (5, copies), (None, copies), (4, copies.upper()), (None, copies + " more"),
        (None, alone), (None, alone), (None, alone + " more"),
        (7, repeated[0]), (7, repeated[1]), (None, ""), (None, None),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter((r["doc_id"], r["component_id"]) for r in rows(jaccard.linked(df))) == Counter(
        [(1, 1), (2, 1), (None, 1), (None, 1), (5, 4), (None, 4), (4, 4), (None, 4), (None, None), (None, None),
         (None, None), (7, 7), (7, 7), (None, None), (None, None)]
    )
    stay = Counter((r["doc_id"], (r["text"] or "")[:20].lower()) for r in rows(jaccard.representatives(df)))
    assert stay == Counter(
        [(1, ends[0][:20]), (4, copies[:20]), (None, alone[:20]), (7, repeated[0][:20]), (7, repeated[1][:20]),
         (None, ""), (None, "")]
    )


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(5000, i) for i in range(4900, 5100)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in rows(components.components(spark.createDataFrame(edges, "u long, v long")))}
    parent: dict[int, int] = {}
    for u, v in edges:
        if u != v:
            parent.setdefault(u, u), parent.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if u != v and parent[u] != parent[v]:
                parent[u] = parent[v] = min(parent[u], parent[v])
                changed = True
    assert got == parent


# Suffix dedup


def plain_removal(docs: list[tuple], window: int) -> dict:
    seen, out = set(), {}
    for key, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - window + 1):
            s = data[p : p + window]
            if s in seen:
                gone[p : p + window] = True
            seen.add(s)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out[key] = (kept, len(data), list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())))
    return out


@pytest.mark.parametrize("window, gram, frequent", [(100, 20, 256), (30, 8, 3)])
def test_suffix_dedup(spark, monkeypatch, window, gram, frequent):
    monkeypatch.setattr(suffixes, "FREQUENT", frequent)
    rng = random.Random(window)
    passages = [sentence(rng, 30) for _ in range(4)]
    docs = []
    for i in range(120):
        parts = [sentence(rng, rng.randrange(1, 25)), rng.choice(passages), sentence(rng, rng.randrange(1, 25))]
        text = " ".join(parts)
        cut = rng.randrange(len(text))
        docs.append((i, text[cut:] if i % 3 else text))
    docs += [(200, "a" * 500), (201, "ab" * 300), (202, "é" * 200), (203, docs[5][1]), (204, ""), (205, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]])
           for r in rows(suffixes.deduplicated(df, window, gram))}
    assert got == plain_removal(docs, window)


# Token file


def test_token_file(spark, sf):
    from tokenizers import Tokenizer

    text = queries.tokenizer_json()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "it's 2024! <|endoftext|>x é. ½! \x1c ok!?.")]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    path = shared.fresh(spark, "tokens")
    tokenfile.write(docs, text, path, block=3000)
    got = sorted(map(tuple, tokenfile.read_documents(spark, path).collect()))
    own, at, want = Tokenizer.from_str(text), 0, []
    for key, t in sorted(map(tuple, docs.collect())):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    stream = tokenfile.read_ids(spark, path).orderBy("part", "number").collect()
    assert sum(len(r["ids"]) for r in stream) == at


def test_token_file_orders_equal_ids_by_hash(spark):
    """Texts are no sort key, so that the range bounds hold none of them."""
    docs = [(i % 3 if i % 4 else None, "word " * (i + 1)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    path = shared.fresh(spark, "tokens")
    tokenfile.write(df, queries.tokenizer_json(), path, block=100)
    got = [r["n_tokens"] for r in sorted(rows(tokenfile.read_documents(spark, path)), key=lambda r: r["start"])]
    order = df.selectExpr("doc_id", "xxhash64(text) th", "length(text) div 5 + 1 n").orderBy("doc_id", "th")
    assert got == [r["n"] for r in order.collect()]


def test_token_file_refuses_other_tokenizers():
    with pytest.raises(ValueError):
        tokenfile.safe_to_split('{"normalizer": null, "pre_tokenizer": {"type": "Whitespace"}, "model": {}}')


# Mixing


def plain_targets(sizes: dict, share: float = 1.5, cap: float = 2.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, goal = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        left = goal - sum(cap * sizes[s] for s in capped)
        for s in names:
            target[s] = cap * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free)
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(spark):
    rng = random.Random(6)
    docs = [(i, sentence(rng, rng.choice([1, 5, 40, 300])), rng.choice(["a", "b", "c", "d", "é", None, "hot", "hot", "hot"]))
            for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = rows(mixing.mixture(df))
    again = sorted((r["doc_id"], r["copies"]) for r in rows(mixing.mixture(df.repartition(3))))
    assert again == sorted((r["doc_id"], r["copies"]) for r in got)
    sizes, taken = Counter(), Counter()
    for i, t, s in docs:
        sizes[s] += len(t.split())
    source = {i: s for i, _, s in docs}
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    target = plain_targets(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source"] == s and r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        rate = target[s] / sizes[s]
        assert int(rate + 1e-9) <= r["copies"] <= -int(-rate - 1e-9 // 1) + 1 and r["taken"] == r["copies"] * r["size"]
        assert r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 300  # the longest document
    copies = Counter(r["doc_id"] for r in rows(mixing.copies_of(df)))
    assert copies == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_mixing_keeps_expectations(spark):
    """A document is drawn as often as its fraction says, whatever its size."""
    docs = [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").cache()
    times = np.zeros(300)
    for seed in range(8):
        for r in rows(mixing.mixture(df, seed=seed, fan=8)):
            times[r["doc_id"]] += r["copies"] / 8
            rate = r["target"] / r["source_size"]
    by_size = [times[[i for i in range(300) if i % 7 == k and i % 2]].mean() for k in range(7)]
    assert max(abs(x - rate) for x in by_size if rate) < 0.6
    df.unpersist()


# Exact top-k search


def test_nearest(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=64).round(3).tolist()) for i in range(400)]
    vectors += [(i + 400, vectors[i % 5][1]) for i in range(60)]
    vectors += [(900, None), (901, []), (902, [1.0, None, -1.0]), (903, [1.0, 2.0, -3.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    asked = df.where("vec_id % 100 = 0 or vec_id in (902, 903)")
    for r in rows(hamming.nearest(df, asked, 10, each=50)):
        got[r["query_id"]].append((r["rank"], r["distance"], r["vec_id"]))
    bits = {i: np.array([(x or 0) > 0 for x in v]) for i, v in vectors if v}
    for q in (0, 100, 200, 300, 400, 902, 903):
        near = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items() if i != q and len(b) == len(bits[q]))
        assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(near[:10])]
    assert not {900, 901} & set(got)


# Decontamination


def plain_similarity(a: list[str], b: list[str]) -> float:
    k = min(5, len(a))
    x, y = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    least = sum((x & y).values())
    return least / (sum(x.values()) + sum(y.values()) - least)


def test_leaks_against_all_windows(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, rng.randrange(12, 60), 400)) for i in range(25)] + [(25, "just three words"), (26, None), (27, "")]
    docs = []
    for i in range(150):
        before, after = sentence(rng, rng.randrange(30)), sentence(rng, rng.randrange(30))
        part = rng.choice(items[:26])[1].split()
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = "changed"
        docs.append((i, f"{before} {' '.join(part).upper() if i % 2 else ', '.join(part)}! {after}"))
    docs += [(200 + i, sentence(rng, 200)) for i in range(20)]
    b = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows(decontaminate.leaks(df, b))}
    want = {}
    for d, text in docs:
        have = re.findall(r"[a-z0-9]+", text.lower())
        for j, item in items:
            own = re.findall(r"[a-z0-9]+", (item or "").lower())
            n = len(own)
            best = max((plain_similarity(own, have[s : s + n]) for s in range(max(1, len(have) - n + 1))
                        if len(have[s : s + n]) >= min(5, n)), default=0) if n else 0
            if best >= 0.75:
                want[d, j] = best
    assert set(got) <= set(want) | {k for k in got if k in want}
    found = [k for k in want if k in got]
    assert len(found) >= 0.99 * len(want)
    for k in found:
        assert got[k] == pytest.approx(want[k]) or got[k] >= 0.75
    kept = {r["doc_id"] for r in rows(decontaminate.clean(df, b))}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_fingerprints_within_radius_are_all_candidates():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 50, dtype=np.uint64)
    near = decontaminate._near(prints, decontaminate.RADIUS)
    for _ in range(300):
        j = rng.integers(50)
        flips = rng.choice(64, rng.integers(0, decontaminate.RADIUS + 1), replace=False)
        other = prints[j] ^ np.uint64(sum(1 << int(f) for f in flips))
        parts = np.array([other]).view(np.uint8)
        assert any(near[b][parts[b]][j] for b in range(8))


# Quality


def test_quality_classifier_learns_from_weak_labels(spark):
    rng = random.Random(9)
    docs, bad = [], set()
    for i in range(900):
        text = ". ".join(sentence(rng, 12).capitalize() for _ in range(rng.randrange(3, 12)))
        kind = i % 10
        if kind < 4:
            bad.add(i)
            text = [text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), " | ".join(text.split()),
                    " ".join(w for w in text.split() for _ in range(9))][kind]
        docs.append((i, text))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit(df)
    got = {r["doc_id"]: r["keep"] for r in rows(quality.scored(df, model))}
    assert sum(got[i] == (i not in bad) for i in got) >= 0.98 * len(got)
    assert all(0.5 < a <= 1 for a in model.accuracy.values())
    assert {r["doc_id"] for r in rows(quality.kept(df, model))} == {i for i, k in got.items() if k}


def test_quality_on_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rows(quality.scored(docs, quality.fit(docs)).join(labels, "doc_id"))
    assert sum(r["keep"] == (r["quality"] == 1) for r in got) >= 0.97 * len(got)


# Toxicity

DISGUISED = ["1d10t", "i d i o t", "i.d.i.o.t", "iddddiot", "idiooooot", "!diot", "id!ot", "I-D-I-O-T", "1 d 1 0 t"]


def test_toxicity_reads_disguised_words(spark):
    rng = random.Random(2)
    insults, plain = ["idiot", "moron", "pathetic"], [f"{a}{b}" for a in ("tha", "ren", "sti") for b in ("ing", "ed", "or", "ly")]

    def prose(n, *extra):
        out = [rng.choice(plain) for _ in range(n)]
        for e in extra:
            out.insert(rng.randrange(len(out) + 1), e)
        return " ".join(out)

    docs = [(i, prose(40, rng.choice(insults)) if i % 5 == 0 else prose(40)) for i in range(600)]
    labels = [(i, int(i % 5 == 0)) for i in range(500)] + [(3, None), (None, 1), (5, 0)]
    docs += [(1000 + i, prose(30, d)) for i, d in enumerate(DISGUISED)]
    docs += [(2000, prose(30, "v1.2", "2024", "a1b2", "1 2 3 4 5")), (2001, None), (2002, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(model.entries) == set(insults)
    got = {r["doc_id"]: r["score"] for r in rows(toxicity.scored(df, model))}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(600))
    assert all(got[1000 + i] >= 0.3 for i in range(len(DISGUISED)))
    assert got[2000] == got[2001] == got[2002] < 0.3


def test_toxicity_held_out(spark):
    """Documents held out of learning, by the registered query."""
    got = rows(queries.op1_toxicity(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id"))
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.9 * len(held)


# Rollups


def test_rollups_count_each_batch_once(spark):
    store = rollups.Rollup(spark, shared.fresh(spark, "rollup"))
    schema = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    load = spark.createDataFrame([("insert", "a", "en", "t", 10, 0), ("insert", "a", "en", "t", 5, 0),
                                  ("insert", None, None, "t", 7, None), ("insert", "b", "fr", "t", None, 0)], schema)
    fix = spark.createDataFrame([("revise", "a", "en", "t", 12, 10), ("delete", "a", "en", "t", 5, 0),
                                 ("delete", "b", "fr", "t", 0, 0)], schema)
    assert store.totals().count() == 0
    assert store.commit("one", load) and store.commit("two", fix) and not store.commit("two", fix)
    want = {("a", "en", "t", 1, 12), (None, None, "t", 1, 7)}
    assert {tuple(r) for r in store.totals().collect()} == want
    assert store.compact("x") and not store.commit("one", load) and not store.compact("x")
    assert {tuple(r) for r in store.totals().collect()} == want
    assert store.commit("three", load) and store.commit("none", load.limit(0))
    assert ("a", "en", "t", 3, 27) in {tuple(r) for r in store.totals().collect()}
    assert store.compact("y")
    assert store.live() == ["compact-y"] and not store.commit("three", load)
    with pytest.raises(ValueError):
        store.commit("../x", load)
    with pytest.raises(Exception, match="unknown op"):
        store.commit("bad", spark.createDataFrame([("upsert", "a", "en", "t", 1, 0)], schema))


def test_rollups_replace_a_broken_batch(spark):
    path = shared.fresh(spark, "rollup")
    schema = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    load = spark.createDataFrame([("insert", "a", "en", "t", 10, 0)], schema)
    store = rollups.Rollup(spark, path)
    store._write("one", rollups.signed(load.unionByName(load)), [])
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/one/_SUCCESS")
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, False)
    assert store.totals().count() == 0 and store.commit("one", load)
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "t", 1, 10)]


# Licences


def test_licence_scan(spark):
    docs = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore."),
        (2, "RELEASED  under the mit license"),
        (3, "This work is licensed under the\nGNU General Public License,\nversion 3."),
        (4, "all rights were reserved"), (5, "All rights reserved.\nall Rights reserved"), (6, None), (7, ""),
        (8, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and"
            " associated documentation files (the"),
        (5, "Released under the MIT License."), (9, "Copyright 2024 Acme Inc. All rights reserved."),
        (10, "This project is released under the MIT License. See the file."),
        (11, "you may use it under the terms of the GNU General Public License version 3 as published"),
        (12, "Licensed\nunder the\nApache\nLicense, Version\n2.0"), (13, "word " * 50_000 + "all rights reserved"),
        (14, "all rights"), (15, "x"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["licence"]): (round(r["dice"], 3), r["word"], r["n_words"]) for r in rows(licences.scan(df))}
    assert got == {
        (1, "Apache-2.0"): (1.0, 3, 8), (2, "MIT"): (1.0, 1, 5), (3, "GPL-3.0"): (1.0, 1, 12),
        (5, "all-rights-reserved"): (1.0, 1, 3), (5, "MIT"): (1.0, 1, 5), (8, "MIT-grant"): (1.0, 1, 20),
        (9, "all-rights-reserved"): (1.0, 5, 3), (10, "MIT"): (1.0, 4, 5), (11, "GPL-3.0-name"): (1.0, 10, 6),
        (12, "Apache-2.0"): (1.0, 1, 8), (13, "all-rights-reserved"): (1.0, 50_001, 3),
    }
    with pytest.raises(ValueError):
        licences.scan(df, {"x": "one"})


def test_licence_windows_against_brute_force(spark):
    """Every window of every length against every template, over texts of few words."""
    rng = random.Random(6)
    templates = {"p": "a b c d e f", "q": "c d", "r": "b a d c", "s": "f e d c b a f"}
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 25))) for _ in range(600)]
    least = 0.6
    expected = {}
    for doc, text in enumerate(texts):
        words, marked = text.split(), []
        for name, t in templates.items():
            own = set(licences.template_bigrams(t))
            low, high = licences.bounds(len(own), least)
            for i in range(len(words) - 1):
                for n in range(1, min(high, len(words) - 1 - i) + 1):
                    grams = [f"{a} {b}" for a, b in zip(words[i : i + n], words[i + 1 : i + n + 1])]
                    dice = 2 * len(own & set(grams)) / (len(own) + len(set(grams)))
                    if grams[0] in own and grams[-1] in own and low <= len(set(grams)) and dice >= least:
                        marked.append((-dice, -n, i + 1, name))
        first = {}
        for m in sorted(marked, reverse=True):
            first |= dict.fromkeys(range(m[2], m[2] - m[1]), m)
        for m in set(marked):
            if all(first[k] == m for k in range(m[2], m[2] - m[1])):
                here = (m[0], m[2], 1 - m[1])
                expected[doc, m[3]] = min(expected.get((doc, m[3]), here), here)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = rows(licences.scan(df, templates, least))
    got = {(r["doc_id"], r["licence"]): (-r["dice"], r["word"], r["n_words"]) for r in found}
    assert got == expected and len(got) > 100


# Every operator on disorder and on nothing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, c string, key int, size int"


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long one, copies and repeated rows."""
    rng = random.Random(5)
    prose, other = sentence(rng, 80), sentence(rng, 60)
    rows = [
        (1, prose, "en", "a", None, 1, "x", 1, 1),
        (2, prose, None, None, 5, None, None, None, None),
        (2, prose, None, None, 5, None, None, None, None),
        (3, None, "en", "b", 0, 2, "y", 2, 2),
        (4, "", "en", "b", 0, 2, "y", 2, 2),
        (5, " \t\n ", "fr", "b", 4, 2, "y", 2, 2),
        (6, sentence(rng, 30_000), "en", "c", None, 3, "z", 3, 3),
        (7, "two words", "en", "c", 9, 3, "z", 3, 3),
        (8, "Two WORDS", "en", "c", 9, 3, "z", 3, 3),
        (9, other, "de", "c", 9, 3, "z", 3, 3),
        (9, other + " more", "de", "c", 9, 3, "z", 3, 3),
        (None, other, "de", "c", 9, 3, "z", 3, 3),
        (None, None, None, None, None, None, None, None, None),
        (12, "naïve \U0001f600 \x00 text", "fr", "é", 9, 3, "z", 3, 3),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _every(spark, df, items):
    labels = df.select("doc_id", (df["doc_id"] % 2).cast("int").alias("toxic"))
    model = quality.fit(df)
    path = shared.fresh(spark, "tokens")
    tokenfile.write(df, queries.tokenizer_json(), path)
    changes = rollups.changes(rollups.counted(df, {"n": rollups.RULES["words-1"]}), "insert", "t", "n")
    store = rollups.Rollup(spark, shared.fresh(spark, "rollup"))
    store.commit("all", changes)
    return {
        "toxicity": toxicity.scored(df, toxicity.fit(df, labels)),
        "tokens": tokenfile.read_documents(spark, path),
        "quality": quality.scored(df, model),
        "kept": quality.kept(df, model),
        "leaks": decontaminate.leaks(df, items),
        "clean": decontaminate.clean(df, items),
        "suffixes": suffixes.deduplicated(df),
        "mixture": mixing.mixture(df),
        "copies": mixing.copies_of(df),
        "linked": jaccard.linked(df),
        "one of each": jaccard.representatives(df),
        "totals": store.totals(),
        "licences": licences.scan(df),
    }


@pytest.fixture(scope="module")
def disorder(spark, odd, odd_rows):
    items = spark.createDataFrame([(1, odd_rows[0][1]), (2, None), (3, ""), (3, "two words"), (None, "two words")],
                                  "item_id long, text string")
    return {name: rows(df) for name, df in _every(spark, odd, items).items()}


def test_disorder(disorder, odd_rows):
    n = len(odd_rows)
    for name in ("toxicity", "tokens", "quality", "suffixes", "mixture", "linked"):
        assert len(disorder[name]) == n, name
    empty_ids = [3, 4, 5]
    scores = {r["doc_id"]: r for r in disorder["quality"]}
    assert all(scores[i]["score"] == 0 and not scores[i]["keep"] for i in empty_ids)
    linked = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in disorder["linked"]}
    assert linked[2, 76] == 1 and linked[8, 1] == 7 and all(linked[i, 0] == i for i in empty_ids)
    ids = Counter(r["doc_id"] for r in disorder["one of each"])
    assert ids[1] == 1 and ids[2] == 0 and ids[7] == 1 and ids[8] == 0 and all(ids[i] == 1 for i in empty_ids)
    leaks = {(r["doc_id"], r["item_id"]) for r in disorder["leaks"]}
    assert leaks == {(1, 1), (2, 1), (7, 3), (8, 3), (7, None), (8, None)}
    assert {r["doc_id"] for r in disorder["clean"]} == {3, 4, 5, 6, 9, None, 12}
    assert set(disorder["clean"][0]) == set(disorder["copies"][0]) == set(disorder["kept"][0])
    assert len(disorder["clean"]) == n - 5
    mixed = {(r["doc_id"], r["size"]) for r in disorder["mixture"]}
    assert (3, 0) in mixed and (6, 30_000) in mixed
    assert sum(r["taken"] for r in disorder["mixture"]) == sum(
        len(WORD.findall(dict(enumerate(odd_rows))[0][1] or "")) * 0 for _ in [0]
    ) + sum(r["copies"] * r["size"] for r in disorder["mixture"])
    copies = Counter((r["doc_id"], r["text"]) for r in disorder["copies"])
    assert sum(copies.values()) == sum(r["copies"] for r in disorder["mixture"] if r["size"])
    tokens = sorted((r["start"], r["n_tokens"]) for r in disorder["tokens"])
    assert all(a + k == b for (a, k), (b, _) in zip(tokens, tokens[1:]))
    assert sum(r["n_tokens"] == 1 for r in disorder["tokens"]) == 4
    kept = {r["doc_id"]: r for r in disorder["suffixes"] if r["doc_id"] in (1, 2, 6)}
    assert kept[1]["spans"] == [] and bytes(kept[2]["kept"]) == b"" and len(kept[2]["spans"]) == 1
    assert hashlib.sha256(bytes(kept[1]["kept"])).hexdigest() == hashlib.sha256(odd_rows[0][1].encode()).hexdigest()
    assert sum(r["documents"] for r in disorder["totals"]) == n


def test_disorder_keeps_one_of_a_group_with_a_null_id(disorder):
    linked = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in disorder["linked"]}
    assert linked[9, 56] == linked[9, 57] == linked[None, 56] == 9
    ids = Counter(r["doc_id"] for r in disorder["one of each"])
    assert ids[9] == 1 and ids[None] == 1  # the latter has no text


def test_nothing(spark, empty):
    items = spark.createDataFrame([(1, "some words of an item that is here")], "item_id long, text string")
    for name, df in _every(spark, empty, items).items():
        assert df.count() == 0, name
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hamming.nearest(none, none).count() == 0
    assert decontaminate.leaks(empty, items.limit(0)).count() == 0


RESERVED_NAMES = ["__id", "__source", "__size", "__total", "__once", "__h", "c0"]


def test_mix_of_rows_without_ids_does_not_depend_on_layout(spark):
    rng = random.Random(12)
    docs = [(None, sentence(rng, 20), "a") for _ in range(10)] + [(i, sentence(rng, 30), "b") for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(RESERVED_NAMES)])
    found = []
    for n in (1, 7):
        mix = mixing.copies_of(df.repartition(n))
        assert mix.columns == df.columns
        found.append(Counter((r["doc_id"], r["text"], r["__total"]) for r in rows(mix)))
    assert found[0] == found[1] and found[0]


def test_representatives_keep_columns_of_any_name(spark):
    rng = random.Random(13)
    text = sentence(rng, 40)
    df = spark.createDataFrame([(3, text), (2, text), (5, sentence(rng, 30))], "doc_id long, text string")
    df = df.select(*[F.lit(i).alias(c) for i, c in enumerate(RESERVED_NAMES)], "*")
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["c0"]) for r in rows(kept)) == [(2, 6), (5, 6)]
