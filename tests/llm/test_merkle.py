"""Merkle proofs against a plain tree."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeprofile.llm import merkle, queries

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc: tuple) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in doc))


def plain_tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The top and each node's proof."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            run = i // 16 * 16
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def plain(docs: list[tuple]) -> Counter:
    groups = {}
    for d in docs:
        groups.setdefault(d[1], []).append((d[0], plain_leaf(d)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, below = [], {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        top, below[s] = plain_tree([leaf for _, leaf in groups[s]])
        subroots.append(top)
    if not names:
        return Counter()
    root, above = plain_tree(subroots)
    return Counter(
        (i, leaf, subroots[k], root, tuple(below[s][j] + above[k]))
        for k, s in enumerate(names) for j, (i, leaf) in enumerate(groups[s])
    )


def found(spark, docs: list[tuple], extra: str = "") -> Counter:
    df = spark.createDataFrame(docs, FIELDS)
    for name in extra.split():
        df = df.withColumn(name, F.lit("x"))
    leaves = df.withColumn("leaf", merkle.leaf([F.col(c) for c in merkle.FIELDS]))
    got = merkle.proofs(leaves.repartition(3), "source", "doc_id", "leaf", *extra.split())
    return Counter(
        (r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["path"]))
        for r in rows(got)
    )


def corpus(rng: random.Random, sizes: dict) -> list[tuple]:
    docs = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Ünï\ncode", "x" * rng.randrange(60), "Some Text"])
            docs.append((rng.randrange(10**6), source, rng.choice(["en", None, ""]), rng.choice([None, 7]), text))
    return docs


@pytest.mark.parametrize("levels", [1, 3])
def test_trees_of_all_heights(spark, monkeypatch, levels):
    """Blocks of one level make many rounds of the same tree."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    sizes = {None: 3, "": 1, "a": 16, "b": 17, "c": 256, "ä": 257, "Z": 600, **{f"s{i}": 1 for i in range(12)}}
    docs = corpus(random.Random(levels), sizes)
    docs += [docs[0], docs[30], (None, "a", None, None, None), (None, "a", None, None, None), (None, "a", None, 1, "t")]
    assert found(spark, docs) == plain(docs)


def test_few_rows_and_clashing_names(spark):
    one = [(5, "a", "en", 3, "abc")]
    assert found(spark, one, "tree hash item path block") == plain(one)
    assert found(spark, []) == plain([])
    same = [(1, None, None, None, None)] * 20
    assert found(spark, same) == plain(same)


def test_tampered_texts_are_noticed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: tuple(r) for r in docs.select(*merkle.FIELDS).collect()}
    import zlib

    got = rows(queries.op12_merkle_manifest(spark, "/root/testdata/sf0.001"))
    assert {r["doc_id"] for r in got} == set(texts) and len({r["root"] for r in got}) == 1
    for r in got:
        hit = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in texts[r["doc_id"]][4])
        assert r["verified"] == (not hit) == (r["folded_root"] == r["root"])
        assert r["leaf"] == plain_leaf(texts[r["doc_id"]])
