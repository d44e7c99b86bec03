"""The pipeline, stage by stage, against plain Python on the smallest tables."""

from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

import __spark_entry__ as entry
from lakeprofile.llm import decontaminate, queries, shared


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    first = docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == first.columns, name
        docs = shared.cut(out, "stage")
        kept.append(Counter(r["doc_id"] for r in docs.select("doc_id").collect()))
    everything = Counter(r["doc_id"] for r in first.collect())
    for before, after in zip([everything, *kept], kept[:3]):
        assert set(after) <= set(before) and max(after.values()) == 1
    judged = [i for i in everything if i in labels]
    assert sum((i in kept[0]) == (labels[i] == 1) for i in judged) >= 0.95 * len(judged)
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    assert len({texts[i] for i in kept[1]}) == len(kept[1])
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.leaks(docs, items).count() == 0
    assert max(kept[3].values()) <= 2 and set(kept[3]) <= set(kept[2])

    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).orderBy("start").collect()
    own = Tokenizer.from_str(queries.tokenizer_json())
    at = 0
    for r, i in zip(last, sorted(kept[3].elements()), strict=True):
        ids = [*own.encode(texts[i], add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
