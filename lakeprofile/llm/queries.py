"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprofile.llm import (
    bytebpe,
    decontaminate,
    dialogue,
    hamming,
    jaccard,
    licences,
    merkle,
    mixing,
    quality,
    rollups,
    shared,
    suffixes,
    tokenfile,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column: str):
    """The remainder by 4 of an id's CRC-32, by which documents are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_remainder("doc_id") != 2)
    model = toxicity.fit(docs, labels)
    return toxicity.scored(docs, model).select(
        "doc_id", (_remainder("doc_id") == 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.CUTOFF).cast("int").alias("predicted"), "entries", "restored",
    )


def tokenizer_json() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.fresh(spark, "tokens")
    tokenfile.write(_table(spark, sf_dir, "documents"), tokenizer_json(), path)
    return tokenfile.read_documents(spark, path)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixes.deduplicated(_table(spark, sf_dir, "documents"))
    lengths = F.transform("spans", lambda s: s["stop"] - s["start"])
    return rows.select(
        "doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixture(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return hamming.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(_table(spark, sf_dir, "documents"))


def op9_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents inserted, recounted and in part deleted, one batch delivered twice.

    All are inserted with their words; counts are revised to words that hold a letter or digit;
    documents with fewer than 5 of these are deleted; a second tokenizer version is inserted.
    """
    rules = {"n1": rollups.RULES["words-1"], "n2": rollups.RULES["words-2"], "p": rollups.RULES["pieces-1"]}
    counts = shared.cut(rollups.counted(_table(spark, sf_dir, "documents"), rules), "counts")
    store = rollups.Rollup(spark, shared.fresh(spark, "rollup"))
    revised = rollups.changes(counts, "revise", "words", "n2", "n1")
    store.commit("load", rollups.changes(counts, "insert", "words", "n1"))
    store.commit("recount", revised)
    store.commit("drop-short", rollups.changes(counts.where("n2 < 5"), "delete", "words", "n2"))
    store.commit("recount", revised)
    store.compact("first")
    store.commit("pieces", rollups.changes(counts, "insert", "pieces-1", "p"))
    return store.totals()


def _op9_sql() -> str:
    n2, p = (f"len(regexp_extract_all(text, '{rollups.RULES[r]}'))" for r in ("words-2", "pieces-1"))
    return f"""
with c as (select source, lang, coalesce({n2}, 0) n2, coalesce({p}, 0) p from documents),
t as (
  select source, lang, 'words' tokenizer, count(*)::bigint documents, sum(n2)::bigint tokens
  from c where n2 >= 5 group by all
  union all
  select source, lang, 'pieces-1', count(*)::bigint, sum(p)::bigint from c group by all)
select source, lang, tokenizer, documents, tokens from t
"""


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def byte_ranks() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), encoding="ascii") as f:
        return f.read()


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_ranks()
    encoded = bytebpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bytebpe.digests(encoded, ranks)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs for all documents, checked against a table where some texts were tampered with."""
    docs = _table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in merkle.FIELDS]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = merkle.leaf([*fields[:-1], F.translate("text", upper, upper.lower())])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", merkle.leaf(fields).alias("leaf"), F.when(hit, tampered).alias("tampered"))
    rows = merkle.proofs(leaves, "source", "doc_id", "leaf", "tampered")
    end = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        end.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return dialogue.report(conversations, dialogue.damaged(conversations))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_file": op2_token_file,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mixing": op6_mixing,
    "op7_hamming_topk": op7_hamming_topk,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_token_rollups": op9_token_rollups,
    "op10_licence_scan": op10_licence_scan,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE = {
    "op7_hamming_topk": hamming.oracle(),
    "op9_token_rollups": _op9_sql(),
    "op10_licence_scan": licences.oracle(),
    "op12_merkle_manifest": merkle.oracle(),
    "op13_conversation_repair": dialogue.oracle(),
}
