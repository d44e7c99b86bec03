"""Token counts as delta-maintained rollups: signed changes by source, language and tokenizer.

A batch of changes is reduced to one row per (source, lang, tokenizer) and written to a folder of
its own below the store; Spark's _SUCCESS file, written last, commits it. A batch whose folder is
committed is not written again, so that a repeated or restarted job counts nothing twice; a folder
without that file is left over from a broken run and is replaced. Totals are sums over committed
batches, and `compact` folds them into one batch that names its parts.

Changes have the columns op ('insert', 'delete', 'revise'), source, lang, tokenizer, n_tokens and
old_tokens (only read for 'revise'). A delete gives the counts that were inserted; a revision gives
the new and the old count of a document that stays.

Defined results: null keys are keys of their own; null counts are 0; repeated rows count as often
as they occur; an empty batch commits and adds nothing; an unknown op raises. Cells that fall back
to no documents and no tokens are left out of the totals. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprofile.llm import shared

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long, parts array<string>"

#: Token rules by version, as regular expressions that match one token each.
RULES = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "words-2": r"[^\x20\x09-\x0D]*[A-Za-z0-9][^\x20\x09-\x0D]*",
    "pieces-1": r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x00-\x20]",
}


def tokens(text: Column, rule: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rule)), F.lit(0)).cast("long")


def signed(changes: DataFrame) -> DataFrame:
    """Additive amounts per key: partial sums in each task, so a frequent key costs no more."""
    op = F.col("op")
    n, old = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_tokens", "old_tokens"))
    known = F.when(op.isin("insert", "delete", "revise"), op).otherwise(
        F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null"))))
    )
    documents = F.when(known == "insert", 1).when(known == "delete", -1).otherwise(0).cast("long")
    change = F.when(known == "insert", n).when(known == "delete", -n).otherwise(n - old)
    return (
        changes.select(*KEYS, documents.alias("documents"), change.alias("tokens"))
        .groupBy(*KEYS)
        .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    )


class Rollup:
    """A store of committed batches in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"a batch is named by letters, digits, '_', '-' and '.': {batch!r}")
        return f"{self.path}/{batch}"

    def committed(self, batch: str) -> bool:
        return shared.exists(self.spark, self._at(batch) + "/_SUCCESS")

    def _write(self, batch: str, rows: DataFrame, parts: Iterable[str]) -> None:
        named = F.array(*map(F.lit, parts)).cast("array<string>")
        rows.withColumn("parts", named).coalesce(1).write.mode("overwrite").parquet(self._at(batch))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Count a batch once; False where it was already counted."""
        if self.committed(batch) or batch in self._folded():
            return False
        self._write(batch, signed(changes), [])
        return True

    def batches(self) -> list[str]:
        return [b for b in shared.children(self.spark, self.path) if self.committed(b)]

    def _read(self, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*map(self._at, batches))

    def _folded(self) -> set[str]:
        """Batches that a compacted one already holds; as many as batches, not as rows."""
        every = self.batches()
        rows = self._read([b for b in every if b.startswith("compact-")])
        named = rows.select(F.explode("parts").alias("b")).distinct().collect()
        return {r["b"] for r in named}

    def live(self) -> list[str]:
        """Committed batches that no compacted batch holds."""
        folded = self._folded()
        return [b for b in self.batches() if b not in folded]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over all committed batches."""
        sums = [F.sum(c).alias(c) for c in ("documents", "tokens")]
        rows = self._read(self.live()).groupBy(*KEYS).agg(*sums)
        return rows.where("documents <> 0 or tokens <> 0")

    def compact(self, name: str) -> bool:
        """Fold all live batches into batch 'compact-<name>'; their own folders stay."""
        batch, parts = f"compact-{name}", self.live()
        if self.committed(batch) or not parts:
            return False
        every = sorted(set(parts) | self._folded())
        sums = [F.sum(c).alias(c) for c in ("documents", "tokens")]
        self._write(batch, self._read(parts).groupBy(*KEYS).agg(*sums), every)
        return True


def counted(docs: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """source, lang and a count by each rule, from one scan of the texts."""
    text = F.col("text")
    return docs.select("source", "lang", *(tokens(text, r).alias(v) for v, r in rules.items()))


def changes(counts: DataFrame, op: str, tokenizer: str, n: str, old: str | None = None) -> DataFrame:
    """The counts of every document as changes of one kind."""
    return counts.select(
        F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"),
        F.col(n).alias("n_tokens"), (F.col(old) if old else F.lit(0)).alias("old_tokens"),
    )
