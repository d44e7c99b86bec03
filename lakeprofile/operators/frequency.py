"""Value frequencies of many columns from a single shuffle."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeprofile.functions.columns import (
    FOLD_BYTES, as_double, as_text, fold, is_text, text_key,
)
from lakeprofile.functions.text import parse_date, parses_as_number, reads_as_missing, strip
from lakeprofile.operators.quantiles import group_number, values_at

TOP_VALUES = 10
# Whole numbers up to here are exact as doubles.
EXACT_DOUBLE = 2.0**53


@dataclass
class TextChecks:
    """What the cells of one text column hold; counts of present cells."""

    numbers: int = 0
    dates: int = 0
    hidden: int = 0  # placeholders that read as missing
    examples: list[str] = field(default_factory=list)
    spellings: int = 0  # labels that occur in several spellings
    variants: list[str] = field(default_factory=list)  # the spellings of the first of them


@dataclass
class Frequencies:
    """Frequency summary of one column."""

    unique: int = 0
    top_count: int = 0
    entropy_bits: float = 0.0
    top: list[tuple[str, int]] = field(default_factory=list)  # (value, count), ties by value
    mode: float | None = None  # lowest most frequent number
    at_rank: dict[int, float] = field(default_factory=dict)  # requested order statistics
    text: TextChecks = field(default_factory=TextChecks)


def exact_as_double(dtype: T.DataType, limits: tuple[float, float] | None) -> bool:
    """Whether a numeric column can be counted by its double values."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(dtype, T.LongType):
        return limits is not None and max(abs(v) for v in limits) < EXACT_DOUBLE
    return isinstance(dtype, T.IntegralType)


def number_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, x, n): how often each number occurs, c being the column's position in the list."""
    cells = df.select(*[as_double(df, c).alias(str(k)) for k, c in enumerate(columns)])
    melted = cells.unpivot([], cells.columns, "c", "x").where("x is not null")
    return (
        melted.select(group_number("c"), "x").groupBy("c", "x").agg(F.count(F.lit(1)).alias("n"))
    )


def number_frequencies(
    df: DataFrame,
    columns: list[str],
    ranks: dict[str, list[int]] | None = None,
    limits: dict[str, tuple[float, float]] | None = None,
) -> dict[str, Frequencies]:
    """Distinct count, mode and requested order statistics of numeric columns.

    ``ranks`` names order statistics of columns small enough for one window, ``limits`` their
    smallest and largest values.  Every branch of the union reads the same frequency shuffle,
    where partial aggregation has merged the copies of a hot value.
    """
    out = {c: Frequencies() for c in columns}
    if not columns:
        return out
    counts = number_counts(df, columns)
    totals = counts.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.max("n").alias("top_n"), F.sum("n").alias("total"),
        F.sum(F.col("n") * F.log2("n")).alias("weighted_log"),
    )
    parts = totals.withColumn("part", F.lit("summary"))
    top = totals.select(group_number("c"), F.col("top_n"))
    modes = (
        counts.join(F.broadcast(top), "c")  # one row per column
        .where(F.col("n") == F.col("top_n"))
        .groupBy("c")
        .agg(F.lit("mode").alias("part"), F.min("x").alias("x"))
    )
    parts = parts.unionByName(modes, allowMissingColumns=True)
    targets = {columns.index(c): r for c, r in (ranks or {}).items() if r}
    if targets:
        found = values_at(counts, targets, {c: limits[columns[c]] for c in targets})
        parts = parts.unionByName(found.withColumn("part", F.lit("rank")), allowMissingColumns=True)
    for r in parts.collect():
        f = out[columns[r["c"]]]
        if r["part"] == "summary":
            f.unique, f.top_count = r["n"], r["top_n"]
            f.entropy_bits = _entropy(r["total"], r["weighted_log"])
        elif r["part"] == "mode":
            f.mode = r["x"]
        else:
            f.at_rank[r["rank"]] = r["x"]
    for c, f in out.items():
        if f.mode is not None:
            whole = isinstance(df.schema[c].dataType, T.IntegralType)
            f.top = [(str(int(f.mode)) if whole else str(f.mode), f.top_count)]
    return out


def _entropy(total: int, weighted_log: float) -> float:
    return max(0.0, math.log2(total) - weighted_log / total)


def plain_label(text: Column) -> Column:
    """What all spellings of a label share, whatever their case and padding; long ones as a digest."""
    return fold(F.lower(strip(text)))


def text_counts(df: DataFrame, columns: list[str], checks: bool = False) -> DataFrame:
    """(c, s, n): how often each value occurs as text; long text travels as a digest.

    With ``checks``, long text also carries what its digest can no longer tell.
    """
    cells = []
    for k, c in enumerate(columns):
        s = text_key(df, c)
        number = hidden = date = F.lit(False)
        label = F.lit(None).cast("string")
        if checks and is_text(df.schema[c].dataType):
            text = as_text(df, c)
            long = F.octet_length(text) > FOLD_BYTES
            number = F.coalesce(long & parses_as_number(text), F.lit(False))
            hidden = F.coalesce(long & reads_as_missing(text), F.lit(False))
            date = F.coalesce(long & parse_date(text).isNotNull(), F.lit(False))
            label = F.when(long, plain_label(text))
        parts = [s.alias("s")]
        if checks:
            parts += [number.alias("long_number"), hidden.alias("long_hidden"), date.alias("long_date"),
                      label.alias("long_label")]
        cells.append((F.struct(*parts) if checks else s).alias(str(k)))
    names = [str(k) for k in range(len(columns))]
    melted = df.select(*cells).unpivot([], names, "c", "v" if checks else "s")
    melted = melted.select(group_number("c"), "v.*" if checks else "s").where("s is not null")
    keys = ["c", "s", *(["long_number", "long_hidden", "long_date", "long_label"] if checks else [])]
    return melted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def text_frequencies(
    df: DataFrame, columns: list[str], checks: bool = False, keep: int = TOP_VALUES
) -> dict[str, Frequencies]:
    """Distinct count, entropy and the ``keep`` top values of columns compared as text.

    ``checks`` looks into the text, once per distinct value.  Every branch of the union reads the
    same frequency shuffle.  The top branch keeps a few rows per column and task before its own
    exchange, so no task sees a whole column.  Numeric columns, which come here to keep every
    digit, also get their lowest most frequent number.
    """
    out = {c: Frequencies() for c in columns}
    if not columns:
        return out
    counts = text_counts(df, columns, checks)
    totals = counts.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n").alias("total"), F.max("n").alias("top_n"),
        F.sum(F.col("n") * F.log2("n")).alias("weighted_log"),
    )
    parts = totals.withColumn("part", F.lit("summary"))
    order = Window.partitionBy("c").orderBy(F.desc("n"), "s")
    top = (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= keep)
        .select("c", F.lit("top").alias("part"), "n", "rank", F.col("s").alias("shown"))
    )
    parts = parts.unionByName(top, allowMissingColumns=True)
    numbers = [k for k, c in enumerate(columns) if isinstance(df.schema[c].dataType, T.NumericType)]
    if numbers:
        most = totals.select(group_number("c"), F.col("top_n").alias("most"))
        modes = (
            counts.where(F.col("c").isin(numbers))
            .join(F.broadcast(most), "c")  # one row per column
            .where(F.col("n") == F.col("most"))
            .groupBy("c")
            .agg(F.lit("mode").alias("part"), F.min(F.expr("try_cast(s as double)")).alias("x"))
        )
        parts = parts.unionByName(modes, allowMissingColumns=True)
    if checks:
        parts = parts.unionByName(_text_checks(counts), allowMissingColumns=True)
        parts = parts.unionByName(_spellings(counts), allowMissingColumns=True)
    for r in sorted(parts.collect(), key=lambda r: r["rank"] or 0):
        f = out[columns[r["c"]]]
        if r["part"] == "summary":
            f.unique, f.entropy_bits = r["n"], _entropy(r["total"], r["weighted_log"])
        elif r["part"] == "mode":
            f.mode = r["x"]
        elif r["part"] == "text":
            f.text.numbers, f.text.dates, f.text.hidden = r["numbers"], r["dates"], r["hidden"]
            f.text.examples = sorted(r["examples"])
        elif r["part"] == "spellings":
            f.text.spellings, f.text.variants = r["labels"], sorted(r["first"]["variants"])
        else:
            f.top.append((r["shown"], r["n"]))
            if r["rank"] == 1:
                f.top_count = r["n"]
    _unfold(df, out)
    return out


def _text_checks(counts: DataFrame) -> DataFrame:
    text, n = F.col("s"), F.col("n")
    folded = F.octet_length(text) > FOLD_BYTES
    is_number = F.when(folded, F.col("long_number")).otherwise(parses_as_number(text))
    is_hidden = F.when(folded, F.col("long_hidden")).otherwise(reads_as_missing(text))
    is_date = F.when(folded, F.col("long_date")).otherwise(parse_date(text).isNotNull())
    # Spellings of ten short words without their padding: a bounded set.
    example = F.when(is_hidden & ~folded, strip(text))
    return counts.groupBy("c").agg(
        F.lit("text").alias("part"),
        F.coalesce(F.sum(F.when(is_number, n)), F.lit(0)).alias("numbers"),
        F.coalesce(F.sum(F.when(is_date, n)), F.lit(0)).alias("dates"),
        F.coalesce(F.sum(F.when(is_hidden, n)), F.lit(0)).alias("hidden"),
        F.collect_set(example).alias("examples"),
    )


def _spellings(counts: DataFrame) -> DataFrame:
    """How many labels occur in spellings that differ in case or padding only, and the first one's.

    Labels of any length, however many a column has; both sums are merged in every task.
    """
    label = F.coalesce(F.col("long_label"), plain_label(F.col("s")))
    # Two are enough for an example, so no label gathers its spellings.
    merged = counts.groupBy("c", label.alias("label")).agg(
        F.count("s").alias("k"), F.min("s").alias("low"), F.max("s").alias("high"),
        F.sum("n").alias("rows"),
    )
    first = F.struct("label", F.array("low", "high").alias("variants"))
    return merged.where("k > 1").groupBy("c").agg(
        F.lit("spellings").alias("part"), F.count(F.lit(1)).alias("labels"), F.min(first).alias("first"),
        F.sum("rows").alias("n"),  # asked for by every branch, or this one would scan by itself
    )


def _unfold(df: DataFrame, found: dict[str, Frequencies]) -> None:
    """Replace the digests among reported values by the texts they stand for."""
    wanted = [
        (c, v) for c, f in found.items() for v in [v for v, _ in f.top] + f.text.variants
        if len(v) == FOLD_BYTES + 1 and v.startswith("#")
    ]
    if not wanted:
        return
    names = sorted({c for c, _ in wanted})
    texts = df.select(*[as_text(df, c).alias(str(k)) for k, c in enumerate(names)])
    keys = df.sparkSession.createDataFrame(
        [(str(names.index(c)), v) for c, v in wanted], "c string, key string"
    )
    rows = (
        texts.unpivot([], texts.columns, "c", "text")
        .where(F.octet_length("text") > FOLD_BYTES)
        .withColumn("key", fold(F.col("text")))
        .join(F.broadcast(keys), ["c", "key"])  # a few keys per column
        .groupBy("c", "key")
        .agg(F.first("text").alias("text"))
        .collect()
    )
    full = {(names[int(r["c"])], r["key"]): r["text"] for r in rows}
    for c, f in found.items():
        f.top = [(full.get((c, v), v), n) for v, n in f.top]
        f.text.variants = sorted(full.get((c, v), v) for v in f.text.variants)


def value_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every value of every column, as whole text, with its count and share, distributed.

    The values are the result here, so they travel whole, once per task that holds them.
    """
    cells = df.select(*[as_text(df, c).alias(str(k)) for k, c in enumerate(columns)])
    melted = cells.unpivot([], cells.columns, "c", "value").where("value is not null")
    counts = (
        melted.select(group_number("c"), "value")
        .groupBy("c", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    names = F.array(*[F.lit(c) for c in columns])
    totals = counts.groupBy("c").agg(F.sum("count").alias("total"))
    totals = F.broadcast(totals.select(group_number("c"), "total"))  # one row per column
    return counts.join(totals, "c").select(
        names[F.col("c")].alias("column"), "value", "count",
        (F.col("count") / F.col("total")).alias("share"),
    )


def rarest_value(df: DataFrame, column: str) -> tuple[str, int]:
    """The least frequent value as text and its count; the lowest one on ties."""
    r = value_table(df, [column]).orderBy("count", "value").first()
    return r["value"], r["count"]
