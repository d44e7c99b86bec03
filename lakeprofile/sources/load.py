"""Reading any supported source, and small preparations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprofile.functions.columns import col, group_key
from lakeprofile.operators.quantiles import select_ranks
from lakeprofile.sources.delimited import read_delimited
from lakeprofile.sources.workbook import read_workbook

DELIMITED = (".csv", ".tsv", ".txt")
WORKBOOKS = (".xlsx", ".xlsm")
COLUMNAR = {".parquet": "parquet", ".orc": "orc"}
SAMPLE_SEED = 42
_DRAW, _KEY, _UNIT, _COPIES, _TAKEN = "_draw", "_key", "_unit", "_copies", "_taken"


def extension(path: str) -> str:
    """The ending of a file's, folder's or pattern's name, without a compression's."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for packed in (".gz", ".bz2"):
        name = name.removesuffix(packed)
    return "." + name.rsplit(".", 1)[1].rstrip("*") if "." in name else ""


def load_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    sheet: str | int | None = None,
    parse_dates: list[str] | None = None,
) -> DataFrame:
    """A file, folder or pattern as a table, by its extension or ``fmt`` (one without the dot)."""
    kind = f".{fmt}" if fmt else extension(path)
    if kind in DELIMITED:
        return read_delimited(spark, path, parse_dates)
    if kind in WORKBOOKS:
        return read_workbook(spark, path, sheet, parse_dates)
    if kind in COLUMNAR:
        return spark.read.format(COLUMNAR[kind]).load(path)
    expected = [*DELIMITED, *WORKBOOKS, *COLUMNAR]
    raise ValueError(f"no reader for {kind or path!r}; there are readers for {', '.join(expected)}")


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The table without these columns; unknown names are ignored."""
    return df.drop(*names)


def sample_rows(df: DataFrame, n: int | None, seed: int = SAMPLE_SEED) -> DataFrame:
    """Exactly n random rows; the whole table if it has no more.

    A row's draw is a hash of its cells, so the same seed gives the same rows however they are
    stored, and a task that runs again agrees.  Of m equal rows the draws are (j + u) / m, j from 0,
    so about m times the sampled share of them is taken.  The exact n-th smallest draw is the cut;
    nothing is sorted as a whole and no task holds the sample.
    """
    if not n:
        return df
    rows = df.count()
    if rows <= n:
        return df
    cells = [group_key(df, c) for c in df.columns]
    gaps = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    keyed = df.withColumn(_KEY, F.xxhash64(F.lit(seed), gaps, *cells))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), _KEY), 11).cast("double") * 2.0**-53
    share = min(1.0, (n + 10 * math.sqrt(n) + 10) / rows)
    copies = keyed.groupBy(_KEY).agg(F.count(F.lit(1)).alias(_COPIES)).withColumn(_UNIT, unit)

    below = F.ceil(F.col(_COPIES) * F.lit(share) - F.col(_UNIT))  # draws below the share
    below = F.least(F.greatest(below, F.lit(0)), F.col(_COPIES)).cast("int")
    low = copies.withColumn(_TAKEN, below).where(F.col(_TAKEN) > 0)
    draws = low.select(
        F.explode(F.sequence(F.lit(0), F.col(_TAKEN) - 1)).alias("j"), _UNIT, _COPIES
    ).select(((F.col("j") + F.col(_UNIT)) / F.col(_COPIES)).alias(_DRAW))
    found = draws.agg(F.count(F.lit(1)), F.min(_DRAW), F.max(_DRAW)).first()
    if found[0] < n:  # the draws came out short, which is next to impossible
        return sample_rows(df, n, seed + 1)
    x = {"draw": F.col(_DRAW)}
    cut = select_ranks(draws, x, {"draw": [n - 1]}, {"draw": found[0]}, {"draw": found[1:]})
    cut = cut["draw"][n - 1]
    chosen = low.withColumn(_TAKEN, _draw_below(cut))
    chosen = chosen.where(F.col(_TAKEN) > 0).select(_KEY, _TAKEN, _COPIES)
    picked = keyed.join(chosen, _KEY)
    single = picked.where(F.col(_COPIES) == 1).select(*map(col, df.columns))
    whole = F.struct(*map(col, df.columns))
    several = (
        picked.where(F.col(_COPIES) > 1).groupBy(_KEY)
        .agg(F.first(whole).alias("row"), F.first(_TAKEN).alias(_TAKEN))
        .select("row", F.explode(F.sequence(F.lit(1), F.col(_TAKEN))).alias("j")).select("row.*")
    )
    return single.unionByName(several)


def _draw_below(cut: float) -> Column:
    """Draws of a row at or below the cut, computed as they were drawn."""
    each = F.transform(
        F.sequence(F.lit(0), F.col(_TAKEN) - 1), lambda j: (j + F.col(_UNIT)) / F.col(_COPIES)
    )
    return F.size(F.filter(each, lambda d: d <= F.lit(cut)))


def prepare(
    df: DataFrame, drop: list[str] | None = None, sample: int | None = None
) -> DataFrame:
    return sample_rows(drop_columns(df, drop or []), sample)
