"""Exact duplicate rows and duplicate columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeprofile.functions.columns import aggregate_once, group_key, is_nested, value


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row (rows, duplicates): duplicates are the rows after the first of each value.

    Missing cells compare equal.  A row travels as two 64-bit hashes of its cells and of which of
    them are missing; copies collapse inside each task before the shuffle.
    """
    cells = [group_key(df, c) for c in df.columns]
    gaps = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells]) if cells else F.lit("")
    hashes = [F.xxhash64(F.lit(seed), gaps, *cells).alias(f"h{seed}") for seed in (1, 2)]
    groups = df.select(*hashes).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
    )


def duplicate_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Pairs of columns of one type holding the same values row by row.

    An order-free sum of hashes per column narrows the pairs; an equality pass over the rest decides.
    """
    columns = [f.name for f in df.schema.fields if not is_nested(f.dataType)]
    hashes = aggregate_once(df, {c: F.sum(F.xxhash64(value(df, c)).cast("decimal(38,0)")) for c in columns})
    if any(h is None for h in hashes.values()):  # no rows
        return []
    same_hash = [
        (a, b)
        for a, b in combinations(columns, 2)
        if hashes[a] == hashes[b] and _type(df, a) == _type(df, b)
    ]
    equal = aggregate_once(
        df, {(a, b): F.bool_and(value(df, a).eqNullSafe(value(df, b))) for a, b in same_hash}
    ) if same_hash else {}
    return [pair for pair in same_hash if equal[pair]]


def _type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType
