"""One-pass column counts and moments."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeprofile.functions.columns import (
    aggregate_once, as_double, col, is_datetime, is_number, is_text, value,
)


@dataclass
class Moments:
    """Null-skipping statistics of one numeric column; None where undefined."""

    count: int
    mean: float | None
    std: float | None
    minimum: float | None
    maximum: float | None
    skewness: float | None
    kurtosis: float | None
    whole: bool


FIELDS = [f.name for f in fields(Moments)]


def present_counts(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    """Row count and per-column count of present values, in one scan."""
    exprs = {("rows",): F.count(F.lit(1))}
    exprs |= {("n", c): F.count(value(df, c)) for c in columns}
    got = aggregate_once(df, exprs)
    return got[("rows",)], {c: got[("n", c)] for c in columns}


def numeric_moments(
    df: DataFrame, columns: list[str], others: list[str] = ()
) -> tuple[int, dict[str, int], dict[str, Moments]]:
    """Row count, present counts and moments of every numeric column in one scan.

    Spark merges central moments between tasks, so large values do not cancel.
    """
    exprs = {("rows",): F.count(F.lit(1))}
    exprs |= {(c, "count"): F.count(value(df, c)) for c in others}
    for c in columns:
        x = as_double(df, c)
        exprs |= {
            (c, "count"): F.count(x),
            (c, "mean"): F.avg(x),
            (c, "std"): F.stddev_samp(x),
            (c, "minimum"): F.min(x),
            (c, "maximum"): F.max(x),
            (c, "skewness"): F.skewness(x),
            (c, "kurtosis"): F.kurtosis(x),
        }
        if not isinstance(df.schema[c].dataType, T.IntegralType):
            exprs[(c, "whole")] = F.bool_and(x % 1 == 0)
    # Wider aggregates than this lose whole-stage code generation.
    got = aggregate_once(df, exprs, at_once=36)
    present = {c: got[c, "count"] for c in [*columns, *others]}
    stats = {c: _settle({k: got.get((c, k), True) for k in FIELDS}) for c in columns}
    return got[("rows",)], present, stats


def _settle(stats: dict) -> Moments:
    """Undefined statistics as None, and exact zeros for a constant column."""
    m = Moments(**stats)
    m.whole = bool(m.whole) and m.count > 0
    if m.count == 1:
        m.std = 0.0
    if m.count > 0 and m.minimum == m.maximum:
        m.std, m.skewness, m.kurtosis = 0.0, None, None
    if m.count < 3:
        m.skewness = None
    if m.count < 4:
        m.kurtosis = None
    return m


# Bytes of one cell of each fixed-width type.
_WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def stored_bytes(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Approximate size of every column: fixed widths per row plus the text itself."""
    exprs = {}
    for c in columns:
        dtype = df.schema[c].dataType
        if is_text(dtype) or isinstance(dtype, T.BinaryType):
            size = F.octet_length(col(c))
        elif is_number(dtype) or is_datetime(dtype) or isinstance(dtype, T.BooleanType):
            size = F.lit(_WIDTHS.get(type(dtype), 16))
        else:
            size = F.octet_length(F.to_json(col(c)))
        exprs[c] = F.coalesce(F.sum(size.cast("bigint")), F.lit(0))
    return aggregate_once(df, exprs)
