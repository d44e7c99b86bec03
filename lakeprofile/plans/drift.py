"""Statistical drift between a reference and a current table."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeprofile.functions.columns import (
    aggregate_once, as_double, as_text, fold, is_number, small_table, together,
)
from lakeprofile.functions.pvalues import chi2_tail, ks_two_sample
from lakeprofile.operators.ks import ks_distances
from lakeprofile.operators.moments import present_counts
from lakeprofile.operators.quantiles import WINDOW_VALUES, exact_quantiles, group_number
from lakeprofile.sources.load import drop_columns, load_table
from lakeprofile.sources.sink import write_sections

MODERATE_PSI = 0.1
DEFAULT_THRESHOLD = 0.2
MIN_VALUES = 5
PSI_BINS = 10
SHARE_FLOOR = 1e-6
COUNT_FLOOR = 1e-6
SIGNIFICANT = 0.05

SCHEMA = (
    "column string, col_type string, mean_ref double, mean_cur double, mean_shift_pct double,"
    " std_ref double, std_cur double, ks_statistic double, ks_pvalue double, psi double,"
    " chi2_statistic double, chi2_pvalue double, drift_detected boolean, drift_severity string"
)


@dataclass
class ColumnDrift:
    column: str
    col_type: str
    mean_ref: float | None = None
    mean_cur: float | None = None
    mean_shift_pct: float | None = None
    std_ref: float | None = None
    std_cur: float | None = None
    ks_statistic: float | None = None
    ks_pvalue: float | None = None
    psi: float | None = None
    chi2_statistic: float | None = None
    chi2_pvalue: float | None = None
    drift_detected: bool = False
    drift_severity: str = "none"


@dataclass
class _Side:
    count: int
    mean: float | None
    std: float | None
    low: float | None
    high: float | None


class Drift:
    """Comparison of two tables; every statistic is computed on first use."""

    def __init__(
        self,
        reference: DataFrame,
        current: DataFrame,
        psi_threshold: float = DEFAULT_THRESHOLD,
        open_ended: bool = False,
        window_values: int = WINDOW_VALUES,
    ):
        self.reference, self.current = reference, current
        self.spark = reference.sparkSession
        self.threshold = psi_threshold
        self.open_ended = open_ended
        self.window_values = window_values
        both = set(reference.columns) & set(current.columns)
        self.shared = sorted(both)
        self.missing = sorted(set(reference.columns) - both)
        self.new = sorted(set(current.columns) - both)
        self.numeric = [c for c in self.shared if self._number(c)]
        self.mismatched = [
            c for c in self.numeric if not _is_numeric(current.schema[c].dataType)
        ]
        self.numeric = [c for c in self.numeric if c not in self.mismatched]
        self.categorical = [c for c in self.shared if not self._number(c)]
        self._columns: dict[str, ColumnDrift] | None = None
        self._rows: tuple[int, int] | None = None

    def _number(self, column: str) -> bool:
        return _is_numeric(self.reference.schema[column].dataType)

    def columns(self) -> dict[str, ColumnDrift]:
        """Drift of every shared column, in name order."""
        if self._columns is None:
            numbers, categories = together(self._numeric_drift, self._categorical_drift)
            got = numbers | categories
            got |= {c: ColumnDrift(c, "type_mismatch") for c in self.mismatched}
            self._columns = {c: got[c] for c in self.shared}
        return self._columns

    def rows(self) -> tuple[int, int]:
        if self._rows is None:
            self._rows = (self.reference.count(), self.current.count())
        return self._rows

    # Numeric columns

    def _sides(self) -> tuple[dict[str, _Side], dict[str, _Side]]:
        return tuple(together(
            lambda: _moments(self.reference, self.numeric),
            lambda: _moments(self.current, self.numeric),
        ))

    def _numeric_drift(self) -> dict[str, ColumnDrift]:
        out = {c: ColumnDrift(c, "numeric") for c in self.numeric}
        if not self.numeric:
            return out
        ref, cur = self._sides()
        usable = [
            c for c in self.numeric if min(ref[c].count, cur[c].count) >= MIN_VALUES
        ]
        psi, distance = together(
            lambda: self._psi(usable, ref),
            lambda: ks_distances(
                self.reference, self.current, usable, {c: ref[c].count for c in usable},
                {c: cur[c].count for c in usable},
            ),
        )
        for c in usable:
            a, b = ref[c], cur[c]
            severity = severity_of(psi[c], self.threshold)
            out[c] = ColumnDrift(
                c, "numeric", a.mean, b.mean,
                abs(a.mean - b.mean) / abs(a.mean) * 100 if a.mean != 0 else None,
                a.std, b.std, distance[c], ks_two_sample(distance[c], a.count, b.count), psi[c],
                drift_detected=severity != "none", drift_severity=severity,
            )
        return out

    def _psi(self, columns: list[str], ref: dict[str, _Side]) -> dict[str, float]:
        deciles = exact_quantiles(
            self.reference, {c: as_double(self.reference, c) for c in columns},
            [k / PSI_BINS for k in range(PSI_BINS + 1)], {c: ref[c].count for c in columns},
            {c: (ref[c].low, ref[c].high) for c in columns}, self.window_values,
        )
        edges = {c: sorted(set(v)) for c, v in deciles.items()}
        for c in columns:
            if self.open_ended and len(edges[c]) > 1:
                edges[c][0], edges[c][-1] = -math.inf, math.inf
        edges = {c: e for c, e in edges.items() if len(e) > 1}
        counts = together(
            lambda: bin_counts(self.reference, edges), lambda: bin_counts(self.current, edges)
        )
        return {
            c: psi_of(counts[0][c], counts[1][c]) if c in edges else 0.0 for c in columns
        }

    # Categorical columns

    def _categorical_drift(self) -> dict[str, ColumnDrift]:
        out = {c: ColumnDrift(c, "categorical") for c in self.categorical}
        if not self.categorical:
            return out
        for r in self.chi_square().collect():
            c = self.categorical[r["c"]]
            if min(r["ref"], r["cur"]) < MIN_VALUES:
                continue
            pvalue = chi2_tail(r["chi2"], r["categories"] - 1)
            drifted = pvalue < SIGNIFICANT
            out[c] = ColumnDrift(
                c, "categorical", chi2_statistic=r["chi2"], chi2_pvalue=pvalue,
                drift_detected=drifted, drift_severity="high" if drifted else "none",
            )
        return out

    def chi_square(self) -> DataFrame:
        """(c, categories, ref, cur, chi2) of the shared non-numeric columns.

        Category counts of both sides come from one shuffle after partial counting; the totals are
        one row per column.
        """
        counts = category_counts(self.reference, self.current, self.categorical)
        a, b = F.col("ref") + COUNT_FLOOR, F.col("cur") + COUNT_FLOOR
        totals = counts.groupBy("c").agg(
            F.sum(a).alias("sum_a"), F.sum(b).alias("sum_b"),
            F.count(F.lit(1)).alias("categories"),
        )
        joined = counts.join(F.broadcast(totals), "c")  # one row per column
        n = F.col("sum_a") + F.col("sum_b")
        terms = F.lit(0.0)
        for observed, side in ((a, "sum_a"), (b, "sum_b")):
            expected = (a + b) * F.col(side) / n
            off = F.abs(observed - expected)
            # Yates' correction applies to one degree of freedom, that is two categories.
            off = F.when(F.col("categories") == 2, off - F.least(F.lit(0.5), off)).otherwise(off)
            terms = terms + off * off / expected
        return joined.groupBy("c").agg(
            F.count(F.lit(1)).alias("categories"), F.sum("ref").alias("ref"),
            F.sum("cur").alias("cur"), F.sum(terms).alias("chi2"),
        )

    # Results

    def table(self) -> DataFrame:
        """One row per shared column."""
        names = [f.strip().split()[0] for f in SCHEMA.split(",")]
        rows = [tuple(getattr(d, n) for n in names) for d in self.columns().values()]
        return small_table(self.spark, rows, SCHEMA)

    def ranked(self) -> DataFrame:
        """Report order: PSI from high to low, without one last, then by name."""
        order = sorted(self.columns().values(), key=lambda d: -(d.psi or 0.0))
        rows = [(k, d.column, d.psi, d.drift_severity) for k, d in enumerate(order, start=1)]
        return small_table(
            self.spark, rows, "rank bigint, column string, psi double, drift_severity string"
        )

    def summary(self) -> DataFrame:
        """One row: drifted columns, their share, the verdict and both shapes."""
        found = self.columns().values()
        drifted = [d.column for d in found if d.drift_detected]
        share = len(drifted) / len(found) if found else 0.0
        ref, cur = self.rows()
        row = (
            drifted, len(drifted), len(found), share, bool(drifted), ref,
            len(self.reference.columns), cur, len(self.current.columns), self.missing, self.new,
            self.threshold,
        )
        return small_table(
            self.spark, [row],
            "drifted_columns array<string>, drifted_count bigint, total_columns bigint,"
            " drift_fraction double, overall_drift boolean, ref_rows bigint, ref_columns bigint,"
            " cur_rows bigint, cur_columns bigint, missing_in_current array<string>,"
            " new_in_current array<string>, psi_threshold double",
        )

    def column_changes(self) -> DataFrame:
        """Columns on one side only, with the present cells and rows they have there."""
        rows = []
        for df, names, change in (
            (self.reference, self.missing, "missing_in_current"),
            (self.current, self.new, "new_in_current"),
        ):
            total, present = present_counts(df, names) if names else (0, {})
            rows += [(c, change, present[c], total) for c in names]
        return small_table(
            self.spark, rows, "column string, change string, present bigint, rows bigint"
        )


def compare(
    reference: DataFrame, current: DataFrame, psi_threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    return Drift(reference, current, psi_threshold).table()


def compare_paths(
    spark: SparkSession, reference: str, current: str, output: str | None = None,
    psi_threshold: float = DEFAULT_THRESHOLD, drop: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Two files, folders or patterns compared: the column table, its order, the summary and the
    columns on one side only, each saying what was compared; written below ``output`` if given."""
    d = Drift(*[drop_columns(load_table(spark, p), drop or []) for p in (reference, current)], psi_threshold)
    sides = [F.lit(reference).alias("reference"), F.lit(current).alias("current")]
    out = {
        name: df.select(*sides, "*")
        for name, df in (("drift", d.table()), ("ranked", d.ranked()), ("summary", d.summary()),
                         ("column_changes", d.column_changes()))
    }
    if output:
        write_sections(out, output)
    return out


def _is_numeric(dtype: T.DataType) -> bool:
    return is_number(dtype) or isinstance(dtype, T.BooleanType)


def _moments(df: DataFrame, columns: list[str]) -> dict[str, _Side]:
    exprs = {}
    for c in columns:
        x = as_double(df, c)
        exprs |= {(c, "count"): F.count(x), (c, "mean"): F.avg(x), (c, "std"): F.stddev_samp(x),
                  (c, "low"): F.min(x), (c, "high"): F.max(x)}
    got = aggregate_once(df, exprs, at_once=50)
    return {c: _Side(*[got[c, k] for k in ("count", "mean", "std", "low", "high")]) for c in columns}


def severity_of(psi: float, threshold: float) -> str:
    if psi < MODERATE_PSI:
        return "none"
    return "moderate" if psi < threshold else "high"


def _in_bin(x: Column, edges: list[float], k: int) -> Column:
    upper = x <= edges[k + 1] if k == len(edges) - 2 else x < edges[k + 1]
    return (x >= edges[k]) & upper


def bin_counts(df: DataFrame, edges: dict[str, list[float]]) -> dict[str, list[int]]:
    """Rows per bin; bins are closed on the left, the last one on both sides, values outside drop.

    Plain conditional counts, so there is nothing to shuffle.
    """
    exprs = {
        (c, k): F.count_if(_in_bin(as_double(df, c), e, k))
        for c, e in edges.items()
        for k in range(len(e) - 1)
    }
    got = aggregate_once(df, exprs, at_once=80) if exprs else {}
    return {c: [got[c, k] for k in range(len(e) - 1)] for c, e in edges.items()}


def psi_of(ref: list[int], cur: list[int]) -> float:
    if sum(ref) == 0 or sum(cur) == 0:
        return 0.0
    total = 0.0
    for r, c in zip(ref, cur, strict=True):
        a, b = max(r / sum(ref), SHARE_FLOOR), max(c / sum(cur), SHARE_FLOOR)
        total += (b - a) * math.log(b / a)
    return max(0.0, total)


def category_counts(
    reference: DataFrame, current: DataFrame, columns: list[str], whole: bool = False
) -> DataFrame:
    """(c, key, ref, cur): rows of both sides per category.

    Long text is keyed by its digest unless it is wanted ``whole``.
    """
    key = (lambda text: text) if whole else fold

    def melted(df: DataFrame, is_ref: int) -> DataFrame:
        keys = df.select(*[key(as_text(df, c)).alias(str(k)) for k, c in enumerate(columns)])
        return (
            keys.unpivot([], keys.columns, "c", "key")
            .where("key is not null")
            .select(group_number("c"), "key", F.lit(is_ref).alias("r"))
        )

    both = melted(reference, 1).unionAll(melted(current, 0))
    return both.groupBy("c", "key").agg(
        F.sum("r").alias("ref"), F.sum(1 - F.col("r")).alias("cur")
    )

