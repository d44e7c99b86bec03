"""Where and how values are missing."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.functions.columns import aggregate_once, present, small_table
from lakeprofile.plans.profile import Profile

MAX_PATTERNS = 10
JOINT_SHARE = 0.5


def missing_columns(source: DataFrame | Profile) -> DataFrame:
    """Missing and present cells of every column."""
    p = Profile.of(source)
    return small_table(
        p.spark,
        [(c, p.missing(c), p.missing_share(c), p.present[c]) for c in p.columns],
        "column string, missing_count bigint, missing_pct double, present_count bigint",
    )


def missing_summary(source: DataFrame | Profile) -> DataFrame:
    """One row: cells, missing cells and rows without any gap."""
    p = Profile.of(source)
    cells = p.rows * len(p.columns)
    gaps = sum(p.missing(c) for c in p.columns)
    complete = p.rows
    if p.gappy:
        full = F.lit(True)
        for c in p.gappy:
            full &= present(p.df, c)
        complete = aggregate_once(p.df, {"n": F.count_if(full)})["n"]
    return small_table(
        p.spark,
        [(cells, gaps, gaps / cells if cells else 0.0, complete,
          complete / p.rows if p.rows else 0.0)],
        "total_cells bigint, total_missing bigint, global_missing_pct double,"
        " complete_rows bigint, complete_rows_pct double",
    )


def missing_patterns(
    source: DataFrame | Profile, keep: int | None = MAX_PATTERNS
) -> DataFrame:
    """Sets of columns missing together, among the ``keep`` most frequent row patterns, or all.

    The complete pattern takes part in the ranking and is dropped afterwards.
    """
    p = Profile.of(source)
    if not p.gappy:
        return small_table(
            p.spark, [], "missing array<string>, row_count bigint, row_pct double"
        )
    gaps = F.array_compact(
        F.array(*[F.when(~present(p.df, c), F.lit(c)) for c in sorted(p.gappy)])
    )
    patterns = (
        p.df.select(gaps.alias("missing"))
        .groupBy("missing")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.desc("row_count"), "missing")
    )
    if keep is not None:
        patterns = patterns.limit(keep)
    return (
        patterns.where(F.size("missing") > 0)
        .withColumn("row_pct", F.col("row_count") / F.lit(float(p.rows)))
    )


def joint_missing(p: Profile, threshold: float = JOINT_SHARE) -> list[tuple[str, str, float]]:
    """Pairs of columns missing in the same row in at least this share of all rows."""
    # Both missing implies each missing, so thinner columns cannot reach the threshold.
    often = [c for c in p.gappy if p.missing_share(c) >= threshold]
    pairs = list(combinations(often, 2))
    if not pairs:
        return []
    both = aggregate_once(
        p.df, {(a, b): F.count_if(~present(p.df, a) & ~present(p.df, b)) for a, b in pairs}
    )
    found = [(a, b, both[a, b] / p.rows) for a, b in pairs if both[a, b] / p.rows >= threshold]
    return sorted(found, key=lambda t: -t[2])


def correlated_missing(source: DataFrame | Profile, threshold: float = JOINT_SHARE) -> DataFrame:
    p = Profile.of(source)
    return small_table(
        p.spark, joint_missing(p, threshold), "col_a string, col_b string, p_both double"
    )
