"""Tables that feed charts: bins, bars and flags instead of raw rows wherever possible."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.functions.columns import (
    aggregate_once, as_double, as_text, col, numeric_columns, small_table,
)
from lakeprofile.operators.distinct import few_values
from lakeprofile.operators.groups import class_quantiles
from lakeprofile.operators.histogram import edge_table, histogram_counts, linear_edges, with_bins
from lakeprofile.plans import correlation, missing, outlier, target as targets
from lakeprofile.plans.drift import Drift, category_counts
from lakeprofile.plans.profile import Profile

BINS = 30
OVERLAY_BINS = 25
OVERLAY_CATEGORIES = 15
FEATURES = 5
GRID = 30


def bin_numbers(p: Profile, columns: list[str], bins: int = BINS) -> dict[str, int]:
    """Bins per column: no more than it has values."""
    usable = [
        c for c in columns
        if p.moments[c].count and math.isfinite(p.moments[c].maximum - p.moments[c].minimum)
    ]
    found = few_values(p.df, {c: as_double(p.df, c) for c in usable}, bins)
    return {c: bins if v is None else len(v) for c, v in found.items()}


def histograms(source: DataFrame | Profile, bins: int = BINS) -> DataFrame:
    """Equal-width bins of every numeric column, empty ones included."""
    p = Profile.of(source)
    edges = {
        c: linear_edges(p.moments[c].minimum, p.moments[c].maximum, n)
        for c, n in bin_numbers(p, p.numeric, bins).items()
    }
    return _filled(p.df, edges, histogram_counts(
        p.df, {c: (as_double(p.df, c), e) for c, e in edges.items()}
    ), ["count"])


def _filled(
    df: DataFrame, edges: dict[str, list[float]], counts: DataFrame, names: list[str]
) -> DataFrame:
    full = edge_table(df, edges).join(counts, ["column", "bin"], "left")
    return full.select(
        "column", "bin", "low", "high", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


def box_stats(source: DataFrame | Profile) -> DataFrame:
    p = Profile.of(source)
    rows = [
        (c, m.minimum, p.quantiles[c][0.25], p.quantiles[c][0.5], p.quantiles[c][0.75], m.maximum,
         m.mean)
        for c, m in p.moments.items()
    ]
    return small_table(
        p.spark, rows,
        "column string, min double, p25 double, p50 double, p75 double, max double, mean double",
    )


def value_bars(source: DataFrame | Profile) -> DataFrame:
    """Top values of the non-numeric columns with their percentage."""
    p = Profile.of(source)
    rows = [
        (c, v, n, round(100 * n / p.present[c], 2))
        for c, f in p.frequencies_of(p.categorical).items() for v, n in f.top
    ]
    return small_table(p.spark, rows, "column string, value string, count bigint, pct double")


def heatmap(source: DataFrame | Profile, method: str = "pearson") -> DataFrame:
    """(row, col, value) of the Pearson, Spearman or Cramér matrix."""
    build = {
        "pearson": correlation.pearson_matrix, "spearman": correlation.spearman_matrix,
        "cramers_v": correlation.cramers_matrix,
    }
    return build[method](source)


def missing_bars(source: DataFrame | Profile) -> DataFrame:
    """Columns with gaps and their percentage of missing cells."""
    p = Profile.of(source)
    rows = [(c, round(100 * p.missing_share(c), 2), p.missing(c)) for c in p.gappy]
    return small_table(p.spark, rows, "column string, missing_pct double, missing_count bigint")


def outlier_bars(source: DataFrame | Profile) -> DataFrame:
    p = Profile.of(source)
    counts = outlier.outlier_counts(p)
    rows = [(c, k["iqr"], k["extreme"], k["z"], k["mz"]) for c, k in counts.items()]
    return small_table(
        p.spark, rows,
        "column string, iqr bigint, iqr_extreme bigint, z_score bigint, modified_z bigint",
    )


def outlier_points(source: DataFrame | Profile, row_id: str) -> DataFrame:
    """Every numeric cell with its column's fence and whether it lies beyond, distributed."""
    p = Profile.of(source)
    usable = [c for c in p.numeric if c != row_id and p.moments[c].count >= outlier.MIN_VALUES]
    cells = []
    for c in usable:
        low, high = outlier.fence(p, c, outlier.Rules().iqr_multiplier)
        x = as_double(p.df, c)
        cells.append(F.when(x.isNotNull(), F.struct(
            F.lit(c).alias("column"), x.alias("value"), F.lit(low).alias("low"),
            F.lit(high).alias("high"), outlier.beyond(x, (low, high)).alias("is_outlier"),
        )))
    points = p.df.select(
        col(row_id).alias("row_id"), F.explode(F.array_compact(F.array(*cells))).alias("cell")
    )
    return points.select("row_id", "cell.*")


def drift_overlay(drift: Drift, drifted_only: bool = True, bins: int = OVERLAY_BINS) -> DataFrame:
    """Counts of both sides over shared bins for the numeric columns (by default drifted ones)."""
    columns = drift.numeric
    if drifted_only:
        columns = [c for c in columns if drift.columns()[c].drift_detected]
    both = _tagged(drift, columns)
    limits = _ranges(both, columns)
    edges = {c: linear_edges(*limits[c], bins) for c in columns if limits[c][0] is not None}
    counts = histogram_counts(
        both, {c: (col(c), e) for c, e in edges.items()},
        {"reference": F.col("_side"), "current": 1 - F.col("_side")},
    )
    return _filled(both, edges, counts, ["reference", "current"])


def _tagged(drift: Drift, columns: list[str]) -> DataFrame:
    """The columns of both tables as doubles, _side being 1 on the reference side."""
    parts = [
        df.select(*[as_double(df, c).alias(c) for c in columns], F.lit(side).alias("_side"))
        for df, side in ((drift.reference, 1), (drift.current, 0))
    ]
    return parts[0].unionByName(parts[1])


def _ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    got = aggregate_once(
        df, {(c, k): f(col(c)) for c in columns for k, f in (("lo", F.min), ("hi", F.max))}
    ) if columns else {}
    return {c: (got[c, "lo"], got[c, "hi"]) for c in columns}


def density_overlay(drift: Drift, drifted_only: bool = True, bins: int = BINS) -> DataFrame:
    """Density histograms of each side over its own range."""
    columns = drift.numeric
    if drifted_only:
        columns = [c for c in columns if drift.columns()[c].drift_detected]
    out = None
    for df, side in ((drift.reference, "reference"), (drift.current, "current")):
        x = df.select(*[as_double(df, c).alias(c) for c in columns])
        limits = _ranges(x, columns)
        edges = {c: linear_edges(*limits[c], bins) for c in columns if limits[c][0] is not None}
        filled = _filled(
            x, edges, histogram_counts(x, {c: (col(c), e) for c, e in edges.items()}), ["count"]
        )
        total = F.col("total")
        totals = filled.groupBy("column").agg(F.sum("count").alias("total"))
        part = filled.join(F.broadcast(totals), "column").select(  # one row per column
            F.lit(side).alias("side"), "column", "bin", "low", "high",
            (F.col("count") / total / (F.col("high") - F.col("low"))).alias("density"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def category_overlay(
    drift: Drift, column: str, keep: int = OVERLAY_CATEGORIES
) -> DataFrame:
    """Shares of both sides for the first categories in order."""
    counts = category_counts(drift.reference, drift.current, [column], whole=True)
    totals = counts.groupBy("c").agg(F.sum("ref").alias("all_ref"), F.sum("cur").alias("all_cur"))
    first = counts.orderBy("key").limit(keep)
    return first.join(F.broadcast(totals), "c").select(  # a single row
        F.col("key").alias("category"),
        F.try_divide(F.col("ref"), F.col("all_ref")).alias("reference"),
        F.try_divide(F.col("cur"), F.col("all_cur")).alias("current"),
    )


def top_numeric_features(p: Profile, target: str, keep: int | None = FEATURES) -> list[str]:
    """Numeric ones among the ``keep`` strongest features, or among all."""
    numbers = set(numeric_columns(p.df, with_bool=True))
    best = targets.associations(p, target)[:keep]
    return [a.feature for a in best if a.feature in numbers]


def class_boxes(
    source: DataFrame | Profile, target: str, features: int | None = FEATURES
) -> DataFrame:
    """Box statistics of the strongest numeric features for every target class."""
    p = Profile.of(source)
    features = top_numeric_features(p, target, features)
    key = as_text(p.df, target)
    x = {c: as_double(p.df, c) for c in features}
    points = class_quantiles(p.df, key, x, [0.0, 0.25, 0.5, 0.75, 1.0], p.rows)
    boxes = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"q{k}").alias("q")) for k, c in enumerate(x)
    ])
    long = points.toDF("class", *[f"q{k}" for k in range(len(x))])
    long = long.select("class", F.explode(boxes).alias("box")).where("box.q is not null")
    names = ["min", "p25", "p50", "p75", "max"]
    return long.select(
        "class", "box.feature", *[F.col("box.q")[k].alias(n) for k, n in enumerate(names)]
    )


def class_histograms(
    source: DataFrame | Profile, target: str, bins: int = BINS, features: int | None = FEATURES
) -> DataFrame:
    """Counts per class over shared bins of the strongest numeric features."""
    p = Profile.of(source)
    features = top_numeric_features(p, target, features)
    x = p.df.select(
        as_text(p.df, target).alias("_class"), *[as_double(p.df, c).alias(c) for c in features]
    ).where("_class is not null")
    limits = _ranges(x, features)
    edges = {c: linear_edges(*limits[c], bins) for c in features if limits[c][0] is not None}
    counts = histogram_counts(
        x, {c: (col(c), e) for c, e in edges.items()}, keys=[F.col("_class")]
    )
    bounds = F.broadcast(edge_table(p.df, edges))  # a few bins per feature
    return counts.join(bounds, ["column", "bin"]).select(
        F.col("key0").alias("class"), F.col("column").alias("feature"), "bin", "low", "high", "count"
    )


def target_grid(
    source: DataFrame | Profile, target: str, cells: int = GRID, features: int | None = FEATURES
) -> DataFrame:
    """Complete (feature, target) pairs of a numeric target counted on a grid.

    Stands in for a scatter plot of raw rows; features with fewer than five pairs are left out.
    """
    p = Profile.of(source)
    y = as_double(p.df, target)
    out = None
    for c in top_numeric_features(p, target, features):
        pairs = p.df.select(as_double(p.df, c).alias("x"), y.alias("y")).dropna()
        limits = _ranges(pairs, ["x", "y"])
        if limits["x"][0] is None or pairs.limit(targets.MIN_PAIRS).count() < targets.MIN_PAIRS:
            continue
        ex, ey = linear_edges(*limits["x"], cells), linear_edges(*limits["y"], cells)
        part = grid_counts(pairs, ex, ey).select(
            F.lit(c).alias("feature"), "x_bin", "y_bin", "x_low", "y_low", "count"
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        return small_table(
            p.spark, [], "feature string, x_bin bigint, y_bin bigint, x_low double, y_low double,"
            " count bigint",
        )
    return out


def grid_counts(pairs: DataFrame, x_edges: list[float], y_edges: list[float]) -> DataFrame:
    binned = with_bins(pairs, {"x": x_edges, "y": y_edges})
    counts = (
        binned.select(F.col("b_x").alias("x_bin"), F.col("b_y").alias("y_bin"))
        .groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count"))
    )
    x_low, y_low = (F.array(*[F.lit(e) for e in edges]) for edges in (x_edges, y_edges))
    return counts.select(
        "x_bin", "y_bin", F.get(x_low, F.col("x_bin").cast("int")).alias("x_low"),
        F.get(y_low, F.col("y_bin").cast("int")).alias("y_low"), "count",
    )


# Report orderings

PAIRS_SHOWN = 20
JOINT_PAIRS_SHOWN = 10


def shown_strong_pairs(source: DataFrame | Profile, keep: int | None = PAIRS_SHOWN) -> DataFrame:
    """The ``keep`` strongest pairs, or all."""
    pairs = correlation.strong_pairs(source).orderBy(F.desc(F.abs("r")))
    return pairs if keep is None else pairs.limit(keep)


def shown_joint_missing(
    source: DataFrame | Profile, keep: int | None = JOINT_PAIRS_SHOWN
) -> DataFrame:
    """The ``keep`` pairs most often missing together, or all."""
    pairs = missing.correlated_missing(source).orderBy(F.desc("p_both"))
    return pairs if keep is None else pairs.limit(keep)


def shown_missing(source: DataFrame | Profile) -> DataFrame:
    """Columns with gaps, the emptiest first."""
    p = Profile.of(source)
    rows = sorted(((c, p.missing(c), p.missing_share(c)) for c in p.gappy), key=lambda t: -t[1])
    return small_table(
        p.spark, [(k, *r) for k, r in enumerate(rows, start=1)],
        "rank bigint, column string, missing_count bigint, missing_pct double",
    )

