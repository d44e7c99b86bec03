"""Exact two-sample Kolmogorov-Smirnov distance from cumulative counts of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeprofile.functions.columns import as_double
from lakeprofile.operators.groups import class_cells
from lakeprofile.operators.quantiles import group_number
from lakeprofile.operators.ranks import BUCKET_ROWS, range_limits


def ks_distances(
    reference: DataFrame,
    current: DataFrame,
    columns: list[str],
    ref_rows: dict[str, int],
    cur_rows: dict[str, int],
    bucket_rows: int = BUCKET_ROWS,
) -> dict[str, float]:
    """Largest gap between the two empirical distribution functions of each column.

    Both sides are merged by value inside the scan, so a hot value is one row.  Running sums are taken inside value
    ranges and shifted by the totals of the ranges before; all columns share the sketch that sets
    the ranges and one job, whatever the data.
    """
    if not columns:
        return {}
    names = [str(k) for k in range(len(columns))]
    sides = [
        # 0.0 and -0.0 are the same value.
        df.select(F.lit(r).alias("r"), *[(as_double(df, c) + 0.0).alias(k) for c, k in zip(columns, names)])
        for df, r in ((reference, 1), (current, 0))
    ]
    both = sides[0].unionByName(sides[1])
    rows = max(ref_rows[c] + cur_rows[c] for c in columns)
    limits = range_limits(both, names, rows, bucket_rows)
    cells = class_cells(both.select(F.col("r").alias("key"), *names), limits).where("c >= 0")
    counts = cells.groupBy("c", "b", "x").agg(
        F.sum(F.when(F.col("key") == 1, F.col("n")).otherwise(0)).alias("ref"),
        F.sum(F.when(F.col("key") == 0, F.col("n")).otherwise(0)).alias("cur"),
    )
    upto = Window.partitionBy("c", "b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.select("c", "b", *[F.sum(s).over(upto).alias(s) for s in ("ref", "cur")])
    # One row per column and range.
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("c", "b").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    shifts = totals.select(
        group_number("c"), "b",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in ("ref", "cur")],
    )
    sizes = [F.array(*[F.lit(n[c]) for c in columns])[F.col("c")] for n in (ref_rows, cur_rows)]
    gap = F.abs(
        (F.col("ref") + F.col("ref_before")) / sizes[0] - (F.col("cur") + F.col("cur_before")) / sizes[1]
    )
    found = running.join(shifts, ["c", "b"]).groupBy("c").agg(F.max(gap).alias("d")).collect()
    out = dict.fromkeys(columns, 0.0)
    return out | {columns[r["c"]]: r["d"] for r in found}
