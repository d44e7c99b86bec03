"""Outlier counts of numeric columns by several rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeprofile.functions.columns import aggregate_once, as_double, col, small_table
from lakeprofile.operators.isolation import SAMPLE, SEED, TREES, isolated_count
from lakeprofile.plans.profile import Profile
from lakeprofile.plans.wording import say

MIN_VALUES = 4
# Makes a deviation in MADs comparable to one in standard deviations.
NORMAL_MAD = 0.6745
SAMPLE_ROWS = 20

SCHEMA = (
    "column string, iqr_count bigint, iqr_pct double, iqr_extreme_count bigint,"
    " iqr_extreme_pct double, zscore_count bigint, zscore_pct double, mzscore_count bigint,"
    " mzscore_pct double, iforest_count bigint, iforest_pct double, notes array<string>"
)


@dataclass(frozen=True)
class Rules:
    iqr_multiplier: float = 1.5
    iqr_extreme_multiplier: float = 3.0
    zscore_threshold: float = 3.0
    mzscore_threshold: float = 3.5
    use_iforest: bool = False
    contamination: str | float = "auto"
    iforest_trees: int = TREES
    iforest_sample: int = SAMPLE
    iforest_seed: int = SEED


def fence(p: Profile, column: str, multiplier: float) -> tuple[float, float]:
    q1, q3 = p.quantiles[column][0.25], p.quantiles[column][0.75]
    return q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)


def beyond(x: Column, limits: tuple[float, float]) -> Column:
    return (x < limits[0]) | (x > limits[1])


def _tests(p: Profile, column: str, rules: Rules) -> dict[str, Column]:
    x, m = as_double(p.df, column), p.moments[column]
    mad, median = p.mad[column], p.quantiles[column][0.5]
    never = F.lit(False)
    return {
        "iqr": beyond(x, fence(p, column, rules.iqr_multiplier)),
        "extreme": beyond(x, fence(p, column, rules.iqr_extreme_multiplier)),
        "z": F.abs((x - m.mean) / m.std) > rules.zscore_threshold if m.std else never,
        "mz": F.abs(NORMAL_MAD * (x - median) / mad) > rules.mzscore_threshold if mad else never,
    }


def outlier_counts(
    source: DataFrame | Profile, rules: Rules = Rules()
) -> dict[str, dict[str, int | None]]:
    """Counts by rule for every numeric column, from one scan once the statistics are known."""
    p = Profile.of(source)
    usable = [c for c in p.numeric if p.moments[c].count >= MIN_VALUES]
    exprs = {(c, k): F.count_if(t) for c in usable for k, t in _tests(p, c, rules).items()}
    got = aggregate_once(p.df, exprs, at_once=80) if exprs else {}
    out: dict[str, dict[str, int | None]] = {}
    for c in p.numeric:
        out[c] = {k: got.get((c, k), 0) for k in ("iqr", "extreme", "z", "mz")}
        out[c]["iforest"] = None
        if rules.use_iforest and c in usable:
            out[c]["iforest"] = isolated_count(
                p.df, as_double(p.df, c), p.moments[c].count, rules.contamination,
                rules.iforest_trees, rules.iforest_sample, rules.iforest_seed,
            )
    return out


def outlier_notes(
    n: int, skew: float | None, mad: float | None, counts: dict[str, int | None]
) -> list[tuple[str, str]]:
    """(code, sentence) of what limits the counts."""
    s, iqr, z, mz = skew or 0.0, counts["iqr"], counts["z"], counts["mz"]
    found: dict[str, dict] = {}
    if n >= 20:
        if abs(s) > 1.5:
            found["z_on_skew"] = {"skew": s}
        if mz > 0 and z > 3 * mz:
            found["z_above_mz"] = {"z": z, "mz": mz}
        elif mz > 0 and z == 0:
            found["mz_only"] = {"mz": mz}
    if iqr > 0 and abs(s) > 2.0:
        found["iqr_on_skew"] = {"skew": s, "iqr": iqr}
    if mad == 0.0:
        found["mad_zero"] = {}
    return [(code, say(code, **numbers)) for code, numbers in found.items()]


def column_notes(p: Profile, counts: dict[str, dict]) -> list[tuple[str, str, str]]:
    return [
        (c, code, text)
        for c in p.numeric if p.moments[c].count >= MIN_VALUES
        for code, text in outlier_notes(
            p.moments[c].count, p.moments[c].skewness, p.mad[c], counts[c]
        )
    ]


def outliers(source: DataFrame | Profile, rules: Rules = Rules()) -> DataFrame:
    """One row per numeric column; columns with fewer than four values count nothing."""
    p = Profile.of(source)
    counts = outlier_counts(p, rules)
    notes = column_notes(p, counts)
    rows = []
    for c in p.numeric:
        n, k = p.moments[c].count, counts[c]
        row = [c]
        for name in ("iqr", "extreme", "z", "mz", "iforest"):
            row += [k[name], None if k[name] is None else (k[name] / n if n else 0.0)]
        rows.append((*row, [t for name, _, t in notes if name == c]))
    return small_table(p.spark, rows, SCHEMA)


def outlier_note_table(source: DataFrame | Profile, rules: Rules = Rules()) -> DataFrame:
    p = Profile.of(source)
    rows = column_notes(p, outlier_counts(p, rules))
    return small_table(p.spark, rows, "column string, code string, note string")


def outlier_rows(
    source: DataFrame | Profile, row_id: str, rules: Rules = Rules(), keep: int = SAMPLE_ROWS
) -> DataFrame:
    """The first rows, by ``row_id``, that each column's fence flags."""
    p = Profile.of(source)
    usable = [c for c in p.numeric if p.moments[c].count >= MIN_VALUES and c != row_id]
    schema = "column string, row_id bigint, value double, rank bigint"
    if not usable:
        return small_table(p.spark, [], schema)
    cells = [
        F.when(
            beyond(as_double(p.df, c), fence(p, c, rules.iqr_multiplier)),
            F.struct(F.lit(c).alias("column"), as_double(p.df, c).alias("value")),
        )
        for c in usable
    ]
    flagged = p.df.select(
        col(row_id).alias("row_id"), F.explode(F.array_compact(F.array(*cells))).alias("cell")
    ).select("cell.column", "row_id", "cell.value")
    # Spark keeps the first rows of every task before the exchange, so a column's outliers are
    # never gathered.
    order = Window.partitionBy("column").orderBy("row_id", "value")
    ranked = flagged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))
