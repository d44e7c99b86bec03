"""Association between the columns of one table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.functions.columns import as_double, as_text, small_table
from lakeprofile.functions.pvalues import correlation_pvalue
from lakeprofile.operators.contingency import cramers_v
from lakeprofile.operators.correlate import Pair, pair_correlations
from lakeprofile.plans.profile import Profile
from lakeprofile.plans.wording import say

STRONG = 0.7
MATRIX = "row string, col string, value double"


def _matrix(p: Profile, columns: list[str], upper: dict[Pair, float | None], diagonal) -> DataFrame:
    rows = []
    for a in columns:
        for b in columns:
            if a == b:
                rows.append((a, b, diagonal(a)))
            else:
                rows.append((a, b, upper[a, b] if (a, b) in upper else upper[b, a]))
    return small_table(p.spark, rows, MATRIX)


def _varies(p: Profile, column: str) -> float | None:
    m = p.moments[column]
    return 1.0 if m.count > 1 and m.minimum != m.maximum else None


def pearson_matrix(source: DataFrame | Profile) -> DataFrame:
    """Long Pearson matrix over pairwise complete rows; empty below two numeric columns."""
    p = Profile.of(source)
    if len(p.numeric) < 2:
        return small_table(p.spark, [], MATRIX)
    return _matrix(p, p.numeric, p.pearson, lambda c: _varies(p, c))


def spearman_matrix(source: DataFrame | Profile) -> DataFrame:
    """Long Spearman matrix, every pair ranked over its own complete rows."""
    p = Profile.of(source)
    if len(p.numeric) < 2:
        return small_table(p.spark, [], MATRIX)
    return _matrix(p, p.numeric, p.spearman, lambda c: _varies(p, c))


def strong_list(p: Profile, threshold: float = STRONG) -> list[tuple[str, str, float, str]]:
    out = [
        (a, b, r, "strong positive" if r > 0 else "strong negative")
        for (a, b), r in p.pearson.items()
        if r is not None and abs(r) >= threshold
    ]
    return sorted(out, key=lambda t: -abs(t[2]))


def strong_pairs(source: DataFrame | Profile, threshold: float = STRONG) -> DataFrame:
    p = Profile.of(source)
    return small_table(
        p.spark, strong_list(p, threshold), "col_a string, col_b string, r double, label string"
    )


def cramers_matrix(source: DataFrame | Profile) -> DataFrame:
    """Long Cramér's V matrix of the non-numeric columns, without continuity correction."""
    p = Profile.of(source)
    if len(p.categorical) < 2:
        return small_table(p.spark, [], MATRIX)
    unique = {c: f.unique for c, f in p.frequencies_of(p.categorical).items()}
    v = cramers_v(p.df, list(combinations(p.categorical, 2)), unique)
    return _matrix(p, p.categorical, v, lambda c: 1.0)


def encode(p: Profile, column: str, values: tuple[str, str]):
    """A two-valued column as 0 and 1, the lower value being 0."""
    text = as_text(p.df, column)
    return F.when(text == values[0], 0.0).when(text == values[1], 1.0)


def biserial_list(p: Profile) -> list[tuple[str, str, float | None, float | None, int]]:
    binary = p.binary_columns(p.categorical)
    x = {("num", c): as_double(p.df, c) for c in p.numeric}
    x |= {("bin", c): encode(p, c, v) for c, v in binary.items()}
    pairs = [(("num", n), ("bin", b)) for b in binary for n in p.numeric if p.moments[n].count]
    gappy = {(kind, c) for kind, c in x if p.present[c] < p.rows}
    centre = {k: 0.5 if k[0] == "bin" else p.centre(k[1]) for k in x}
    got = pair_correlations(p.df, x, centre, gappy, pairs)
    rows = [
        (n, b, r, correlation_pvalue(r, count), count)
        for ((_, n), (_, b)), (count, r) in got.items()
        if count >= 5
    ]
    return sorted(rows, key=lambda t: -abs(t[2] or 0.0))


def point_biserial(source: DataFrame | Profile) -> DataFrame:
    """Correlation of every numeric with every two-valued column; the lower value counts as 0."""
    p = Profile.of(source)
    return small_table(
        p.spark, biserial_list(p),
        "num_col string, bin_col string, r double, pvalue double, pairs bigint",
    )


def vif(source: DataFrame | Profile) -> DataFrame:
    p = Profile.of(source)
    rows = sorted((p.vif or {}).items(), key=lambda t: -(t[1] or 0.0))
    return small_table(p.spark, rows, "column string, vif double")


def note_list(p: Profile) -> list[tuple[str, str, str]]:
    """(code, column or pair, sentence) of what limits the correlations."""
    found: list[tuple[str, str, dict]] = []
    for (a, b), rho in p.spearman.items() if len(p.numeric) >= 2 else ():
        r = p.pearson[a, b]
        if r is not None and rho is not None and abs(rho) > 0.2 and abs(r - rho) > 0.15:
            found.append(("pearson_spearman_gap", f"{a} × {b}", {"r": r, "rho": rho}))
    for c, v in (p.vif or {}).items():
        for code, limit in (("severe_vif", 10), ("moderate_vif", 5)):
            if v is not None and v > limit:
                found.append((code, c, {"vif": v, "limit": limit}))
                break
    for c, f in p.frequencies_of(p.categorical).items():
        if f.unique > 20:
            found.append(("many_categories", c, {"unique": f.unique}))
    skewed = [c for c, m in p.moments.items() if m.skewness is not None and abs(m.skewness) > 2.0]
    if len(p.numeric) >= 2 and len(skewed) >= 2:
        found.append(("skewed_columns", ", ".join(skewed), {"count": len(skewed)}))
    return [(code, subject, say(code, **numbers)) for code, subject, numbers in found]


def correlation_notes(source: DataFrame | Profile) -> DataFrame:
    p = Profile.of(source)
    return small_table(p.spark, note_list(p), "code string, subject string, note string")
