"""Association of every column with one target column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeprofile.functions.columns import (
    as_double, is_number, numeric_columns, small_table, text_key,
)
from lakeprofile.functions.pvalues import f_tail
from lakeprofile.operators.contingency import cramers_v
from lakeprofile.operators.correlate import pair_correlations
from lakeprofile.operators.frequency import value_table
from lakeprofile.operators.groups import levene, one_way
from lakeprofile.operators.moments import numeric_moments
from lakeprofile.plans.correlation import encode
from lakeprofile.plans.profile import Profile
from lakeprofile.plans.wording import say

MIN_PAIRS = 5
SMALL_CLASS = 30
UNEQUAL = 0.05
FEATURES = "rank bigint, feature string, score double, method string, direction string"


@dataclass
class Association:
    feature: str
    score: float | None
    method: str
    direction: str


def ensure_target(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise ValueError(f"no column {target!r} to be the target among {df.columns}")


def target_type(df: DataFrame, target: str) -> str:
    """Booleans count as numbers here."""
    dtype = df.schema[target].dataType
    return "numeric" if is_number(dtype) or isinstance(dtype, T.BooleanType) else "categorical"


def associations(source: DataFrame | Profile, target: str) -> list[Association]:
    """Every scored column, strongest first; undefined scores last."""
    p = Profile.of(source)
    ensure_target(p.df, target)
    if target_type(p.df, target) == "numeric":
        found = _numeric_target(p, target)
    else:
        found = _class_target(p, target)
    place = {c: k for k, c in enumerate(p.columns)}
    return sorted(
        found, key=lambda a: (a.score is None, -(a.score or 0.0), place[a.feature])
    )


def _numbers(p: Profile, target: str) -> list[str]:
    return [c for c in numeric_columns(p.df, with_bool=True) if c != target]


def _linear(p: Profile, x: dict, pairs: list, method: dict[str, str], target: str):
    """Associations from one pass of pairwise sums."""
    gappy = {c for c in x if p.present[c] < p.rows}
    centre = {c: p.centre(c) if is_number(p.df.schema[c].dataType) else 0.5 for c in x}
    out = []
    for pair, (n, r) in pair_correlations(p.df, x, centre, gappy, pairs).items():
        feature = pair[0] if pair[1] == target else pair[1]
        if n >= MIN_PAIRS:
            side = "positive" if r is not None and r > 0 else "negative"
            out.append(Association(feature, None if r is None else abs(r), method[feature], side))
    return out


def _numeric_target(p: Profile, target: str) -> list[Association]:
    numbers = _numbers(p, target)
    texts = [c for c in p.columns if c not in numbers and c != target]
    binary = p.binary_columns(texts)
    x = {c: as_double(p.df, c) for c in [*numbers, target]}
    x |= {c: encode(p, c, v) for c, v in binary.items()}
    method = dict.fromkeys(numbers, "pearson") | dict.fromkeys(binary, "point_biserial")
    return _linear(p, x, [(c, target) for c in [*numbers, *binary]], method, target)


def _class_target(p: Profile, target: str) -> list[Association]:
    numbers = _numbers(p, target)
    texts = [c for c in p.columns if c not in numbers and c != target]
    known = p.frequencies_of([*texts, target])
    out = []
    if known[target].unique == 2:
        x = {c: as_double(p.df, c) for c in numbers}
        x[target] = encode(p, target, p.binary_columns([target])[target])
        pairs = [(c, target) for c in numbers]
        out += _linear(p, x, pairs, dict.fromkeys(numbers, "point_biserial"), target)
    elif numbers:
        x = {c: as_double(p.df, c) for c in numbers}
        centre = {c: p.centre(c) for c in x}
        for c, layout in one_way(p.df, text_key(p.df, target), x, centre=centre).items():
            if layout.classes >= 2:
                out.append(Association(c, layout.eta_squared, "eta_squared", "N/A"))
    unique = {c: f.unique for c, f in known.items()}
    for (c, _), v in cramers_v(p.df, [(c, target) for c in texts], unique).items():
        if v > 0:
            out.append(Association(c, v, "cramers_v", "N/A"))
    return out


def feature_table(source: DataFrame | Profile, target: str, top: int | None = None) -> DataFrame:
    """Scored columns in order; ``top`` keeps the strongest few."""
    p = Profile.of(source)
    rows = [
        (k, a.feature, a.score, a.method, a.direction)
        for k, a in enumerate(associations(p, target)[:top], start=1)
    ]
    return small_table(p.spark, rows, FEATURES)


def class_sizes(source: DataFrame | Profile, target: str) -> DataFrame:
    """Rows of every target class."""
    p = Profile.of(source)
    ensure_target(p.df, target)
    return value_table(p.df, [target]).select(F.col("value").alias("class"), "count", "share")


def small_classes(source: DataFrame | Profile, target: str) -> DataFrame:
    return class_sizes(source, target).where(F.col("count") < SMALL_CLASS)


def levene_table(source: DataFrame | Profile, target: str) -> DataFrame:
    """Levene's test of equal class variances for every numeric column."""
    p = Profile.of(source)
    rows = [(c, w, k, n, pv) for c, (w, k, n, pv) in levene_tests(p, target).items()]
    return small_table(
        p.spark, rows, "column string, w double, classes bigint, rows bigint, pvalue double"
    )


def levene_tests(p: Profile, target: str) -> dict[str, tuple]:
    classes = p.frequencies_of([target])[target].unique
    if classes <= 2:
        return {}
    columns = {c: as_double(p.df, c) for c in p.numeric if c != target}
    layouts = levene(p.df, text_key(p.df, target), columns, classes, p.rows)
    return {
        c: (o.f, o.classes, o.rows,
            None if o.f is None else f_tail(o.f, o.classes - 1, o.rows - o.classes))
        for c, o in layouts.items() if o.classes >= 2
    }


def note_list(p: Profile, target: str) -> list[tuple[str, str]]:
    """(code, sentence) of what limits the scores; `levene_table` and `small_classes` have the rows."""
    found: dict[str, dict] = {}
    if target_type(p.df, target) == "categorical":
        unequal = [
            c for c, t in levene_tests(p, target).items() if t[3] is not None and t[3] < UNEQUAL
        ]
        if unequal:
            found["unequal_variances"] = {"count": len(unequal), "limit": UNEQUAL}
        few = small_classes(p, target).count()
        if few:
            found["small_classes"] = {"count": few, "limit": SMALL_CLASS}
    else:
        if target in p.numeric:
            m = p.moments[target]
        else:
            number = p.df.select(as_double(p.df, target).alias("t"))
            m = numeric_moments(number, ["t"])[2]["t"]
        if m.skewness is not None and abs(m.skewness) > 2.0:
            found["skewed_target"] = {"skew": m.skewness}
    return [(code, say(code, **numbers)) for code, numbers in found.items()]


def target_notes(source: DataFrame | Profile, target: str) -> DataFrame:
    p = Profile.of(source)
    ensure_target(p.df, target)
    return small_table(p.spark, note_list(p, target), "code string, note string")

