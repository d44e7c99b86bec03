"""Overview of a table and the quality gate in front of an analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lakeprofile.functions.columns import small_table
from lakeprofile.operators.moments import stored_bytes
from lakeprofile.plans.profile import Profile
from lakeprofile.plans.wording import say

OVERVIEW = "column string, dtype string, rows bigint, non_null bigint, null_pct double, bytes bigint"
ISSUES = "check string, severity string, column string, value double, note string"

# The names of the checks are those below in `issues`; characters that a column name
# should not hold.
SPECIAL_CHARACTERS = set("!@#$%^&*()[]{}<>?/\\|")

HIGH_MISSING = 0.90
HIGH_DUPLICATES = 0.50
MIXED_RANGE = (0.01, 0.99)


class DataQualityError(Exception):
    """The table cannot be analysed."""


def overview(source: DataFrame | Profile) -> DataFrame:
    """One row per column: type, present cells, missing percentage and approximate bytes."""
    p = Profile.of(source)
    size = stored_bytes(p.df, p.columns)
    return small_table(
        p.spark,
        [
            (c, p.df.schema[c].dataType.simpleString(), p.rows, p.present[c],
             round(100 * p.missing_share(c), 2), size[c])
            for c in p.columns
        ],
        OVERVIEW,
    )


@dataclass(frozen=True)
class Issue:
    """A broken check: its name, the column it names ('' for the table) and the number behind it."""

    check: str
    severity: str
    column: str
    value: float
    code: str


def issues(source: DataFrame | Profile, gate: bool = True) -> list[Issue]:
    """Quality issues in check order; an empty table raises unless the gate is off."""
    p = Profile.of(source)
    empty = []
    if p.rows == 0:
        empty.append(Issue("Empty rows", "FATAL", "", 0.0, "rows"))
    if not p.columns:
        empty.append(Issue("Empty columns", "FATAL", "", 0.0, "columns"))
    if empty and gate:
        raise DataQualityError(", ".join(say(i.code, value=i.value) for i in empty))
    out = empty
    out += [
        Issue(f"High missing: {c}", "WARNING", c, p.missing_share(c), "missing")
        for c in p.columns if p.missing_share(c) > HIGH_MISSING
    ]
    if p.rows and p.duplicates / p.rows > HIGH_DUPLICATES:
        out.append(Issue("High duplicates", "WARNING", "", p.duplicates / p.rows, "duplicates"))
    if 1 < len(p.columns) == len(p.text):
        out.append(Issue("All-object dtypes", "WARNING", "", float(len(p.text)), "text_only"))
    odd = [c for c in p.columns if SPECIAL_CHARACTERS & set(c)]
    if odd:
        out.append(Issue("Special chars in column names", "INFO", "", float(len(odd)), "special_names"))
    out += [
        Issue(f"Mixed types: {c}", "WARNING", c, share, "mixed")
        for c, share in mixed_columns(p).items()
    ]
    return out


def mixed_columns(p: Profile) -> dict[str, float]:
    """Text columns where some but not all rows, missing ones included, are numbers."""
    if not p.rows:
        return {}
    shares = {c: n / p.rows for c, n in p.number_cells.items()}
    return {c: s for c, s in shares.items() if MIXED_RANGE[0] < s < MIXED_RANGE[1]}


def quality_issues(source: DataFrame | Profile, gate: bool = True) -> DataFrame:
    p = Profile.of(source)
    rows = [(i.check, i.severity, i.column, i.value, say(i.code, value=i.value)) for i in issues(p, gate)]
    return small_table(p.spark, rows, ISSUES)


def status_of(severities: list[str]) -> str:
    if "FATAL" in severities:
        return "FAILED"
    return "PASSED WITH WARNINGS" if "WARNING" in severities else "PASSED"


def quality_status(source: DataFrame | Profile) -> DataFrame:
    """One row: the status and how many issues of each severity there are."""
    p = Profile.of(source)
    severities = [i.severity for i in issues(p, gate=False)]
    counts = [severities.count(s) for s in ("FATAL", "WARNING", "INFO")]
    return small_table(
        p.spark,
        [(status_of(severities), *counts)],
        "status string, fatal bigint, warnings bigint, infos bigint",
    )


def assert_quality(df: DataFrame) -> DataFrame:
    """The table itself, for chaining; raises DataQualityError if it is empty."""
    if not df.columns or df.isEmpty():
        issues(df, gate=True)
    return df


def duplicate_summary(source: DataFrame | Profile) -> DataFrame:
    p = Profile.of(source)
    share = p.duplicates / p.rows if p.rows else 0.0
    return small_table(
        p.spark, [(p.rows, p.duplicates, share)],
        "rows bigint, duplicates bigint, duplicate_share double",
    )
