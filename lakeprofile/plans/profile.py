"""A DataFrame with the statistics already computed for it."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.functions.columns import (
    aggregate_once, as_double, as_text, categorical_columns, is_text, numeric_columns, together,
)
from lakeprofile.functions.text import parses_as_number
from lakeprofile.operators.correlate import pearson_pairs, spearman_pairs, vif_values
from lakeprofile.operators.duplicates import duplicate_columns, duplicate_rows
from lakeprofile.operators.frequency import (
    TOP_VALUES, Frequencies, exact_as_double, number_frequencies, text_frequencies,
)
from lakeprofile.operators.moments import Moments, numeric_moments, present_counts
from lakeprofile.operators.quantiles import (
    WINDOW_VALUES, exact_quantiles, interpolated, wanted_ranks,
)

PROBABILITIES = [0.05, 0.25, 0.5, 0.75, 0.95]


class Profile:
    """Memo of sub-results shared by the analyses of one table.

    Every field is a handful of numbers per column (or per pair of columns); rows stay in Spark.
    Each is computed on first use by as few scans as its definition allows.
    """

    def __init__(
        self, df: DataFrame, checks: bool = False, window_values: int = WINDOW_VALUES,
        top: int = TOP_VALUES,
    ):
        self.df = df
        self.spark = df.sparkSession
        self.window_values = window_values
        self._frequencies: dict[str, Frequencies] = {}
        self._top = max(2, top)  # values kept per column
        self._checks = checks  # whether the frequency pass also looks into text
        self.columns = list(df.columns)
        self.numeric = numeric_columns(df)
        self.categorical = categorical_columns(df)
        self.text = [f.name for f in df.schema.fields if is_text(f.dataType)]

    @staticmethod
    def of(source: DataFrame | Profile, checks: bool = False) -> Profile:
        return source if isinstance(source, Profile) else Profile(source, checks)

    def prepare(self, *fields: str) -> None:
        """Compute independent fields at the same time."""
        together(*[lambda name=name: getattr(self, name) for name in fields])

    @cached_property
    def _scan(self) -> tuple[int, dict[str, int], dict[str, Moments]]:
        return numeric_moments(self.df, self.numeric, self.categorical)

    @cached_property
    def _counts(self) -> tuple[int, dict[str, int]]:
        if "_scan" in self.__dict__:
            return self._scan[:2]
        return present_counts(self.df, self.columns)

    @property
    def rows(self) -> int:
        return self._counts[0]

    @property
    def present(self) -> dict[str, int]:
        return self._counts[1]

    @property
    def moments(self) -> dict[str, Moments]:
        return self._scan[2]

    def missing(self, column: str) -> int:
        return self.rows - self.present[column]

    def missing_share(self, column: str) -> float:
        return self.missing(column) / self.rows if self.rows else 0.0

    @property
    def gappy(self) -> list[str]:
        """Columns with any missing cell."""
        return [c for c in self.columns if self.missing(c) > 0]

    @property
    def frequencies(self) -> dict[str, Frequencies]:
        return self.frequencies_of(self.columns)

    def frequencies_of(self, columns: list[str]) -> dict[str, Frequencies]:
        """Value frequencies of some columns; numbers and texts are one shuffle each.

        The pass over numbers also reads off the quantile ranks of the columns one window can
        sort.
        """
        new = [c for c in columns if c not in self._frequencies]
        numbers = [
            c for c in new
            if c in self.moments_of(new)
            and exact_as_double(self.df.schema[c].dataType, self._limits.get(c))
        ]
        ranks = {c: wanted_ranks(self.moments[c].count, PROBABILITIES) for c in numbers
                 if self.moments[c].count <= self.window_values}
        texts = [c for c in new if c not in numbers]
        limits = self._limits if numbers else {}
        for found in together(
            lambda: number_frequencies(self.df, numbers, ranks, limits),
            lambda: text_frequencies(self.df, texts, self._checks, self._top),
        ):
            self._frequencies |= found
        return {c: self._frequencies[c] for c in columns}

    def moments_of(self, columns: list[str]) -> dict[str, Moments]:
        """Moments, without a pass if none of the columns is numeric."""
        return self.moments if set(columns) & set(self.numeric) else {}

    @property
    def _limits(self) -> dict[str, tuple[float, float]]:
        return {c: (m.minimum, m.maximum) for c, m in self.moments.items() if m.count > 0}

    def binary_columns(self, columns: list[str]) -> dict[str, tuple[str, str]]:
        """Columns with exactly two values, and those values in order."""
        known = self.frequencies_of(columns)
        return {
            c: tuple(sorted(v for v, _ in f.top)) for c, f in known.items() if f.unique == 2
        }

    def centre(self, column: str) -> float:
        """A value near the middle of a numeric or boolean column."""
        m = self.moments.get(column)
        return 0.5 if m is None or m.mean is None or not math.isfinite(m.mean) else m.mean

    @cached_property
    def quantiles(self) -> dict[str, dict[float, float | None]]:
        counts = {c: m.count for c, m in self.moments.items()}
        known = {c: f.at_rank for c, f in self._frequencies.items() if f.at_rank}
        got = {
            c: interpolated(counts[c], PROBABILITIES, at_rank) for c, at_rank in known.items()
        }
        rest = [c for c in self.numeric if c not in got]
        got |= exact_quantiles(
            self.df, {c: as_double(self.df, c) for c in rest}, PROBABILITIES, counts,
            self._limits, self.window_values,
        )
        return {c: dict(zip(PROBABILITIES, v, strict=True)) for c, v in got.items()}

    @cached_property
    def mad(self) -> dict[str, float | None]:
        """Median absolute deviation of every numeric column."""
        centre = {c: q[0.5] for c, q in self.quantiles.items() if q[0.5] is not None}
        got = exact_quantiles(
            self.df, {c: F.abs(as_double(self.df, c) - m) for c, m in centre.items()}, [0.5],
            {c: self.moments[c].count for c in centre},
            {c: (0.0, max(abs(v - centre[c]) for v in self._limits[c])) for c in centre},
            self.window_values,
        )
        return {c: got[c][0] if c in got else None for c in self.numeric}

    @cached_property
    def duplicates(self) -> int:
        return duplicate_rows(self.df).first()["duplicates"]

    @cached_property
    def duplicate_columns(self) -> list[tuple[str, str]]:
        return duplicate_columns(self.df)

    @cached_property
    def number_cells(self) -> dict[str, int]:
        """Cells of each text column that parse as a number."""
        if self._checks:
            known = self.frequencies_of(self.text)
            return {c: known[c].text.numbers for c in self.text}
        return aggregate_once(
            self.df, {c: F.count_if(parses_as_number(as_text(self.df, c))) for c in self.text}
        )

    @cached_property
    def pearson(self) -> dict[tuple[str, str], float | None]:
        return pearson_pairs(self.df, self.numeric, self.moments, self.rows)

    @cached_property
    def spearman(self) -> dict[tuple[str, str], float | None]:
        return spearman_pairs(self.df, self.numeric, self.moments, self.rows)

    @cached_property
    def vif(self) -> dict[str, float | None] | None:
        gaps = [c for c in self.numeric if self.present[c] < self.rows]
        return vif_values(
            self.df, self.numeric, {c: self.centre(c) for c in self.numeric}, gaps, self.rows,
            None if gaps else self.pearson,
        )
