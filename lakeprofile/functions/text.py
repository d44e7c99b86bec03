"""Column expressions that look inside text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that read as a missing value once trimmed and lower-cased.
MISSING_WORDS = ["", "?", "-", "na", "n/a", "#n/a", "null", "none", "nan", "missing"]

# Cells that delimited text readers take as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Date layouts, month first, with the shape a text must have to be tried; None is
# the ISO reading of a cast.
DATE_LAYOUTS = [
    (r"^\d{4}$", None),
    (r"^\d{4}-\d{1,2}$", "yyyy-M"),
    (r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$", None),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "M.d.yyyy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}:\d{2}(:\d{2})?$", None),
]

# No layout is longer once the padding is gone, not even a time with the longest name of a zone.
_LONGEST_DATE = 80


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parses_as_number(text: Column) -> Column:
    """True where the whole text is a number; a shape test, so no cast fails row by row."""
    number = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"
    return F.coalesce(text.rlike(number), F.lit(False))


def parse_date(text: Column) -> Column:
    """Timestamp of the text under the first layout that fits, else NULL."""

    def read(t: Column) -> Column:
        return F.coalesce(*[
            F.when(
                t.rlike(shape),
                F.try_to_timestamp(t) if layout is None else F.try_to_timestamp(t, F.lit(layout)),
            )
            for shape, layout in DATE_LAYOUTS
        ])

    def read_short(t: Column) -> Column:
        return F.when(F.length(t) <= _LONGEST_DATE, read(t))

    # The one-element array makes Spark strip the text once, not once per layout.
    return F.when(text.rlike(r"\d"), F.get(F.transform(F.array(strip(text)), read_short), F.lit(0)))


def reads_as_missing(text: Column) -> Column:
    return F.lower(strip(text)).isin(MISSING_WORDS)
