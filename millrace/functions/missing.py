"""Missing-value policies and lenient text parsing as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words read as missing when profiling.
MISSING_WORDS = ("", "na", "nan", "null", "none")

# Date-looking text (year first, or day/month first with a four-digit year).
DATE_HINT = r"^\s*(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?:[T\s]|$)"
ISO_DATE = r"^\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?\s*$"


def bind(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often ``use`` mentions it; keeps generated code small."""
    return F.transform(F.array(c), use)[0]


def is_missing_word(c: Column) -> Column:
    """Null, or text that trims and lower-cases to a missing word."""
    text = c.cast("string")
    return text.isNull() | F.lower(F.trim(text)).isin(*MISSING_WORDS)


def lenient_double(c: Column) -> Column:
    """Number from text with thousands commas; missing words and other text give null."""
    text = F.trim(c.cast("string"))
    value = F.regexp_replace(text, ",", "").try_cast("double")
    return F.when(is_missing_word(c) | F.isnan(value), F.lit(None)).otherwise(value)


def parse_day(c: Column) -> Column:
    """Date from year-first or year-last text; month before day unless that cannot be."""
    year_first, year_last = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"

    def read(text: Column) -> Column:
        def part(pattern: str) -> Column:
            return F.regexp_replace(F.regexp_extract(text, pattern, 0), "[/.]", "-")

        last = F.coalesce(F.try_to_date(part(year_last), "M-d-y"), F.try_to_date(part(year_last), "d-M-y"))
        return F.when(text.rlike(year_first), F.try_to_date(part(year_first), "y-M-d")).when(text.rlike(year_last), last)

    return bind(F.trim(c.cast("string")), read)


def iso_day_text(c: Column) -> Column:
    """``yyyy-MM-dd`` for ISO-style date text with month 1–12 and day 1–31, else null."""
    text = c.cast("string")
    y, m, d = (F.regexp_extract(text, ISO_DATE, i) for i in (1, 2, 3))
    fine = (y != "") & m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
    return F.when(fine, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def as_double(df: DataFrame, column: str) -> Column:
    """The column as a number; text is read leniently, typed numbers are taken as they are (NaN is missing)."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.NumericType):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return lenient_double(c)
