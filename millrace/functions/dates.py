"""Dates and places as column expressions. A reference date is always an argument."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def parse_timestamp(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt))


def best_format(df, column: str, formats: list[str]) -> str | None:
    """The format that reads most of a column's values; the first wins ties. One pass, one row back."""
    counts = df.agg(*[F.count(F.try_to_timestamp(F.col(column), F.lit(f))).alias(str(i)) for i, f in enumerate(formats)])
    row = counts.first()
    best = max(range(len(formats)), key=lambda i: (row[str(i)], -i))
    return formats[best] if row[str(best)] else None


def date_parts(c: Column) -> dict[str, Column]:
    """Calendar parts; Monday is day 0 of the week."""
    return {
        "year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "dayofweek": F.weekday(c), "hour": F.hour(c),
        "isoweek": F.weekofyear(c), "is_december": F.month(c) == 12,
    }


def month_cycle(c: Column) -> tuple[Column, Column]:
    angle = 2 * math.pi * F.month(c) / 12.0
    return F.sin(angle), F.cos(angle)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("bigint")


def age_band(birth: Column, reference_year: int, width: int = 10) -> Column:
    """"30-39" from a birth date; never below zero."""
    age = F.greatest(F.lit(reference_year) - F.year(birth), F.lit(0))
    low = (F.floor(age / width) * width).cast("int")
    return F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))


def postcode_area(c: Column, keep: int = 3) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(text != "", F.upper(F.substring(text, 1, keep)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def speed_kmh(km: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, km / (seconds / 3600.0))
