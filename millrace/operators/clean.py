"""Row-preserving cleaning: fills, scaling, null rules, base cleaning, target filtering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import numbers as N
from millrace.operators.aggregates import metric, text_columns
from millrace.operators.windows import _join_back, percentiles


def fill_with(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def fill_with_aggregate(df: DataFrame, column: str, how: str = "mean") -> DataFrame:
    """Fill gaps with a statistic of the whole column, computed once as a scalar subquery."""
    if how == "median":
        value = percentiles(df, column, {"v": 0.5}).select("v").scalar()
    else:
        value = df.agg(metric(how, F.col(column).cast("double"))).scalar()
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), value))


def fill_with_group_median(df: DataFrame, column: str, by: Sequence[str], **kw) -> DataFrame:
    """Fill gaps with the exact median of the row's group."""
    medians = percentiles(df, column, {"_m": 0.5}, by, **kw).drop("n")
    joined = _join_back(df, medians, by)
    return joined.withColumn(column, F.coalesce(F.col(column).cast("double"), "_m")).drop("_m")


def null_where(df: DataFrame, column: str, condition: Column) -> DataFrame:
    return df.withColumn(column, F.when(~F.coalesce(condition, F.lit(False)), F.col(column)))


def scaled(df: DataFrame, column: str, how: str, out: str) -> DataFrame:
    """``min_max``, ``z_score`` (population) or ``log``; the statistics are one row, computed once."""
    x = F.col(column).cast("double")
    if how == "log":
        return df.withColumn(out, N.log_scale(x))
    facts = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("m"),
                            F.stddev_pop(x).alias("s")).alias("f")).scalar()
    if how == "min_max":
        return df.withColumn(out, N.min_max(x, facts.getField("lo"), facts.getField("hi")))
    if how == "z_score":
        return df.withColumn(out, N.z_score(x, facts.getField("m"), facts.getField("s")))
    raise ValueError(f"unknown scaling {how!r}")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One of every set of identical rows. Every column is compared, so no row goes for sharing a digest; maps by their entries."""
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    entries = {f"_entries{i}": F.array_sort(F.map_entries(c)) for i, c in enumerate(maps)}
    return df.withColumns(entries).dropDuplicates([*(c for c in df.columns if c not in maps), *entries]).select(*df.columns)


def base_clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop constant columns, then duplicate rows, then trim text. Returns the rows and a one-row report."""
    spread = df.agg(*[F.struct(F.min(F.col(c).cast("string")).alias("a"), F.max(F.col(c).cast("string")).alias("b")).alias(c)
                      for c in df.columns]).first()
    constant = [c for c in df.columns if spread[c]["a"] == spread[c]["b"]]
    kept = df.drop(*constant)
    unique = drop_duplicate_rows(kept)
    trimmed = unique.withColumns({c: F.trim(c) for c in text_columns(kept)})
    before, after = kept.agg(F.count("*")).scalar(), unique.agg(F.count("*")).scalar()
    report = df.agg(F.count("*").alias("rows_in")).select(
        "rows_in", (before - after).alias("rows_removed"), F.lit(",".join(constant)).alias("columns_dropped"))
    return trimmed, report


def with_valid_target(df: DataFrame, target: str, task: str) -> DataFrame:
    """Rows a model may learn from: a non-blank class, or a finite number (text targets are read as numbers)."""
    c = F.col(target)
    if "classification" in task:
        blank = F.trim(c) == "" if isinstance(df.schema[target].dataType, T.StringType) else F.lit(False)
        return df.where(c.isNotNull() & ~blank)
    number = c.try_cast("double")
    fine = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return df.withColumn(target, F.when(fine, number)).where(F.col(target).isNotNull())


def boolean_column(df: DataFrame, column: str) -> DataFrame | None:
    """The column read as a boolean when its distinct values are a known pair; ``None`` when they are not."""
    from millrace.functions.text import boolean_pair, to_boolean

    values = df.select(F.lower(F.trim(column)).alias("v")).where("v is not null").distinct().limit(3).collect()
    pair = boolean_pair([r["v"] for r in values])
    return None if pair is None else df.withColumn(column, to_boolean(F.col(column), pair))


def filter_year(df: DataFrame, column: str, year: int) -> DataFrame:
    """Year predicate on a date column, or on text that parses as a date (no year column needed)."""
    from millrace.functions.missing import parse_day

    field = df.schema[column].dataType
    day = parse_day(F.col(column)) if isinstance(field, T.StringType) else F.col(column)
    if isinstance(field, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        start, end = F.lit(f"{year}-01-01").cast(field), F.lit(f"{year + 1}-01-01").cast(field)
        return df.where((F.col(column) >= start) & (F.col(column) < end))
    return df.where(F.year(day) == year)


def top_cells(df: DataFrame, lat: str, lon: str, places: int, top: int) -> DataFrame:
    """Busiest cells of a rounded coordinate grid."""
    cells = df.groupBy(F.round(lat, places).alias("cell_lat"), F.round(lon, places).alias("cell_lon"))
    return cells.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cell_lat", "cell_lon").limit(top)
