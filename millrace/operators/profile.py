"""Column profiles, roles, quality scores and the findings drawn from them.

A profile is a DataFrame with one row per column. Moments come from one pass over the table; distinct counts and top
values from one (column, value) count that is combined map-side; percentiles are exact at any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.missing import DATE_HINT, as_double, is_missing_word, iso_day_text, lenient_double, parse_day
from millrace.operators.aggregates import correlation_pairs, numeric_columns, text_columns, value_counts
from millrace.operators.windows import counting_values, exact_quantiles, quantiles, sketch, top_per_group
from millrace.session import kept, reread, settled

# Role and quality thresholds.
HIGH_MISSING = 0.30
HIGH_CARDINALITY = 0.90
ID_UNIQUE = 0.98
DATE_SHARE = 0.95
LONG_TEXT = 40
SMALL_TABLE = 200
PENALTY = {"high": 12, "medium": 6, "low": 2}

# Chart-profile thresholds and names.
CHART_DATE_SHARE = 0.8
ID_NAME = (
    r"(?i)(?:^|[\s_\-])(id|no|num|number|code|uuid|key|phone|zip|zipcode|postcode|pin|pincode"
    r"|tract|census[\s_\-]?tract|fips|geoid|geo[\s_\-]?id|msamd|msa[\s_\-]md|msa|cbsa)$"
)
YEAR_NAME = r"(?i)(?:^|[\s_\-])(year|yr|fy|fiscal[\s_\-]?year)(?:$|[\s_\-])"
NON_NEGATIVE_NAME = r"(?i)amount|price|cost|bill|fee|charge|salary|age|count|qty|quantity|total"
PERSON_NAME = r"(?i)(^|_)(name|first_name|last_name|patient|customer|doctor)$"


def kind_of(field: T.StructField) -> str:
    t = field.dataType
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "text"


def _kinds(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    return {f.name: kind_of(f) for f in df.schema.fields if f.name in set(columns)}


def _rows(df: DataFrame, cells: Sequence[Column]) -> DataFrame:
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness; 0 below three values or without spread."""
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    fixed = g1 * F.sqrt(n * (n - 1)) / F.try_subtract(n, F.lit(2.0))
    return F.when((F.count(x) > 2) & (F.stddev_pop(x) > 0), F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)).otherwise(
        F.when(fixed.isNull(), 0.0).otherwise(0.0))


def column_measures(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = ()) -> DataFrame:
    """One pass: sizes, moments, text length and date evidence for every column; with ``probs``, a sketch of each numeric one.

    Each row becomes one entry per column, and entries are aggregated by column: a dozen aggregates whatever the table's width,
    combined before the shuffle.
    """
    kinds = _kinds(df, columns)

    def entry(i: int, c: str) -> Column:
        x, v = (F.col(c).cast(t) if kinds[c] == k else F.lit(None).cast(t) for k, t in (("numeric", "double"), ("text", "string")))
        return F.struct(F.lit(i).alias("i"), F.col(c).isNotNull().alias("there"), x.alias("x"), v.alias("v"))

    long = df.select(F.explode(F.array(*[entry(i, c) for i, c in enumerate(columns)])).alias("e")).select("e.*")
    x, v = F.col("x"), F.col("v")
    numeric = {
        "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "std": F.stddev_samp(x), "std_pop": F.stddev_pop(x), "skew": sample_skewness(x),
        "skew_pop": F.skewness(x), "n_fractional": F.count_if(x % 1 != 0)}
    dated = v.rlike(DATE_HINT)
    text = {
        "mean_length": F.avg(F.length(v)), "hint_share": F.avg(dated.cast("double")),
        "parse_share": F.avg(F.coalesce(F.when(dated, parse_day(v).isNotNull()), F.lit(False)).cast("double"))}
    spots = [sketch(long, "x", probs).alias("sketch")] if probs else []
    found = long.groupBy("i").agg(
        *spots, F.count("*").alias("n_rows"), F.count_if("there").alias("n"), *[e.alias(k) for k, e in (numeric | text).items()])
    names = df.sparkSession.createDataFrame(
        [(i, c, df.schema[c].dataType.simpleString(), kinds[c]) for i, c in enumerate(columns)], "i int, name string, dtype string, kind string")
    # A table without rows has no entries: its columns get what an aggregate of nothing is.
    none = F.lit(None).cast("double")
    nothing = F.struct(none.alias("lo"), none.alias("hi"), *[F.lit(0).cast("bigint").alias(k) for k in ("n", "finite", "below")], F.lit(None).cast("array<double>").alias("edges"))
    empty = {"skew": F.lit(0.0), "n_fractional": F.lit(0).cast("bigint")}
    is_number = F.col("kind") == "numeric"
    return names.join(found, "i", "left").select(
        *[F.coalesce("sketch", nothing).alias("sketch") for _ in spots], "name", "dtype", "kind",
        *[F.coalesce(k, F.lit(0).cast("bigint")).alias(k) for k in ("n_rows", "n")],
        *[F.when(is_number, F.coalesce(k, empty[k]) if k in empty else F.col(k)).alias(k) for k in numeric], *text)


def _quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """(name, p25, median, p75) per numeric column, exact; the values are a few numbers per column."""
    if not columns:
        return None
    rows = [(c, *v) for c, v in quantiles(df.select(*columns), columns, [0.25, 0.5, 0.75]).items()]
    return df.sparkSession.createDataFrame(rows, "name string, p25 double, median double, p75 double")


def role() -> Column:
    """Role from the measures, in the fixed order: constant, datetime, boolean, id, numeric, text, categorical."""
    unique_share = F.col("n_unique") / F.greatest(F.col("n"), F.lit(1))
    dates = (F.col("hint_share") >= DATE_SHARE) & (F.col("parse_share") >= DATE_SHARE)
    return (
        F.when(F.col("n_unique") <= 1, "constant")
        .when(F.col("kind") == "datetime", "datetime").when(F.col("kind") == "boolean", "boolean")
        .when(F.col("kind") == "numeric", F.when(
            (unique_share >= ID_UNIQUE) & (F.col("n_fractional") == 0), "id").otherwise("numeric"))
        .when(F.coalesce(dates, F.lit(False)), "datetime").when(unique_share >= ID_UNIQUE, "id")
        .when(F.col("mean_length") > LONG_TEXT, "text").otherwise("categorical")
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    """One row per column: role, missingness, distinct values, statistics, top values. Computed once, then a local table."""
    columns = list(columns or df.columns)
    with reread(df.select(*columns)) as rows:
        return settled(_profile(rows, columns, top))


def _profile(df: DataFrame, columns: Sequence[str], top: int) -> DataFrame:
    """Two reads: one aggregation with the moments and a sketch of every column, one (column, value) count.

    Distinct counts, top values, exact quartiles and outliers all come from that count, which is written once.
    """
    probs = [0.25, 0.5, 0.75]
    measured = column_measures(df, columns, probs)
    measures = measured.collect()
    numbers = [c for c in numeric_columns(df) if c in columns]
    counts = value_counts(df, columns)
    floats = [c for c in numbers if isinstance(df.schema[c].dataType, T.FloatType)]
    number = F.when(F.col("column").isin(*floats), F.col("value").try_cast("float").cast("double")).otherwise(F.col("value").try_cast("double")) if floats else F.col("value").try_cast("double")
    x = F.when(F.col("column").isin(*numbers), number) if numbers else F.lit(None).cast("double")
    counts = kept(counts.withColumn("x", F.when(~F.isnan(x), x)), "value-counts")
    best = top_per_group(counts, ["column"], [F.desc("n"), F.asc("value")], top)
    pairs = F.struct("position", "value", F.col("n").alias("count"))
    tops = best.groupBy("column").agg(F.array_sort(F.collect_list(pairs)).alias("top_values"))
    known = exact_quantiles({m["name"]: m["sketch"] for m in measures if m["name"] in numbers}, probs, counting_values(counts, numbers))
    outside = F.lit(False)
    for c, (q1, _, q3) in known.items():
        if q1 is not None:
            beyond = (F.col("x") < q1 - 1.5 * (q3 - q1)) | (F.col("x") > q3 + 1.5 * (q3 - q1))
            outside = F.when(F.col("column") == c, beyond).otherwise(outside)
    # NaN lies above every fence, as in a comparison of doubles.
    nan = F.col("column").isin(*numbers) & (F.col("value") == "NaN") if numbers else F.lit(False)
    distinct = counts.groupBy("column").agg(F.count("*").alias("n_unique"), F.sum(F.when(outside | nan, F.col("n")).otherwise(0)).alias("n_outliers"))
    base = df.sparkSession.createDataFrame(measures, measured.schema).drop("sketch")
    spots = [(c, *known.get(c, (None, None, None))) for c in columns]
    base = base.join(F.broadcast(df.sparkSession.createDataFrame(spots, "name string, p25 double, median double, p75 double")), "name", "left")
    base = base.join(distinct.withColumnRenamed("column", "name"), "name", "left")
    base = base.join(tops.withColumnRenamed("column", "name"), "name", "left")
    outliers = F.when(F.col("kind") == "numeric", F.coalesce("n_outliers", F.lit(0))).cast("bigint")
    base = base.withColumn("n_unique", F.coalesce("n_unique", F.lit(0).cast("bigint"))).withColumn("n_outliers", outliers).withColumn("role", role())
    is_num = F.col("role") == "numeric"
    stats = {"min": None, "max": None, "mean": 6, "median": 6, "std": 6, "p25": None, "p75": None, "skew": 4}
    shown = [
        F.when(is_num, F.col(c) if places is None else F.round(c, places)).alias(c) for c, places in stats.items()
    ]
    n_rows = F.greatest(F.col("n_rows"), F.lit(1))
    return base.select(
        "name", "dtype", "kind", "role", "n_rows", (F.col("n_rows") - F.col("n")).alias("missing"),
        F.round((F.col("n_rows") - F.col("n")) / n_rows, 4).alias("missing_pct"), "n_unique",
        F.round(F.col("n_unique") / n_rows, 4).alias("unique_pct"), *shown,
        F.when(is_num, F.col("n_outliers")).alias("n_outliers"),
        F.when(F.col("role").isin("categorical", "boolean", "id"), F.col("top_values")).alias("top_values"))


def row_fingerprint(columns: Sequence[str]) -> list[Column]:
    """128 bits that stand for a whole row, nulls told apart: what is shuffled instead of the row itself."""
    cells = [F.col(c) for c in columns]
    nulls = F.concat(*[F.isnull(c).cast("int").cast("string") for c in cells])
    return [F.xxhash64(nulls, *cells).alias("_f1"), F.xxhash64(F.lit("second"), nulls, *reversed(cells)).alias("_f2")]


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of their kind, and their share."""
    prints = df.select(*row_fingerprint(columns or df.columns)).groupBy("_f1", "_f2").agg(F.count("*").alias("c"))
    sums = prints.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"),
                      F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))
    return sums.withColumn("ratio", F.coalesce(F.try_divide("duplicates", "n_rows"), F.lit(0.0)))


def quality_issues(profiled: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(severity, column, kind) rows; ``profiled`` from :func:`profile`, ``duplicates`` from :func:`duplicate_rows`."""
    issue = [
        (F.col("role") == "constant", "low", "constant_column"),
        (F.col("missing_pct") >= HIGH_MISSING, "high", "high_missingness"),
        ((F.col("role") == "categorical") & (F.col("unique_pct") >= HIGH_CARDINALITY), "medium", "high_cardinality"),
    ]
    found = F.array(*[
        F.when(cond, F.struct(F.lit(s).alias("severity"), F.col("name").alias("column"), F.lit(k).alias("kind")))
        for cond, s, k in issue
    ])
    per_column = profiled.select(F.explode(F.array_compact(found)).alias("i")).select("i.*")
    whole = duplicates.select(F.explode(F.array_compact(F.array(
        F.when(F.col("duplicates") > 0, F.struct(F.lit("medium").alias("severity"),
               F.lit(None).cast("string").alias("column"), F.lit("duplicate_rows").alias("kind"))),
        F.when(F.col("n_rows") < SMALL_TABLE, F.struct(F.lit("medium").alias("severity"),
               F.lit(None).cast("string").alias("column"), F.lit("small_sample").alias("kind"))),
    ))).alias("i")).select("i.*")
    return per_column.unionByName(whole)


def quality_score(issues: DataFrame) -> DataFrame:
    """100 less the penalties, within 0–100. A small table costs 10."""
    cost = F.when(F.col("kind") == "small_sample", 10)
    for severity, points in PENALTY.items():
        cost = cost.when(F.col("severity") == severity, points)
    total = F.coalesce(F.sum(cost), F.lit(0))
    return issues.agg(F.greatest(F.lit(0), F.least(F.lit(100), 100 - total)).alias("score"),
                      F.count("*").alias("n_issues"))


def text_number_verdict(df: DataFrame, columns: Sequence[str], share: float = 0.1, least: int = 3) -> DataFrame:
    """A column counts as numeric when at least ``share`` of its rows (and ``least``) parse as numbers."""
    cells = []
    for c in columns:
        parsed = F.count(lenient_double(F.col(c)))
        cells.append(F.struct(
            F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.count_if(is_missing_word(F.col(c))).alias("missing"),
            parsed.alias("parsed"),
            (parsed >= F.greatest(F.lit(float(least)), F.count("*") * share)).alias("is_numeric")))
    return _rows(df, cells)


def one_pass_profile(df: DataFrame, columns: Sequence[str] | None = None, share: float = 0.9) -> DataFrame:
    """Type and moments for columns of any type read as text: numeric when ``share`` of the non-nulls parse."""
    columns = list(columns or df.columns)
    cells = []
    for c in columns:
        x = F.col(c).cast("string").try_cast("double")
        x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
        numeric = (F.count(c) > 0) & (F.count(x) >= F.count(c) * share)
        cells.append(F.struct(
            F.lit(c).alias("column"), F.when(numeric, "numeric").otherwise("categorical").alias("type"),
            F.count("*").alias("total_count"), (F.count("*") - F.count(c)).alias("null_count"),
            F.count(x).alias("numeric_count"), F.when(numeric, F.avg(x)).alias("mean"),
            F.when(numeric, F.stddev_pop(x)).alias("std"), F.when(numeric, F.min(x)).alias("min"),
            F.when(numeric, F.max(x)).alias("max")))
    return _rows(df, cells)


def chart_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Roles for charting (time, identifier, measure, dimension, label) from the values' text forms. A local table."""
    columns = list(columns or df.columns)
    with reread(df.select(*columns)) as rows:
        return settled(_chart_profile(rows, columns))


def _chart_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = []
    for c in columns:
        missing = is_missing_word(F.col(c))
        kind = kind_of(df.schema[c])
        if kind == "numeric":
            missing, day, x = F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(None).cast("string"), as_double(df, c)
        else:
            day = F.when(~missing, iso_day_text(F.date_format(c, "yyyy-MM-dd") if kind == "datetime" else F.col(c)))
            x = F.lit(None).cast("double") if kind in ("boolean", "datetime") else lenient_double(F.col(c))
        cells.append(F.struct(
            F.lit(c).alias("name"), F.count("*").alias("n_rows"), F.count_if(~missing).alias("present"),
            F.count(day).alias("n_days"), F.count(x).alias("n_numbers"), F.max(missing.cast("int")).alias("any_missing"), F.count_if(x % 1 != 0).alias("n_fractional"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
            F.skewness(x).alias("skewness")))
    # Distinct numbers and days are counted on the distinct texts, not on the rows.
    values = value_counts(df, columns).where(~is_missing_word(F.col("value")))
    number, day = lenient_double(F.col("value")), F.coalesce(iso_day_text(F.col("value")), F.substring("value", 1, 10))
    distinct = values.groupBy(F.col("column").alias("name")).agg(
        F.count("*").alias("u_text"), F.countDistinct(number).alias("u_numbers"), F.countDistinct(day).alias("u_days"))
    measured = _rows(df, cells).join(distinct, "name", "left")
    return measured.fillna(0, ["u_text", "u_numbers", "u_days"]).select(*_chart_columns())


def _chart_columns() -> list[Column]:
    c = F.col
    is_date = (c("present") > 0) & (c("n_days") >= CHART_DATE_SHARE * c("present"))
    is_number = ~is_date & (c("n_numbers") > 0) & (c("n_numbers") >= F.greatest(F.lit(3.0), c("n_rows") * 0.1))
    id_name = F.trim("name").rlike(ID_NAME)
    integral = c("n_fractional") == 0
    sequence = integral & (c("u_numbers") >= 20) & (c("u_numbers") == c("n_numbers")) & (
        c("max") - c("min") + 1 <= 1.1 * c("u_numbers"))
    year = is_number & ~id_name & ~sequence & integral & (c("min") >= 1900) & (c("max") <= 2100) & (
        F.trim("name").rlike(YEAR_NAME) | (c("u_numbers") <= 60))
    mostly_unique = (c("present") >= 20) & (c("u_text") >= 0.9 * c("present"))
    all_unique = (c("present") >= 2) & (c("u_text") == c("present"))
    text_role = F.when(id_name, "identifier").when((c("n_rows") <= 50) & all_unique, "label").when(
        mostly_unique, "identifier").otherwise("dimension")
    spread = is_number & ~year
    return [
        c("name"),
        F.when(is_date, "datetime").when(spread, "numeric").otherwise("categorical").alias("dtype"),
        F.when(is_date, "time").when(year, "dimension").when(
            is_number, F.when(id_name | sequence, "identifier").otherwise("measure")).otherwise(text_role).alias("role"),
        year.alias("is_year"),
        ((c("n_rows") - c("present")) / F.greatest(c("n_rows"), F.lit(1))).alias("missing_ratio"),
        F.when(is_date, c("u_days")).when(is_number, c("u_numbers")).otherwise(
            c("u_text") + c("any_missing")).alias("n_unique"),
        *[F.when(spread, c(s)).alias(s) for s in ("min", "max", "mean", "std")],
        F.when(spread, F.when((c("n_numbers") > 2) & (c("std") > 0), c("skewness")).otherwise(0.0)).alias("skewness"),
    ]


def full_numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact statistics over all rows, missing words excluded, population deviation."""
    cells, prepared = [], df
    for c in columns:
        prepared = prepared.withColumn(c, as_double(df, c))
    for c in columns:
        x = F.col(c)
        cells.append(F.struct(
            F.lit(c).alias("name"), F.round(100.0 * (F.count("*") - F.count(x)) / F.count("*"), 2).alias("missing_pct"),
            F.countDistinct(x).alias("n_unique"), F.min(x).alias("min"), F.max(x).alias("max"),
            F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
            F.when((F.count(x) > 2) & (F.stddev_pop(x) > 0), F.skewness(x)).otherwise(0.0).alias("skewness")))
    medians = _quartiles(prepared, list(columns)).select("name", "median")
    return _rows(prepared, cells).join(medians, "name")


def full_text_stats(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """Top values per column with their share of the present rows."""
    present = df.select(*[F.when(~is_missing_word(F.col(c)), F.col(c).cast("string")).alias(c) for c in columns])
    counts = value_counts(present, columns)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count("*").alias("n_unique"))
    best = top_per_group(counts, ["column"], [F.desc("n"), F.asc("value")], top)
    return best.join(totals, "column").select(
        "column", "position", "value", F.col("n").alias("count"),
        F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"), "n_unique")


def feature_ranking(chart: DataFrame) -> DataFrame:
    """Variance for numbers, card·ln(card) for categories, each scaled to its kind's best; ids and dates score 0."""
    other = (F.col("role") == "identifier") | (F.col("dtype") == "datetime")
    group = F.when(other, "other").when(F.col("dtype") == "numeric", "numeric").otherwise("categorical")
    raw = F.when(group == "numeric", F.col("std") * F.col("std")).when(
        (group == "categorical") & (F.col("n_unique") > 1), F.col("n_unique") * F.log(F.col("n_unique").cast("double"))
    ).otherwise(0.0)
    scored = chart.select("name", group.alias("kind"), raw.alias("raw"))
    best = F.max("raw").over(Window.partitionBy("kind"))
    return scored.select("name", F.when(best > 0, F.col("raw") / best).otherwise(0.0).alias("score"))


def bias_issues(df: DataFrame, chart: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Constant columns, more than 40% missing, and up to three values with one above 95%."""
    text = df.select(*[F.when(~is_missing_word(F.col(c)), F.col(c).cast("string")).alias(c) for c in columns])
    counts = value_counts(text, columns)
    shares = counts.groupBy(F.col("column").alias("name")).agg((F.max("n") / F.sum("n")).alias("top_share"))
    kinds = F.array_compact(F.array(
        F.when(F.col("n_unique") <= 1, "constant"), F.when(F.col("missing_ratio") > 0.4, "missing"),
        F.when((F.col("dtype") == "categorical") & (F.col("n_unique") <= 3) & (F.col("top_share") > 0.95), "imbalance")))
    joined = chart.where(F.col("name").isin(*columns)).join(shares, "name", "left")
    return joined.select(F.col("name").alias("column"), F.explode(kinds).alias("type"))


def dataset_summary(df: DataFrame, chart: DataFrame) -> DataFrame:
    """Findings about the columns: mostly empty ones, strong pairs of measures, heavy skew."""
    is_measure = (F.col("dtype") == "numeric") & (F.col("role") == "measure") & ~(
        (F.col("n_unique") == 2) & (F.col("min") == 0) & (F.col("max") == 1))
    measures = [r["name"] for r in chart.where(is_measure).orderBy("missing_ratio", "name").select("name").collect()]
    empty = chart.where(F.col("missing_ratio") > 0.2).select(
        F.lit("mostly_empty").alias("finding"), F.col("name").alias("subject"), F.col("missing_ratio").alias("value"))
    skewed = chart.where(is_measure & (F.abs("skewness") >= 2)).select(
        F.lit("heavy_skew").alias("finding"), F.col("name").alias("subject"), F.col("skewness").alias("value"))
    out = empty.unionByName(skewed)
    if len(measures) >= 2:
        pairs = correlation_pairs(df, measures).where((F.abs("r") >= 0.5) & (F.abs("r") < 0.98))
        out = out.unionByName(pairs.select(
            F.lit("strong_pair").alias("finding"), F.concat_ws(" ~ ", "left", "right").alias("subject"),
            F.col("r").alias("value")))
    return out


def redundant_measures(df: DataFrame, by_importance: Sequence[str], threshold: float = 0.98) -> list[tuple[str, str, float]]:
    """(column, kept twin, r) for measures that copy an earlier, more important one. Reads one row per column pair."""
    pairs = correlation_pairs(df, by_importance).where(F.abs("r") >= threshold).collect()
    r = {frozenset((p["left"], p["right"])): p["r"] for p in pairs}
    kept, dropped = [], []
    for c in by_importance:
        twin = next((k for k in kept if frozenset((k, c)) in r), None)
        if twin is None:
            kept.append(c)
        else:
            dropped.append((c, twin, r[frozenset((twin, c))]))
    return dropped


def mirror_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns whose value counts repeat an earlier column's: equal digests of the sorted counts.

    The signature is a histogram of the counts (count → how many values have it), digested per column, so no list of a
    column's values is ever built.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    sizes = value_counts(df, columns).groupBy("column", "n").agg(F.count("*").alias("m"))
    sums = sizes.groupBy("column").agg(
        F.sum("m").alias("values"), F.sum(F.xxhash64("n", "m").cast("decimal(38,0)")).alias("digest"),
        F.sum(F.xxhash64(F.lit("b"), "m", "n").cast("decimal(38,0)")).alias("digest2"))
    w = Window.partitionBy("values", "digest", "digest2").orderBy("_o")
    ranked = sums.where(F.col("values") >= 2).withColumn("_o", order).withColumn("same_as", F.first("column").over(w))
    return ranked.where(F.col("same_as") != F.col("column")).select("column", "same_as")


def chart_importance(charts: DataFrame) -> DataFrame:
    """0–100 from (kind, r, n, rank, from_domain): kinds are missing, rate, scatter, histogram, trend, measure, count."""
    base = (
        F.when(F.col("kind") == "missing", 35.0).when(F.col("kind") == "rate", 85.0)
        .when(F.col("kind") == "scatter", 55.0 + 30.0 * F.least(F.abs(F.coalesce("r", F.lit(0.0))), F.lit(1.0)))
        .when(F.col("kind") == "histogram", 60.0).when(F.col("kind").isin("trend", "measure"), 70.0).otherwise(50.0))
    score = base + F.when(F.col("from_domain"), 5).otherwise(0) - 3 * F.greatest(F.col("rank") - 1, F.lit(0))
    score = score - F.when(F.col("n") < 10, 20).when(F.col("n") < 30, 10).otherwise(0)
    return charts.withColumn("importance", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(score))).cast("int"))


def structural_null_table(df: DataFrame, column: str, condition: Column) -> DataFrame:
    """2×2 counts: is the value missing × does the condition hold."""
    cells = df.groupBy(F.col(column).isNull().alias("is_missing"), condition.alias("condition"))
    return cells.agg(F.count("*").alias("n"))


def quality_table(df: DataFrame, date_pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Tidy report: one row per column and a ``(dataset)`` row, every issue the result of a check that found something."""
    columns = df.columns
    profiled = profile(df).select(
        F.col("name").alias("column"), "dtype", (F.col("n_rows") - F.col("missing")).alias("non_null"), "missing",
        F.round(F.col("missing") / F.greatest(F.col("n_rows"), F.lit(1)) * 100, 4).alias("missing_pct"),
        F.col("n_unique").alias("unique"), "mean", "std", "min", "p25", "median", "p75", "max", "n_outliers")
    cells = []
    for c in columns:
        none = F.lit(None).cast("bigint")
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        negatives = F.count_if(F.col(c) < 0) if numeric and _matches(c, NON_NEGATIVE_NAME) else none
        text = F.trim(F.col(c).cast("string"))
        odd = (text != F.lower(text)) & (text != F.upper(text)) & (text != F.initcap(F.lower(text)))
        is_text = c in text_columns(df)
        odd_names = F.count_if(odd) if is_text and _matches(c, PERSON_NAME) else none
        cells.append(F.struct(F.lit(c).alias("column"), negatives.alias("negatives"), odd_names.alias("odd_names")))
    found = profiled.join(_rows(df, cells), "column")
    texts = text_columns(df)
    if texts:
        folded = value_counts(df, texts).groupBy("column").agg(
            (F.count("*") - F.countDistinct(F.lower(F.trim("value")))).alias("collapsing"))
        found = found.join(folded, "column", "left")
    else:
        found = found.withColumn("collapsing", F.lit(None).cast("bigint"))
    def told(c, words):
        return F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(words)))

    issues = F.concat_ws(
        "; ", told("missing", " missing values"), told("negatives", " negative values"),
        told("odd_names", " inconsistently capitalised names"),
        told("collapsing", " values differ only by case or spaces"), told("n_outliers", " IQR outliers"))
    per_column = found.withColumn("issues", issues).drop("n_outliers", "negatives", "odd_names", "collapsing")
    dup = duplicate_rows(df)
    late = [
        F.when(df.agg(F.count_if(F.col(e) < F.col(s))).scalar() > 0, F.concat(
            df.agg(F.count_if(F.col(e) < F.col(s))).scalar().cast("string"), F.lit(f" rows with {e} before {s}")))
        for s, e in date_pairs
    ]
    dup_words = F.when(F.col("duplicates") > 0, F.concat(
        F.col("duplicates").cast("string"), F.lit(" exact duplicate rows")))
    total = dup.select(
        F.lit("(dataset)").alias("column"), F.lit("").alias("dtype"), F.col("n_rows").alias("non_null"),
        *[F.lit(None).cast(per_column.schema[c].dataType).alias(c) for c in
          "missing missing_pct unique mean std min p25 median p75 max".split()],
        F.concat_ws("; ", dup_words, *late).alias("issues"))
    return per_column.unionByName(total)


def _matches(name: str, pattern: str) -> bool:
    import re

    return re.search(pattern, name) is not None


def check_contract(result: DataFrame, source: DataFrame, contract: dict) -> DataFrame:
    """Violated postconditions of a result as (kind, column, found) rows.

    ``contract``: ``columns`` {name: {dtype, min, max}}, ``row_relation`` {type, group_by, n}, ``unique_key``,
    ``not_null``, ``kind``. Names match without regard to case.
    """
    spark = result.sparkSession
    by_lower = {c.lower(): c for c in result.columns}
    static: list[tuple[str, str, float]] = []
    aggs: list[Column] = [F.count("*").alias("n_rows")]
    tests: list[tuple[str, str, Column]] = []
    for name, spec in contract.get("columns", {}).items():
        actual = by_lower.get(name.lower())
        if actual is None:
            static.append(("missing_column", name, 1.0))
            continue
        kind = kind_of(result.schema[actual])
        if spec.get("dtype") in ("numeric", "datetime") and kind != spec["dtype"]:
            static.append(("wrong_dtype", actual, 1.0))
            continue
        for bound, agg in (("min", F.min), ("max", F.max)):
            if kind == "numeric" and spec.get(bound) is not None:
                label = f"{bound}_{len(aggs)}"
                aggs.append(agg(actual).cast("double").alias(label))
                off = F.col(label) < spec[bound] - 1e-9 if bound == "min" else F.col(label) > spec[bound] + 1e-9
                tests.append(("out_of_range", actual, F.when(off, F.col(label))))
    for name in contract.get("not_null", ()):
        actual = by_lower.get(name.lower())
        if actual:
            label = f"nulls_{len(aggs)}"
            aggs.append((F.count("*") - F.count(actual)).alias(label))
            tests.append(("unexpected_nulls", actual, F.when(F.col(label) > 0, F.col(label).cast("double"))))
    relation = contract.get("row_relation", {})
    groups = [by_lower.get(g.lower(), "") for g in relation.get("group_by", ())]
    measured = result.agg(*aggs)
    n, kind, limit = F.col("n_rows"), relation.get("type"), relation.get("n")
    rows_in = source.agg(F.count("*")).scalar()
    if kind == "one_per_group" and all(groups):
        repeats = result.groupBy(*groups).count().agg(F.sum(F.col("count") - 1)).scalar()
        tests.append(("duplicate_group_rows", ",".join(groups), F.when(repeats > 0, repeats.cast("double"))))
        if all(g in source.columns for g in relation["group_by"]):
            n_groups = source.select(*relation["group_by"]).distinct().agg(F.count("*")).scalar()
            tests.append(("not_aggregated", ",".join(groups), F.when(n > n_groups, n.cast("double"))))
        else:
            tests.append(("not_aggregated", ",".join(groups), F.when(n >= rows_in, n.cast("double"))))
    elif kind == "one_per_group":
        static.append(("missing_group_key", ",".join(relation["group_by"]), 1.0))
    simple = {
        "same_as_input": ("row_count_changed", n != rows_in), "fewer_than_input": ("not_reduced", n > rows_in),
        "at_most": ("too_many_rows", n > F.lit(limit)), "exactly": ("wrong_row_count", n != F.lit(limit)),
    }
    if kind in simple:
        tests.append((simple[kind][0], "", F.when(simple[kind][1], n.cast("double"))))
    if contract.get("kind") == "scalar":
        tests.append(("not_scalar", "", F.when(n != 1, n.cast("double"))))
    key = [by_lower.get(k.lower()) for k in contract.get("unique_key", ())]
    if key and all(key):
        repeats = result.groupBy(*key).count().agg(F.sum(F.col("count") - 1)).scalar()
        tests.append(("key_not_unique", ",".join(key), F.when(repeats > 0, repeats.cast("double"))))
    cells = [F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column"), v.alias("found")) for k, c, v in tests]
    schema = "kind string, column string, found double"
    out = spark.createDataFrame(static, schema)
    if cells:
        out = out.unionByName(measured.select(F.inline(F.array(*cells))).where(F.col("found").isNotNull()))
    return out


def observations(profiled: DataFrame, pairs: DataFrame) -> DataFrame:
    """Measured remarks: the strongest pair, the dominant segment, skew with outliers, gaps, identifiers."""
    first = Window.partitionBy("remark").orderBy("name")
    top = F.element_at("top_values", 1)
    dominant = profiled.where("role = 'categorical'").select(
        F.lit("dominant_segment").alias("remark"), "name", (top["count"] / F.col("n_rows")).alias("value"))
    skewed = profiled.where(F.abs("skew") > 1.5).select(
        F.lit("skewed").alias("remark"), "name", F.col("skew").alias("value"))
    gaps = profiled.where(F.col("missing_pct") >= HIGH_MISSING).select(
        F.lit("high_missing").alias("remark"), "name", F.col("missing_pct").alias("value"))
    ids = profiled.where("role = 'id'").select(
        F.lit("identifier").alias("remark"), "name", F.col("unique_pct").alias("value"))
    one_each = dominant.unionByName(skewed).withColumn("_i", F.row_number().over(first)).where("_i = 1").drop("_i")
    strongest = pairs.orderBy(F.desc(F.abs("r")), "left", "right").limit(1).where(F.abs("r") >= 0.5).select(
        F.lit("strongest_pair").alias("remark"), F.concat_ws(" ~ ", "left", "right").alias("name"),
        F.col("r").alias("value"))
    return one_each.unionByName(gaps).unionByName(ids).unionByName(strongest)


def next_steps(profiled: DataFrame) -> DataFrame:
    """Columns to work on next: a two-valued outcome, a time axis, a measure and a breakdown."""
    is_outcome = F.col("role").isin("numeric", "boolean") & (F.col("n_unique") == 2)
    step = F.when(is_outcome, "model_target").when(F.col("role") == "datetime", "time_axis").when(
        F.col("role") == "numeric", "measure").when(F.col("role") == "categorical", "breakdown")
    w = Window.partitionBy("step").orderBy("name")
    ranked = profiled.select(step.alias("step"), "name").where("step is not null").withColumn("_i", F.row_number().over(w))
    return ranked.where("_i = 1").select("step", F.col("name").alias("column"))
