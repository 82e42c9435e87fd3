"""Goal-style aggregation: summaries, group comparisons, trends, correlations and their mergeable forms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.windows import _join_back, percentiles, quantiles, top_per_group

EXPRESSIONS_PER_PASS = 400


def pearson(a: Column | str, b: Column | str) -> Column:
    """Pearson r over rows holding both values; null without spread (``corr`` fails there in ANSI mode)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = (c.cast("double") for c in (a, b))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def metric(operation: str, column: str | Column | None) -> Column:
    """One of the metric vocabulary as an aggregate column. ``std`` is the sample form."""
    if operation == "count" and column is None:
        return F.count("*")
    c = F.col(column) if isinstance(column, str) else column
    vocabulary = {
        "mean": F.avg, "median": F.median, "sum": F.sum, "count": F.count, "count_distinct": F.countDistinct,
        "min": F.min, "max": F.max, "std": F.stddev_samp,
    }
    if operation == "range":
        return F.max(c) - F.min(c)
    if operation not in vocabulary:
        raise ValueError(f"unknown metric {operation!r}")
    return vocabulary[operation](c)


def column_summary(df: DataFrame, columns: Sequence[str], metrics: Sequence[str] = ("mean", "median")) -> DataFrame:
    """One row per column: non-null count and the asked statistics, 6 decimals. One pass except for the median."""
    plain = [m for m in metrics if m != "median"]
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        fields = [F.count(x).alias("non_null")]
        fields += [
            (F.count(x) if m == "count" else F.round(metric(m, x), 6)).cast("double").alias(m) for m in plain
        ]
        aggs.append(F.struct(F.lit(c).alias("column"), *fields))
    rows = df.agg(F.array(*aggs).alias("rows")).select(F.inline("rows"))
    if "median" not in metrics:
        return rows
    medians = df.sparkSession.createDataFrame(
        [(c, v[0]) for c, v in quantiles(df.select(*columns), columns, [0.5]).items()], "column string, median double")
    return rows.join(medians.withColumn("median", F.round("median", 6)), "column", "left").select("column", "non_null", *metrics)


def group_comparison(
    df: DataFrame, group: str, measure: str | None = None, how: str = "mean", top: int = 10
) -> DataFrame:
    """Top groups by sum or mean of a measure, or by row count without one.

    The null group takes part in the cut but is not shown, so ``top - 1`` rows are possible.
    """
    if measure is None:
        value = F.count("*").cast("double")
    else:
        value = metric(how, measure).cast("double")
    ranked = df.groupBy(group).agg(value.alias("value")).orderBy(F.desc_nulls_last("value"), F.asc_nulls_first(group))
    shown = ranked.limit(top).where(F.col(group).isNotNull() & F.col("value").isNotNull())
    return shown.select(F.col(group).cast("string").alias("group"), F.round("value", 6).alias("value"))


def grouped_metrics(df: DataFrame, by: Sequence[str], metrics: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Named metrics per group; null groups are kept.

    Everything that merges is ONE aggregation. Medians and distinct counts need all values of a group: they are counted
    on their own, by rank and by (group, value), so that no buffer holds a group, and joined to the rest by the key.
    """
    alone = {n: m for n, m in metrics.items() if m[0] in ("median", "count_distinct")}
    aggs = [metric(op, column).alias(name) for name, (op, column) in metrics.items() if name not in alone]
    if not by:
        out = df.agg(*(aggs or [F.count("*").alias("_rows")]))
    else:
        out = df.groupBy(*by).agg(*(aggs or [F.count("*").alias("_rows")]))
    for name, (op, column) in alone.items():
        if op == "median":
            one = percentiles(df, column, {name: 0.5}, by).drop("n")
        else:
            one = df.select(*by, column).where(F.col(column).isNotNull()).distinct().groupBy(*by).agg(F.count("*").alias(name))
        out = _join_back(out, one, by) if by else out.withColumn(name, one.select(name).scalar())
        if op == "count_distinct":
            out = out.fillna(0, [name])
    return out.select(*by, *metrics)


def run_metric_actions(df: DataFrame, actions: Sequence[dict]) -> tuple[dict[tuple[str, ...], DataFrame], list[dict]]:
    """Independent metric requests, fused to one aggregation per grouping; invalid ones are reported, not fatal.

    An action is ``{"name", "operation", "column", "group_by"}``.
    """
    by_group: dict[tuple[str, ...], dict] = {}
    rejected = []
    types = dict(df.dtypes)
    for a in actions:
        keys = tuple(a.get("group_by") or ())
        column = a.get("column")
        unknown = [c for c in (*keys, *([column] if column else [])) if c not in types]
        needs_number = a["operation"] in {"mean", "median", "sum", "min", "max", "std"}
        if unknown:
            rejected.append({"name": a["name"], "reason": f"no column {', '.join(unknown)}"})
        elif column is None and a["operation"] != "count":
            rejected.append({"name": a["name"], "reason": f"{a['operation']} needs a column"})
        elif needs_number and not isinstance(df.schema[column].dataType, T.NumericType):
            rejected.append({"name": a["name"], "reason": f"{column} is not numeric"})
        else:
            by_group.setdefault(keys, {})[a["name"]] = (a["operation"], column)
    return {k: grouped_metrics(df, k, m) for k, m in by_group.items()}, rejected


def suffixed_aggregate(df: DataFrame, by: Sequence[str], columns: Sequence[str], functions: Sequence[str]) -> DataFrame:
    """``column_function`` names; a key that is also a measure leaves the keys, and null keys leave the result."""
    keys = [k for k in by if k not in columns] or text_columns(df)[:2]
    known = df.dropna(subset=keys)
    return known.groupBy(*keys).agg(*[metric(f, c).alias(f"{c}_{f}") for c in columns for f in functions])


def aggregate_and_flag(df: DataFrame, by: Sequence[str], measure: str, above: float) -> DataFrame:
    """Rows joined to their group's mean and flagged when they exceed ``above`` times that mean."""
    means = df.groupBy(*by).agg(F.avg(measure).alias("group_mean"))
    return df.join(means, list(by), "left").withColumn("is_high", F.col(measure) > F.col("group_mean") * above)


def monthly_trend(df: DataFrame, time: str, measure: str | None = None, how: str = "mean") -> DataFrame:
    """One row per calendar month with a value; rows without a month or a value are left out."""
    period = F.date_format(F.date_trunc("month", F.col(time)), "yyyy-MM")
    x = F.lit(1.0) if measure is None else F.col(measure).cast("double")
    rows = df.select(period.alias("period"), x.alias("value")).dropna()
    agg = F.sum if measure is None or how == "sum" else F.avg
    return rows.groupBy("period").agg(agg("value").alias("value"))


def trend_change(monthly: DataFrame) -> DataFrame:
    """First and last month of a trend and the change between them."""
    ends = monthly.agg(
        F.min("period").alias("first_period"), F.min_by("value", "period").alias("first_value"),
        F.max("period").alias("last_period"), F.max_by("value", "period").alias("last_value"),
        F.count("*").alias("n_months"),
    )
    return ends.withColumn("change", F.col("last_value") - F.col("first_value"))


def missingness(df: DataFrame, columns: Sequence[str] | None = None, worst: int = 10) -> DataFrame:
    """Missing count and share per column, worst first; one pass over the table."""
    columns = columns or df.columns
    counted = [
        F.struct(F.lit(c).alias("column"), (F.count("*") - F.count(F.col(c))).alias("missing"),
                 F.count("*").alias("n_rows"))
        for c in columns
    ]
    rows = df.agg(F.array(*counted).alias("r")).select(F.inline("r"))
    pct = F.when(F.col("n_rows") > 0, F.round(F.col("missing") / F.col("n_rows") * 100, 6)).otherwise(F.lit(0.0))
    return rows.select("column", "missing", pct.alias("missing_pct")).orderBy(F.desc("missing"), "column").limit(worst)


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None) -> DataFrame:
    """Pearson r for every column pair (or every column against ``target``) over rows that hold both values.

    All pairs share one pass; above ``EXPRESSIONS_PER_PASS`` pairs the work is split so generated code stays small.
    """
    columns = list(columns or numeric_columns(df))
    if target is not None:
        pairs = [(c, target) for c in columns if c != target]
    else:
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    out = None
    for at in range(0, len(pairs), EXPRESSIONS_PER_PASS):
        part = pairs[at:at + EXPRESSIONS_PER_PASS]
        cells = [
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"),
                     pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"))
            for a, b in part
        ]
        rows = df.agg(F.array(*cells).alias("p")).select(F.inline("p"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("a correlation needs at least two numeric columns")
    return out.where(F.col("r").isNotNull() & ~F.isnan("r"))


def strongest_pairs(df: DataFrame, columns: Sequence[str] | None = None, top: int = 5) -> DataFrame:
    pairs = correlation_pairs(df, columns).withColumn("r", F.round("r", 6))
    return pairs.orderBy(F.desc(F.abs("r")), "left", "right").limit(top)


def flagged_pairs(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.9, top: int = 15):
    """Pairs at or above ``threshold`` if there are any, else all pairs; strongest first."""
    pairs = correlation_pairs(df, columns).select("left", "right", F.round(F.abs("r"), 4).alias("corr"))
    any_flagged = pairs.agg(F.max("corr")).scalar() >= threshold
    kept = pairs.where(~any_flagged | (F.col("corr") >= threshold))
    return kept.orderBy(F.desc("corr"), "left", "right").limit(top)


def target_scan(df: DataFrame, target: str, columns: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    pairs = correlation_pairs(df, columns, target).select(F.col("left").alias("column"), F.round("r", 6).alias("r"))
    return pairs.orderBy(F.desc(F.abs("r")), "column").limit(top)


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence, measure: str, how: str = "sum") -> DataFrame:
    """Pivot with the column values given, so no extra job discovers them; the measure must be numeric."""
    if not isinstance(df.schema[measure].dataType, T.NumericType) and how not in ("count", "count_distinct"):
        raise ValueError(f"{how} of {measure} is undefined: it holds {df.schema[measure].dataType.simpleString()}")
    return df.groupBy(rows).pivot(columns, list(values)).agg(metric(how, measure))


def long_form(df: DataFrame, ids: Sequence[str], values: Sequence[str], name="variable", value="value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def heatmap(df: DataFrame, time: str, measure: str | None = None) -> DataFrame:
    """Counts (and means) per weekday, Monday = 0, and hour."""
    cells = df.groupBy(F.weekday(time).alias("weekday"), F.hour(time).alias("hour"))
    aggs = [F.count("*").alias("n")] + ([F.avg(measure).alias("mean")] if measure else [])
    return cells.agg(*aggs)


def shrunk_ranking(df: DataFrame, entity: str, rating: str, minimum: int) -> DataFrame:
    """Rank by a mean pulled towards the overall mean: v/(v+m)·R + m/(v+m)·C; entities below ``minimum`` leave."""
    per = df.where(F.col(rating).isNotNull()).groupBy(entity).agg(
        F.count("*").alias("votes"), F.avg(rating).alias("rating"))
    overall = df.agg(F.avg(rating)).scalar()
    m = F.lit(float(minimum))
    score = F.col("votes") / (F.col("votes") + m) * F.col("rating") + m / (F.col("votes") + m) * overall
    return per.withColumn("score", score).where(F.col("votes") >= minimum)


def rate_difference(df: DataFrame, group: str, outcome: str, first, second) -> DataFrame:
    """Two-proportion z test of a 0/1 outcome, two-sided p-value from the normal tail."""
    g, y = F.col(group), F.col(outcome)
    sums = df.agg(
        *[F.count(F.when(g == v, y)).cast("double").alias(f"n{i}") for i, v in ((1, first), (2, second))],
        *[F.sum(F.when(g == v, y)).cast("double").alias(f"k{i}") for i, v in ((1, first), (2, second))],
    )
    pooled = (F.col("k1") + F.col("k2")) / (F.col("n1") + F.col("n2"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n1") + 1 / F.col("n2")))
    z = (F.col("k1") / F.col("n1") - F.col("k2") / F.col("n2")) / se
    return sums.select(
        (F.col("k1") / F.col("n1")).alias("rate1"), (F.col("k2") / F.col("n2")).alias("rate2"), z.alias("z")
    ).withColumn("p_value", normal_two_sided(F.col("z")))


def normal_two_sided(z: Column) -> Column:
    """2·(1 − Φ(|z|)) by the rational approximation of the error function (absolute error below 1.5e-7)."""
    # Abramowitz and Stegun 7.1.26.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + p * x)
    poly = F.lit(0.0)
    for coefficient in reversed(a):
        poly = (poly + coefficient) * t
    return poly * F.exp(-x * x)


def mean_difference(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """Welch's t statistic and degrees of freedom for two group means, from one pass of moments."""
    g = F.col(group)
    parts = []
    for i, v in ((1, first), (2, second)):
        x = F.when(g == v, F.col(value))
        parts += [F.avg(x).alias(f"m{i}"), F.var_samp(x).alias(f"v{i}"), F.count(x).cast("double").alias(f"n{i}")]
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    dof = (e1 + e2) ** 2 / (e1 ** 2 / (F.col("n1") - 1) + e2 ** 2 / (F.col("n2") - 1))
    t = (F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)
    return df.agg(*parts).select("m1", "m2", t.alias("t"), dof.alias("dof")).withColumn(
        "p_value", normal_two_sided(F.col("t")))


def daily_volatility(df: DataFrame, item: str, time: str, measure: str, top: int) -> DataFrame:
    """Sample standard deviation of an item's daily totals, most volatile first."""
    daily = df.groupBy(item, F.to_date(time).alias("day")).agg(F.sum(measure).alias("total"))
    out = daily.groupBy(item).agg(F.count("*").alias("n_days"), F.stddev_samp("total").alias("volatility"))
    return out.where(F.col("volatility").isNotNull()).orderBy(F.desc(F.round("volatility", 6)), item).limit(top)


def predicate_counts(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    cells = [F.struct(F.lit(n).alias("check"), F.count_if(p).alias("n")) for n, p in predicates.items()]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def exact_profile(df: DataFrame, columns: Sequence[str] | None = None, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Numeric moments and top text values over all rows.

    Spark merges the partial sums itself, so the numbers do not depend on how the table is split. Returns the numeric
    rows and the ``top`` exact value counts per text column.
    """
    columns = columns or df.columns
    numbers = [c for c in numeric_columns(df) if c in columns]
    texts = [c for c in text_columns(df) if c in columns]
    cells = []
    for c in numbers:
        x = F.col(c).cast("double")
        n = F.count(x)
        cells.append(F.struct(
            F.lit(c).alias("column"), (F.count("*") - n).alias("missing"), n.alias("count"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.avg(x), 6).alias("mean"),
            F.round(F.stddev_pop(x), 6).alias("std")))
    numeric = df.agg(F.array(*cells).alias("r")).select(F.inline("r")) if cells else None
    return numeric, top_values(df, texts, top) if texts else None


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for the non-null text form of each column; combined map-side before the shuffle.

    Whole and floating numbers are grouped as numbers and only their distinct values are turned into text.
    """
    kinds: dict[str, list[str]] = {}
    for c in columns:
        t = df.schema[c].dataType
        kind = "bigint" if isinstance(t, T.IntegralType) else "double" if isinstance(t, T.DoubleType) else "string"
        kinds.setdefault(kind, []).append(c)
    out = None
    for kind, names in kinds.items():
        long = df.select(*[F.col(c).cast(kind).alias(c) for c in names]).unpivot([], names, "column", "value")
        counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
        counts = counts.select("column", F.col("value").cast("string").alias("value"), "n")
        out = counts if out is None else out.unionByName(counts)
    return out


def top_values(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    return top_per_group(value_counts(df, columns), ["column"], [F.desc("n"), F.asc("value")], top)


# Severity order and the metrics where less is better.
VERDICTS = ("pass", "warn", "fail")
LOWER_IS_BETTER = ("rmse", "mae")


def merge_verdicts(shards: DataFrame, verdict: str = "verdict") -> DataFrame:
    """The worst shard decides."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, VERDICTS)), F.col(verdict)) - 1, F.lit(0))
    worst = F.greatest(F.max(rank), F.lit(0)).cast("int")
    return shards.agg(F.element_at(F.array(*map(F.lit, VERDICTS)), worst + 1).alias("verdict"))


def best_model(shards: DataFrame, metric_name: str, score: str = "score", shard: str = "shard") -> DataFrame:
    """Best scored shard, smallest shard number on ties."""
    scored = shards.where(F.col(score).isNotNull())
    sign = 1 if metric_name.lower() in LOWER_IS_BETTER else -1
    key = F.struct((F.col(score) * sign).alias("s"), F.col(shard).alias("i"))
    return scored.agg(
        F.min_by(shard, key).alias("from_shard"), F.min_by(score, key).alias("score"),
        F.count("*").alias("candidates_considered"))


def top_groups_with_first(df: DataFrame, group: str, carry: Sequence[str], order: str, top: int) -> DataFrame:
    """Largest groups by rows, with other columns taken from each group's first row in ``order``."""
    known = df.where(F.col(group).isNotNull())
    per = known.groupBy(group).agg(F.count("*").alias("n"), *[F.min_by(c, order).alias(c) for c in carry])
    return per.orderBy(F.desc("n"), group).limit(top)


def value_index(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Lower-cased cell value → the text columns that hold it."""
    columns = columns or text_columns(df)
    cells = df.select(*columns).unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull())
    cells = cells.select(F.lower(F.trim("value")).alias("value"), "column").where(F.col("value") != "").distinct()
    return cells.groupBy("value").agg(F.array_join(F.array_sort(F.collect_list("column")), ",").alias("columns"))


def with_scope(df: DataFrame, rows_used: DataFrame, total_rows: int) -> DataFrame:
    """Attach what an answer was computed on: rows used, rows in all, ``all`` or ``sample``."""
    used = rows_used.agg(F.count("*")).scalar()
    return df.withColumn("rows_used", used).withColumn("rows_total", F.lit(total_rows).cast("bigint")).withColumn(
        "scope", F.when(used < total_rows, "sample").otherwise("all"))
