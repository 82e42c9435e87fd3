"""Samples, weights, holdouts and shards. Draws are ordered by a key's digest, so they repeat on any cluster."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.aggregates import text_columns
from millrace.operators.windows import _join_back, percentiles, row_numbers, value_at_rank
from millrace.session import cut_lineage

# Sampling thresholds.
SAMPLE_ABOVE_ROWS = 100_000
SAMPLE_ROWS = 50_000
MAX_STRATA = 50
LOW_CARDINALITY = 20
MEDIUM_CARDINALITY = 100
SPARSE_GROUP_ROWS = 1000
#: Rows of one group and digest prefix that one task may sort, and the digits that a digest has.
CELL_ROWS = 1_000_000
DIGEST_DIGITS = 32
MISSING_WORDS = ("", "na", "nan", "null", "none")


def digest(*keys: str) -> Column:
    """Hex digest of the key columns, evenly spread and the same in every engine."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def digest_fraction(*keys: str) -> Column:
    """The digest as a number in [0, 1)."""
    return F.conv(F.substring(digest(*keys), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def random_sample(df: DataFrame, key: Sequence[str], rows: int = SAMPLE_ROWS, above: int = SAMPLE_ABOVE_ROWS) -> DataFrame:
    """The whole table up to ``above`` rows, else about ``rows`` of them. A map-side filter: no shuffle."""
    total = df.count()
    return df if total <= above else df.where(digest_fraction(*key) < rows / total)


def exact_sample(df: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """Exactly ``rows`` rows in random (digest) order."""
    return df.orderBy(digest(*key), *key).limit(rows)


def take_by_digest(df: DataFrame, by: Sequence[str], quotas: DataFrame, key: Sequence[str], cell_rows: int = CELL_ROWS) -> DataFrame:
    """From every group the ``_quota`` rows with the smallest digests.

    Counting per (group, digest prefix) shows which prefixes are taken whole and which single one holds the cut; only
    that one is sorted. Where the cut prefix of some group holds more than ``cell_rows`` rows, the rows of the cut prefixes are counted
    again by a prefix three digits longer, until what is sorted is small. A group with most of the table is therefore
    spread over all tasks whatever its size and quota. Rows of equal digest and key are one cell at most.
    """
    rows, quotas = df.withColumn("_h", digest(*key)), quotas.withColumnRenamed("_quota", "_left")
    taken = []
    for depth in range(1, DIGEST_DIGITS // 3 + 1):
        rows = rows.withColumn("_p", F.substring("_h", 1, 3 * depth))
        earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy(*by, "_p").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
        plan = _join_back(counts, quotas, by, "inner").withColumn("_left", F.col("_left") - F.col("_before")).where("_left > 0")
        plan = cut_lineage(plan.select(*by, "_p", "_c", "_left", (F.col("_c") <= F.col("_left")).alias("_whole")))
        marked = _join_back(rows, plan.select(*by, "_p", "_left", "_whole"), [*by, "_p"], "inner")
        taken.append(marked.where("_whole").select(*df.columns))
        largest = plan.where("NOT _whole").agg(F.max("_c")).first()[0] or 0
        if largest <= cell_rows or depth == DIGEST_DIGITS // 3:
            break
        rows, quotas = marked.where("NOT _whole").drop("_p", "_left", "_whole"), plan.where("NOT _whole").select(*by, "_left")
    cut = Window.partitionBy(*by, "_p").orderBy("_h", *key)
    partial = marked.where("NOT _whole").withColumn("_i", F.row_number().over(cut)).where(F.col("_i") <= F.col("_left"))
    return reduce(DataFrame.unionByName, [*taken, partial.select(*df.columns)])


def stratified_fraction(df: DataFrame, stratum: str, fraction: float, key: Sequence[str]) -> DataFrame:
    """The same share of every stratum (rounded per stratum)."""
    quotas = df.groupBy(stratum).agg(F.bround(F.count("*") * F.lit(fraction)).cast("bigint").alias("_quota"))
    return take_by_digest(df, [stratum], quotas, key)


def stratified_sample(df: DataFrame, target: str, key: Sequence[str], rows=SAMPLE_ROWS, above=SAMPLE_ABOVE_ROWS):
    """Stratify on the target when it has at most 50 classes, else sample at random."""
    total, classes = df.agg(F.count("*"), F.approx_count_distinct(target)).first()
    if total <= above:
        return df
    if classes <= 2 * MAX_STRATA and df.select(target).dropna().distinct().count() <= MAX_STRATA:
        return stratified_fraction(df, target, min(1.0, rows / total), key)
    return random_sample(df, key, rows, above)


def proportional_quotas(df: DataFrame, stratum: str, rows: int) -> DataFrame:
    """Largest-remainder allocation of ``rows`` over the strata (null is one); ties go to the smaller label."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_c"))
    total = df.agg(F.count("*")).scalar()
    target = F.least(F.lit(rows).cast("bigint"), total)
    share = sizes.withColumn("_raw", F.col("_c") / total * target)
    share = share.withColumn("_base", F.floor("_raw")).withColumn("_frac", F.round(F.col("_raw") - F.col("_base"), 9))
    left = target - F.sum("_base").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("_frac"), F.asc_nulls_first(stratum)))
    quota = F.least(F.col("_base") + (F.col("_place") <= F.col("_left")).cast("bigint"), F.col("_c"))
    return share.withColumn("_left", left).withColumn("_place", place).select(stratum, quota.alias("_quota"))


def proportional_sample(df: DataFrame, stratum: str, rows: int, key: Sequence[str]) -> DataFrame:
    return take_by_digest(df, [stratum], proportional_quotas(df, stratum, rows), key)


def best_stratify_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The text column with the fewest of 2–20 distinct values (null counts as a value)."""
    columns = list(columns or text_columns(df))
    cells = [
        F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"),
                 (F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias("n_unique"))
        for i, c in enumerate(columns)
    ]
    rows = df.agg(F.array(*cells).alias("r")).select(F.inline("r"))
    rows = rows.where(F.col("n_unique").between(2, LOW_CARDINALITY))
    return rows.orderBy("n_unique", "i").limit(1).select("column", "n_unique")


def capped_strata(df: DataFrame, stratum: str, cap: int, key: Sequence[str]) -> DataFrame:
    """At most ``cap`` rows per group (null is a group) and ``_weight`` = group size / rows kept."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_c"))
    quotas = sizes.select(stratum, F.least(F.col("_c"), F.lit(cap)).alias("_quota"))
    weights = sizes.select(stratum, (F.col("_c") / F.least(F.col("_c"), F.lit(cap))).alias("_weight"))
    return _join_back(take_by_digest(df, [stratum], quotas, key), weights, [stratum], "inner")


def quantile_strata(df: DataFrame, column: str, rows: int, key: Sequence[str], buckets: int = 4) -> DataFrame:
    """Equal draws from value quartiles, weighted back to the bucket sizes."""
    probs = {f"q{i}": i / buckets for i in range(1, buckets)}
    edges = percentiles(df, column, probs).first()
    bounds = sorted({edges[p] for p in probs if edges[p] is not None})
    bucket = F.lit(0)
    for b in bounds:
        bucket = bucket + (F.col(column) >= b).cast("int")
    marked = df.where(F.col(column).isNotNull()).withColumn("_bucket", bucket)
    return capped_strata(marked, "_bucket", max(rows // buckets, 1), key)


def equal_strata(df: DataFrame, stratum: str, rows: int, key: Sequence[str]) -> DataFrame:
    """``rows`` / number of groups from each group, at least one."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_c"))
    per = F.greatest(F.lit(1), F.floor(F.lit(rows) / sizes.agg(F.count("*")).scalar()))
    return take_by_digest(df, [stratum], sizes.select(stratum, per.alias("_quota")), key)


def stratification_candidates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns worth stratifying on: few-valued text by sparsity, many-valued numbers by |skew|, in that order."""
    columns = list(columns or df.columns)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name in columns]
    texts = [c for c in columns if c not in numeric]
    parts = []
    if texts:
        long = df.select(*[F.col(c).cast("string").alias(c) for c in texts]).unpivot([], texts, "column", "value")
        per_value = long.groupBy("column", "value").agg(F.count("*").alias("n"))
        parts.append(per_value.groupBy("column").agg(
            F.count("*").alias("n_unique"), F.avg((F.col("n") < SPARSE_GROUP_ROWS).cast("double")).alias("metric"),
        ).withColumn("kind", F.when(F.col("n_unique") <= LOW_CARDINALITY, "categorical_low").when(
            F.col("n_unique") <= MEDIUM_CARDINALITY, "categorical_medium")))
    if numeric:
        cells = []
        for c in numeric:
            x = F.col(c).cast("double")
            n = F.count(x)
            # population third moment over the cubed SAMPLE deviation
            skew = F.abs(F.skewness(x)) * F.pow((n - 1) / n, F.lit(1.5))
            cells.append(F.struct(F.lit(c).alias("column"), F.countDistinct(x).alias("n_unique"), skew.alias("metric")))
        rows = df.agg(F.array(*cells).alias("r")).select(F.inline("r"))
        parts.append(rows.withColumn("kind", F.when(F.col("n_unique") > LOW_CARDINALITY, "numerical_skewed")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = out.where((F.col("n_unique") >= 2) & F.col("kind").isNotNull())
    priority = F.array_position(F.array(*map(F.lit, ("categorical_low", "categorical_medium", "numerical_skewed"))), "kind")
    return out.orderBy(priority, F.desc("metric"), "column").select("column", "kind", "n_unique", "metric")


def sample_portfolio(
    df: DataFrame, key: Sequence[str], candidates: Sequence[tuple[str, str]], cap: int, baseline_rows: int,
    max_samples: int = 5,
) -> dict[str, DataFrame]:
    """Up to four special samples (one of them by quantiles) and a random baseline, all with ``_weight``."""
    out: dict[str, DataFrame] = {}
    for column, kind in candidates:
        if kind.startswith("categorical") and len(out) < max_samples - 1:
            out[f"strat_{column}"] = capped_strata(df, column, cap, key)
    for column, kind in candidates:
        if kind == "numerical_skewed" and len(out) < max_samples - 1:
            out[f"quantile_{column}"] = quantile_strata(df, column, cap * 4, key).drop("_bucket")
            break
    out["random_baseline"] = exact_sample(df, key, baseline_rows).withColumn("_weight", F.lit(1.0))
    return out


def portfolio_rows(df: DataFrame, row_bytes: float, candidates: int, budget: int = 5_242_880) -> int:
    """Rows per group so that a stored sample stays within ``budget`` bytes."""
    return max(int(max(min(int(budget / max(row_bytes, 1)), 100_000), 1) / max(candidates, 1)), 1)


def hash_split(df: DataFrame, columns: Sequence[str] | None = None, out: str = "is_train") -> DataFrame:
    """80/20 split: digest of all values, as a number modulo 10, below 8.

    A hex number modulo 10 needs no big integer: 16**8 ≡ 6 (mod 10), so 8-digit pieces can be added with weight 6.
    """
    h = F.md5(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in (columns or df.columns)]))
    piece = [F.conv(F.substring(h, i, 8), 16, 10).cast("bigint") for i in (1, 9, 17, 25)]
    return df.withColumn(out, (6 * (piece[0] + piece[1] + piece[2]) + piece[3]) % 10 < 8)


def temporal_holdout(
    df: DataFrame, time: str, tie: Sequence[str], test_share: float = 0.2, out: str = "is_train", **kw
) -> DataFrame:
    """Past trains, the last ``test_share`` tests; rows without a time come last."""
    marked = df.withColumn("_no_time", F.col(time).isNull())
    total = df.agg(F.count("*")).scalar()
    cut = F.greatest(F.lit(1), F.floor(total * F.lit(1.0 - test_share)))
    numbered = row_numbers(marked, "_rn", ["_no_time", time, *tie], **kw)
    return numbered.withColumn(out, F.col("_rn") <= cut).drop("_rn", "_no_time")


def expanding_sizes(n_rows: Column, folds: int = 5) -> Column:
    """(n_folds, held, n_train_rows, n_validation_rows) of expanding-window folds; the last two are those of the last fold.

    Null below 3 rows. Every fold is validated on ``held`` rows and trained on all rows before them.
    """
    count = F.least(F.greatest(F.lit(2), F.lit(folds)), n_rows - 1)
    held = F.floor(n_rows / (count + 1))
    return F.when(n_rows >= 3, F.struct(
        count.cast("bigint").alias("n_folds"), held.alias("held"), (n_rows - held).alias("n_train_rows"), held.alias("n_validation_rows")))


def choose_splitter(task: str, groups: int | None = None, time_ordered: bool = False) -> str:
    """Time order outranks groups, groups outrank stratification."""
    if time_ordered:
        return "TimeSeriesSplit"
    if groups is not None and groups > 1:
        return "GroupKFold"
    return "StratifiedKFold" if "classification" in task else "KFold"


def _shuffled(key: Sequence[str]) -> Column:
    """A stable pseudo-random order of rows: the digest of their key."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in key]))


def plain_folds(df: DataFrame, key: Sequence[str], folds: int, out: str = "fold") -> DataFrame:
    """Folds of equal size but for one row, in the order of the keys' digests; the first ones take the remainder."""
    placed = rank_buckets(df.withColumn("_digest", _shuffled(key)), ["_digest", *key], folds, out, split_above=0)
    return placed.withColumn(out, F.col(out) - 1).drop("_digest")


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], folds: int, out: str = "fold") -> DataFrame:
    """Folds in which every class has its share but for one row, and all folds the same size but for one.

    Rows are dealt in turn along the order (class, digest of the key). Their numbers come from two passes: range slices of that
    order are counted, a prefix sum over the slices gives each its first number. So a class of any share is spread over
    all tasks.
    """
    ordered = df.withColumns({"_digest": _shuffled(key), "_none": F.col(label).isNull()})
    numbered = row_numbers(ordered, "_rn", ["_none", label, "_digest", *key], split_above=0)
    return numbered.withColumn(out, ((F.col("_rn") - 1) % folds).cast("int")).drop("_rn", "_digest", "_none")


def expanding_folds(df: DataFrame, time: str, key: Sequence[str], folds: int = 5, out: str = "fold") -> DataFrame:
    """Fold numbers in time order: fold i is validated by the rows with that number and trained by all with a smaller one.

    -1 marks the rows that only train. Rows without a time come last. Below 3 rows all are -1.
    """
    marked = df.withColumn("_no_time", F.col(time).isNull())
    numbered = row_numbers(marked, "_rn", ["_no_time", time, *key], split_above=0)
    sizes = df.agg(F.count("*").alias("n")).select("n", expanding_sizes(F.col("n"), folds).alias("s")).first()
    if sizes["s"] is None:
        return numbered.withColumn(out, F.lit(-1)).drop("_rn", "_no_time")
    first = sizes["n"] - sizes["s"]["n_folds"] * sizes["s"]["held"]
    fold = F.greatest(F.floor((F.col("_rn") - 1 - first) / sizes["s"]["held"]), F.lit(-1))
    return numbered.withColumn(out, fold.cast("int")).drop("_rn", "_no_time")


def assign_folds(
    df: DataFrame, task: str, folds: int, key: Sequence[str], label: str, entity: str | None = None, time: str | None = None,
    out: str = "fold",
) -> tuple[DataFrame, str]:
    """(rows with their fold, splitter): the splitter that the task, the entities and the time column call for."""
    groups = df.select(entity).distinct().limit(2).count() if entity else None
    name = choose_splitter(task, groups, time is not None)
    if name == "TimeSeriesSplit":
        return expanding_folds(df, time, key, folds, out), name
    if name == "GroupKFold":
        return group_folds(df, entity, folds, out), name
    if name == "StratifiedKFold":
        return stratified_folds(df, label, key, folds, out), name
    return plain_folds(df, key, folds, out), name


def group_folds(df: DataFrame, entity: str, folds: int, out: str = "fold") -> DataFrame:
    """Fold numbers from the entity's digest: an entity never spans folds, and no shuffle is needed."""
    h = F.conv(F.substring(F.md5(F.col(entity).cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(out, F.coalesce((h % folds).cast("int"), F.lit(0)))


def rank_buckets(df: DataFrame, order: Sequence[str], buckets: int, out: str, **kw) -> DataFrame:
    """Equal-count buckets 1…n over a unique order; the first ones take the remainder."""
    total = df.agg(F.count("*")).scalar()
    base, extra = F.floor(total / buckets), total % buckets
    big = extra * (base + 1)
    rn = F.col("_rn")
    bucket = F.when(rn <= big, F.ceil(rn / (base + 1))).otherwise(
        extra + F.ceil((rn - big) / F.greatest(base, F.lit(1))))
    return row_numbers(df, "_rn", order, **kw).withColumn(out, bucket.cast("int")).drop("_rn")


def systematic_by_value(df: DataFrame, column: str, tie: Sequence[str], buckets: int, rows: int, **kw) -> DataFrame:
    """Cut the value order in equal parts and take every k-th row of each, ``rows`` / ``buckets`` at most."""
    known = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    n = known.agg(F.count("*")).scalar()
    per = max(1, rows // buckets)
    numbered = row_numbers(known, "_rn", [column, *tie], **kw).withColumn("_n", n).withColumn("_i", F.col("_rn") - 1)
    part = F.floor(((F.col("_i") + 1) * buckets - 1) / F.col("_n"))
    placed = numbered.withColumn("quantile", part.cast("int"))
    start = F.floor(F.col("_n") * F.col("quantile") / buckets)
    end = F.floor(F.col("_n") * (F.col("quantile") + 1) / buckets)
    placed = placed.withColumn("_at", F.col("_i") - start).withColumn(
        "_step", F.greatest(F.lit(1), F.floor((end - start) / per)))
    kept = placed.where((F.col("_at") % F.col("_step") == 0) & (F.floor(F.col("_at") / F.col("_step")) < per))
    return kept.drop("_rn", "_n", "_i", "_at", "_step")


def row_at(df: DataFrame, order: Sequence[str], index: int) -> DataFrame:
    """The row at a 0-based position of a unique order."""
    return df.orderBy(*order).offset(index).limit(1)


def weighted_value_stats(sample: DataFrame, column: str, top: int = 15) -> DataFrame:
    """Top values of a weighted sample with corrected counts and shares; missing words share one entry."""
    text = F.col(column).cast("string")
    value = F.when(text.isNull() | F.lower(F.trim(text)).isin(*MISSING_WORDS), "<missing>").otherwise(text)
    per = sample.groupBy(value.alias("value")).agg(F.sum("_weight").alias("_w"), F.count("*").alias("sample_count"))
    total = sample.agg(F.sum("_weight")).scalar()
    return per.orderBy(F.desc("_w"), "value").limit(top).select(
        "value", F.round("_w").cast("bigint").alias("count"), F.round(F.col("_w") / total, 4).alias("frequency"),
        "sample_count")


def hybrid_numeric_stats(quantile_sample: DataFrame, base: DataFrame, column: str) -> DataFrame:
    """Quartiles by the index rule and extremes from the quantile sample; mean, population std from the base."""
    spots = {"percentile_25": lambda n: F.floor(n / 4), "percentile_75": lambda n: F.floor(3 * n / 4)}
    ranks = value_at_rank(quantile_sample, column, spots).drop("n")
    median = percentiles(quantile_sample, column, {"median": 0.5}).drop("n")
    x = F.col(column).cast("double")
    row = base.agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("count"),
        (F.count("*") - F.count(x)).alias("missing_count"), F.countDistinct(x).alias("n_unique"))
    m, s = row.first()[:2]
    skew = F.avg(F.pow(x - F.lit(m), F.lit(3))) / F.lit(s) ** 3 if s else F.lit(0.0)
    ends = quantile_sample.agg(F.min(x).alias("min"), F.max(x).alias("max"), skew.alias("skewness"))
    for one in (ranks, median, ends):
        found = one.first()
        for c in one.columns:
            row = row.withColumn(c, F.lit(found[c]))
    names = "mean std median percentile_25 percentile_75 min max skewness".split()
    return row.select(F.lit(column).alias("column"), "count", "missing_count", "n_unique",
                      *[F.round(F.col(c).cast("double"), 4).alias(c) for c in names])


def portfolio_overview(base: DataFrame, portfolio: dict[str, DataFrame]) -> DataFrame:
    """One row per base column: missing share, distinct values and which sample its statistics come from."""
    columns = [c for c in base.columns if c != "_weight"]
    cells = []
    for c in columns:
        source = "stratified" if f"strat_{c}" in portfolio else "quantile + base" if f"quantile_{c}" in portfolio else "base"
        cells.append(F.struct(
            F.lit(c).alias("column"), F.lit(source).alias("source_sample"),
            F.round((F.count("*") - F.count(c)) / F.count("*"), 4).alias("missing_ratio"),
            F.countDistinct(c).alias("n_unique")))
    return base.agg(F.array(*cells).alias("r")).select(F.inline("r"))
