"""Chart-ready aggregates computed on every row: categories, histograms, scatters, monthly series, outcome rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.missing import as_double, is_missing_word
from millrace.operators.aggregates import metric, pearson
from millrace.operators.windows import percentiles, row_numbers

# Skew rule, scatter size, rate bands.
SKEW_CAP, SKEW_TAIL, SKEW_MIN_ROWS = 2.0, 0.01, 50
SCATTER_POINTS = 500
RATE_BANDS, RATE_MIN_ROWS, RATE_MIN_Z = 8, 20, 5.0
YEAR_KEY = r"^(19|20)\d{2}$"
BAND_KEY = r"^\s*(<=?|>=?|under|below|over|above)?\s*(\d+(?:\.\d+)?)\s*(?:(?:-|–|to)\s*(\d+(?:\.\d+)?))?\s*(\+)?\s*$"


def category_label(c: Column) -> Column:
    """Trimmed text; a whole-number float reads without its decimals."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^-?\d+\.0+$"), F.substring_index(text, ".", 1)).otherwise(text)


def categories(
    df: DataFrame, x: str, y: str | None = None, agg: str = "count", top: int = 15, pie: bool = False
) -> DataFrame:
    """(position, x, y, share): largest groups first, years in calendar order, missing left out, pies closed by "Other".

    Shares exist only for additive, non-negative measures. A pie of a signed measure has no rows.
    """
    top = max(2, top)
    rows = df.where(~is_missing_word(F.col(x))).withColumn("_k", category_label(F.col(x)))
    counting = y is None or agg == "count"
    if counting:
        values = rows.groupBy("_k").agg(F.count("*").cast("double").alias("_v"))
    else:
        values = rows.withColumn("_y", as_double(rows, y)).where("_y is not null").groupBy("_k").agg(
            metric(agg, "_y").cast("double").alias("_v"))
    facts = values.agg(
        F.sum("_v").alias("total"), (F.min("_v") < 0).alias("signed"), F.count("*").alias("groups"),
        (F.min(F.col("_k").rlike(YEAR_KEY).cast("int")) == 1).alias("years")).first()
    years = bool(facts["years"]) and facts["groups"] > 1 and not pie
    additive = (counting or agg == "sum") and not facts["signed"]
    order = F.col("_k").cast("double") if years else F.col("_v")
    shown = values.withColumn("_o", order).orderBy(F.desc("_o"), "_k").limit(top)
    direction = F.col("_o") if years else -F.col("_o")
    position = F.row_number().over(Window.orderBy(direction, "_k"))
    share = F.col("_v") / facts["total"] if additive and facts["total"] else F.lit(None).cast("double")
    out = shown.select(position.alias("position"), F.col("_k").alias("x"), F.round("_v", 2).alias("y"), share.alias("share"))
    if not pie:
        return out
    if facts["signed"]:
        return out.limit(0)
    if not additive or facts["groups"] <= top:
        return out
    rest = F.lit(facts["total"]) - F.sum("_v")
    other = shown.agg(F.lit(top + 1).alias("position"), F.lit("Other").alias("x"), F.round(rest, 2).alias("y"),
                      (rest / facts["total"]).alias("share"))
    return out.unionByName(other)


def band_order(c: Column) -> Column:
    """Sort key of a numeric band ("<25", "25-34", "75+"); null for other text."""
    op, low, plus = (F.regexp_extract(F.lower(c), BAND_KEY, i) for i in (1, 2, 4))
    key = low.try_cast("double")
    return F.when(op.isin("<", "<=", "under", "below"), key - 0.5).when(
        op.isin(">", ">=", "over", "above") | (plus != ""), key + 0.5).otherwise(key)


def tail_caps(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    """The 1% / 99% value on the long side of a heavily skewed column."""
    n, skew, lo, hi = df.agg(F.count(column), F.skewness(column), F.min(column), F.max(column)).first()
    if n < SKEW_MIN_ROWS or skew is None or abs(skew) < SKEW_CAP:
        return None, None
    at = 1 - SKEW_TAIL if skew > 0 else SKEW_TAIL
    cap = percentiles(df, column, {"cap": at}).first()["cap"]
    if not lo < cap < hi:
        return None, None
    return (None, cap) if skew > 0 else (cap, None)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins (5–50) with a heavy tail folded into the end bin; empty bins stay."""
    bins = max(5, min(bins, 50))
    rows = df.select(as_double(df, column).alias("x")).where("x is not null")
    lo, hi = rows.agg(F.min("x"), F.max("x")).first()
    if lo is None or lo == hi:
        return rows.agg(F.lit(0).alias("bin"), F.lit(lo).cast("double").alias("x0"), F.lit(hi).cast("double").alias("x1"),
                        F.count("*").alias("y"))
    low_cap, high_cap = tail_caps(rows, "x")
    b_lo, b_hi = (lo if low_cap is None else low_cap), (hi if high_cap is None else high_cap)
    width = (b_hi - b_lo) / bins
    clipped = F.least(F.greatest(F.col("x"), F.lit(b_lo)), F.lit(b_hi))
    at = F.greatest(F.lit(0), F.least(F.floor((clipped - b_lo) / width), F.lit(bins - 1))).cast("int")
    counts = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("y"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    x0, x1 = F.round(b_lo + F.col("bin") * width, 6), F.round(b_lo + (F.col("bin") + 1) * width, 6)
    if high_cap is not None:
        x1 = F.when(F.col("bin") == bins - 1, F.lit(float(hi))).otherwise(x1)
    if low_cap is not None:
        x0 = F.when(F.col("bin") == 0, F.lit(float(lo))).otherwise(x0)
    return frame.join(counts, "bin", "left").select(
        "bin", x0.alias("x0"), x1.alias("x1"), F.coalesce("y", F.lit(0)).alias("y"))


def scatter(df: DataFrame, x: str, y: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(facts, points): r on every pair; at most 500 evenly strided points without the long tails."""
    pairs = df.select(*order, as_double(df, x).alias("_x"), as_double(df, y).alias("_y"))
    pairs = pairs.where("_x is not null and _y is not null")
    (xl, xh), (yl, yh) = tail_caps(pairs, "_x"), tail_caps(pairs, "_y")
    keep = F.lit(True)
    for c, cap, low in (("_x", xl, True), ("_x", xh, False), ("_y", yl, True), ("_y", yh, False)):
        if cap is not None:
            keep = keep & (F.col(c) >= cap if low else F.col(c) <= cap)
    drawn = pairs.where(keep)
    n_drawn = drawn.count()
    step = max(1, n_drawn // SCATTER_POINTS)
    numbered = row_numbers(drawn, "_rn", order)
    points = numbered.where(((F.col("_rn") - 1) % step == 0) & (F.col("_rn") <= step * SCATTER_POINTS))
    points = points.select(F.col("_x").alias("x"), F.col("_y").alias("y"))
    facts = pairs.agg(F.count("*").alias("n"), pearson("_x", "_y").alias("r")).withColumn(
        "points_shown", F.lit(min(SCATTER_POINTS, math.ceil(n_drawn / step)))).withColumn(
        "points_hidden", F.col("n") - n_drawn)
    return facts, points


def monthly_series(df: DataFrame, time: str, y: str | None = None, agg: str = "count") -> DataFrame:
    """(period, y, is_partial): edge months below half the median are marked when there are at least four months."""
    rows = df.where(F.col(time).isNotNull()).withColumn("period", F.date_format(time, "yyyy-MM"))
    if y is None or agg == "count":
        value = F.count("*").cast("double")
    else:
        rows = rows.where(F.col(y).isNotNull())
        value = metric(agg, y).cast("double")
    monthly = rows.groupBy("period").agg(value.alias("y"))
    ends = monthly.agg(F.struct(F.count("*").alias("k"), F.min("period").alias("a"), F.max("period").alias("b"),
                                F.median("y").alias("m")).alias("e")).scalar()
    at_edge = F.col("period").isin(ends.getField("a"), ends.getField("b"))
    partial = (ends.getField("k") >= 4) & at_edge & (F.col("y") < 0.5 * ends.getField("m"))
    return monthly.select("period", "y", partial.alias("is_partial"))


def monthly_facts(series: DataFrame) -> DataFrame:
    """Peak, low, mean and the change of the second half against the first, over the full months (one row per month)."""
    core = series.where(~F.col("is_partial"))
    n = F.count("*").over(Window.partitionBy())
    numbered = core.withColumn("_i", F.row_number().over(Window.orderBy("period"))).withColumn("_n", n)
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    return numbered.agg(
        F.count("*").alias("n_months"), F.max_by("period", F.struct("y", "period")).alias("peak"),
        F.min_by("period", F.struct("y", "period")).alias("low"), F.avg("y").alias("mean"),
        F.when(F.count("*") >= 4, F.avg(F.when(~first, F.col("y"))) / F.avg(F.when(first, F.col("y"))) - 1).alias(
            "half_change"))


def seasonality(series: DataFrame) -> DataFrame:
    """Mean per calendar month against the overall mean, when at least 24 full months exist."""
    core = series.where(~F.col("is_partial"))
    enough = core.agg(F.count("*")).scalar() >= 24
    months = core.where(enough).groupBy(F.substring("period", 6, 2).cast("int").alias("month")).agg(F.avg("y").alias("mean"))
    return months.withColumn("vs_overall", F.col("mean") / F.avg("mean").over(Window.partitionBy()) - 1)


def _outcome_rows(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """The candidate columns and a 0/1 outcome ``_y``; other outcomes leave."""
    return df.select(*columns, as_double(df, y).alias("_y")).where("_y in (0.0, 1.0)")


def _bands(rows: DataFrame, columns: list[str], bands: int) -> dict[str, tuple[float, float, int, bool]]:
    """(low, width, number of bands, whole numbers) per numeric column, from one row of extremes."""
    cells = []
    for c in columns:
        x = as_double(rows, c)
        cells.append(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"),
                              (F.count_if(x % 1 != 0) == 0).alias("whole")).alias(c))
    facts, out = rows.agg(*cells).first(), {}
    for c in columns:
        f = facts[c]
        if f["n"] < 10 or f["hi"] == f["lo"]:
            continue
        if f["whole"]:
            width = float(max(1, math.ceil((f["hi"] - f["lo"] + 1) / bands)))
            out[c] = (f["lo"], width, max(1, math.ceil((f["hi"] - f["lo"] + 1) / width)), True)
        else:
            out[c] = (f["lo"], (f["hi"] - f["lo"]) / bands, bands, False)
    return out


def _band_of(x: Column, low: float, width: float, n: int) -> Column:
    return F.least(F.floor((x - low) / width), F.lit(n - 1)).cast("int")


def rate_by_band(df: DataFrame, x: str, y: str, bands: int = RATE_BANDS) -> DataFrame:
    """(band, low, high, n, rate): outcome rate per equal-width band, whole-number bands for whole numbers."""
    rows = _outcome_rows(df, [x], y)
    spec = _bands(rows, [x], max(2, min(bands, 20)))
    low, width, n, whole = spec.get(x, (0.0, 1.0, 1, False))
    value = as_double(rows, x)
    usable = rows.where(value.isNotNull() & F.lit(x in spec))
    out = usable.groupBy(_band_of(value, low, width, n).alias("band")).agg(
        F.count("*").alias("n"), F.avg("_y").alias("rate"), F.max(value).alias("_hi"))
    start = low + F.col("band") * width
    end = F.when(F.col("band") == n - 1, F.col("_hi")).otherwise(start + (width - 1 if whole else width))
    return out.select("band", start.alias("low"), end.alias("high"), "n", F.round("rate", 4).alias("rate"))


def rate_by_group(df: DataFrame, x: str, y: str, top: int = 15) -> DataFrame:
    """(x, n, rate): outcome rate per category, highest first; two-valued keys read Yes / No."""
    rows = _outcome_rows(df.where(~is_missing_word(F.col(x))), [x], y)
    groups = rows.groupBy(F.trim(F.col(x).cast("string")).alias("x")).agg(F.count("*").alias("n"), F.avg("_y").alias("rate"))
    facts = groups.agg(F.struct(F.count("*").alias("k"),
                                F.min(F.col("x").rlike(r"^[01](\.0+)?$").cast("int")).alias("b")).alias("f")).scalar()
    binary = (facts.getField("b") == 1) & (facts.getField("k") == 2)
    label = F.when(binary, F.when(F.col("x").startswith("1"), "Yes").otherwise("No")).otherwise(F.col("x"))
    ordered = groups.where(facts.getField("k") >= 2).orderBy(F.desc("rate"), "x").limit(max(2, top))
    return ordered.select(label.alias("x"), "n", F.round("rate", 4).alias("rate"))


def rate_drivers(df: DataFrame, outcome: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(column, kind, z) per candidate, strongest first.

    z is the standardised chi-square of "the same rate in every group" over groups of at least 20 rows. All candidates
    share one pass over all rows: each row gives its band or category per column.
    """
    rows = _outcome_rows(df, [*numeric, *categorical], outcome)
    spec = _bands(rows, numeric, RATE_BANDS) if numeric else {}
    cells = []
    for c, (low, width, n, _) in spec.items():
        group = _band_of(as_double(rows, c), low, width, n).cast("string")
        cells.append(F.struct(F.lit(c).alias("column"), F.lit("numeric").alias("kind"), group.alias("g")))
    for c in categorical:
        group = F.when(~is_missing_word(F.col(c)), F.trim(F.col(c).cast("string")))
        cells.append(F.struct(F.lit(c).alias("column"), F.lit("categorical").alias("kind"), group.alias("g")))
    long = rows.select("_y", F.inline(F.array(*cells))).where("g is not null")
    groups = long.groupBy("column", "kind", "g").agg(F.count("*").alias("n"), F.round(F.avg("_y"), 4).alias("r"))
    sums = groups.where(F.col("n") >= RATE_MIN_ROWS).groupBy("column", "kind").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("r")).alias("s"),
        F.sum(F.col("n") * F.col("r") * F.col("r")).alias("q"))
    p, dof = F.col("s") / F.col("n"), F.col("k") - 1
    chi2 = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (p * (1 - p))
    usable = sums.where((F.col("k") >= 2) & (p > 0) & (p < 1))
    return usable.select("column", "kind", ((chi2 - dof) / F.sqrt(2.0 * dof)).alias("z")).orderBy(F.desc("z"), "column")


def best_rate_driver(df: DataFrame, outcome: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    return rate_drivers(df, outcome, numeric, categorical).where(F.col("z") >= RATE_MIN_Z).limit(1)


def missing_and_present(df: DataFrame, column: str) -> DataFrame:
    """Two rows, Present and Missing; none when nothing is missing."""
    counts = df.agg(F.count_if(is_missing_word(F.col(column))).alias("m"), F.count("*").alias("n")).where("m > 0")
    return counts.select(F.inline(F.array(
        F.struct(F.lit("Present").alias("x"), (F.col("n") - F.col("m")).cast("double").alias("y")),
        F.struct(F.lit("Missing").alias("x"), F.col("m").cast("double").alias("y")))))
