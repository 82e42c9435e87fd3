"""Ordered work inside groups: running totals, fills, shifts, ranks and exact order statistics.

A plain window puts one group into one task. That is right while groups are small, and wrong once a single key (or no
key at all) holds a large part of the rows. Each function here therefore measures the largest group first and, above
``split_above`` rows, works on range slices of the sort order: every slice is handled on its own, a small table of
slice summaries is scanned once, and its result is joined back. Both ways give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import cut_lineage

SPLIT_ABOVE = 4_000_000
ROWS_PER_SLICE = 8_000_000


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows in the biggest group; one map-side combined count over the key columns only."""
    if not by:
        return df.count()
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def range_slices(df: DataFrame, order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Add ``_slice``: consecutive, similarly sized ranges of the sort order, ``ROWS_PER_SLICE`` rows each on a large table.

    The range edges come from sampling, so the numbered rows are checkpointed before anything is derived from them.
    """
    spark = df.sparkSession
    n = slices or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / ROWS_PER_SLICE))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in order])
    return cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_r_{k}"])
    return cond


def _join_back(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    renamed = side
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    return df.join(renamed, _same(df, renamed, keys), how).drop(*[f"_r_{k}" for k in keys])


def _window(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)


def running_total(
    df: DataFrame, value: Column | str, out: str, order: Sequence[str], by: Sequence[str] = (),
    split_above: int | None = None,
) -> DataFrame:
    """Cumulative sum in ``order`` (make it unique), restarted for every group of ``by``."""
    value = F.col(value) if isinstance(value, str) else value
    if largest_group(df, by) <= (SPLIT_ABOVE if split_above is None else split_above):
        frame = _window(by, order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(frame))
    keys = [*by, "_slice"]
    sliced = range_slices(df.withColumn("_amount", value), [*by, *order])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*keys).agg(F.sum("_amount").alias("_t")).withColumn("_before", F.sum("_t").over(before))
    local = sliced.withColumn(
        "_local", F.sum("_amount").over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    )
    joined = _join_back(local, offsets.drop("_t"), keys)
    total = F.when(F.col("_local").isNull(), F.col("_before")).otherwise(
        F.col("_local") + F.coalesce("_before", F.lit(0))
    )
    return joined.withColumn(out, total).drop("_amount", "_slice", "_local", "_before")


def running_min(
    df: DataFrame, column: str, out: str, order: Sequence[str], by: Sequence[str] = (), split_above: int | None = None,
) -> DataFrame:
    """Lowest value so far in ``order``, restarted for every group of ``by``."""
    if largest_group(df, by) <= (SPLIT_ABOVE if split_above is None else split_above):
        frame = _window(by, order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.min(column).over(frame))
    keys = [*by, "_slice"]
    sliced = range_slices(df, [*by, *order])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    lows = sliced.groupBy(*keys).agg(F.min(column).alias("_m")).withColumn("_before", F.min("_m").over(before))
    local = sliced.withColumn("_local", F.min(column).over(
        _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    joined = _join_back(local, lows.drop("_m"), keys)
    return joined.withColumn(out, F.least("_local", "_before")).drop("_slice", "_local", "_before")


def row_numbers(df: DataFrame, out: str, order: Sequence[str], by: Sequence[str] = (), **kw) -> DataFrame:
    """1-based position in ``order`` (make it unique) inside each group."""
    return running_total(df, F.lit(1).cast("bigint"), out, order, by, **kw)


def fill_along(
    df: DataFrame, column: str, order: Sequence[str], by: Sequence[str] = (), backward: bool = False,
    split_above: int | None = None,
) -> DataFrame:
    """Replace nulls with the previous (or next) known value of the same group."""
    edge = (0, Window.unboundedFollowing) if backward else (Window.unboundedPreceding, 0)
    pick = F.first if backward else F.last
    if largest_group(df, by) <= (SPLIT_ABOVE if split_above is None else split_above):
        return df.withColumn(column, pick(column, ignorenulls=True).over(_window(by, order).rowsBetween(*edge)))
    keys = [*by, "_slice"]
    sliced = range_slices(df, [*by, *order])
    rank = F.struct(*order)
    known = F.when(F.col(column).isNotNull(), rank)
    end = F.min_by(column, known) if backward else F.max_by(column, known)
    ends = sliced.groupBy(*keys).agg(end.alias("_end"))
    outside = (1, Window.unboundedFollowing) if backward else (Window.unboundedPreceding, -1)
    w = Window.partitionBy(*by).orderBy("_slice").rowsBetween(*outside)
    ends = ends.withColumn("_carry", pick("_end", ignorenulls=True).over(w)).drop("_end")
    local = sliced.withColumn("_local", pick(column, ignorenulls=True).over(_window(keys, order).rowsBetween(*edge)))
    joined = _join_back(local, ends, keys)
    return joined.withColumn(column, F.coalesce("_local", "_carry")).drop("_slice", "_local", "_carry")


def shifted(
    df: DataFrame, column: str, out: str, order: Sequence[str], by: Sequence[str], periods: int = 1,
    split_above: int | None = None,
) -> DataFrame:
    """Lag (positive) or lead (negative) inside the entity; ``by`` is mandatory so values never cross entities."""
    if not by:
        raise ValueError("a shift needs the entity columns; shifting over the whole table mixes entities")
    if largest_group(df, by) <= (SPLIT_ABOVE if split_above is None else split_above):
        return df.withColumn(out, F.lag(column, periods).over(_window(by, order)))
    numbered = cut_lineage(row_numbers(df, "_rn", order, by, split_above=0))
    source = numbered.select(*by, (F.col("_rn") + periods).alias("_rn"), F.col(column).alias(out))
    return _join_back(numbered, source, [*by, "_rn"]).drop("_rn")


def trailing_mean(
    df: DataFrame, column: str, out: str, order: Sequence[str], by: Sequence[str] = (), periods: int = 4,
    split_above: int | None = None,
) -> DataFrame:
    """Mean of the current and the ``periods - 1`` rows before it."""
    if largest_group(df, by) <= (SPLIT_ABOVE if split_above is None else split_above):
        return df.withColumn(out, F.avg(column).over(_window(by, order).rowsBetween(1 - periods, 0)))
    numbered = cut_lineage(row_numbers(df, "_rn", order, by, split_above=0))
    reach = F.explode(F.sequence(F.col("_rn"), F.col("_rn") + F.lit(periods - 1)))
    means = numbered.select(*by, reach.alias("_rn"), F.col(column).alias("_x"))
    means = means.groupBy(*by, "_rn").agg(F.avg("_x").alias(out))
    return _join_back(numbered, means, [*by, "_rn"]).drop("_rn")


def value_at_rank(
    df: DataFrame, value: str, positions: dict[str, Callable[[Column], Column]], by: Sequence[str] = (),
    descending: bool = False, split_above: int | None = None,
) -> DataFrame:
    """Exact order statistics by position.

    ``positions`` maps an output name to a function from the group's size to a 0-based index. Equal values are merged
    to (value, count) before any ordering, so a value shared by a third of the rows is one row here.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    key = "_k" if descending else "_v"
    if descending:
        counts = counts.withColumn("_k", -F.col("_v"))
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("n"))
    cum = running_total(counts, "_n", "_upto", [key], by, split_above=split_above)
    if by:
        placed = _join_back(cum, sizes, by, "inner")
    else:
        placed = cum.withColumn("n", sizes.scalar())
    picks = [
        F.max(F.when((F.col("_upto") > f(F.col("n"))) & (F.col("_upto") - F.col("_n") <= f(F.col("n"))),
                     F.col("_v"))).alias(name)
        for name, f in positions.items()
    ]
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *picks)


def percentiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), split_above: int | None = None,
) -> DataFrame:
    """Exact, linearly interpolated percentiles, with the group's non-null size in ``n``.

    Whole columns are refined by counting (:func:`quantiles`). Per group, Spark's ``percentile`` holds every distinct
    value of a group in one buffer; above ``split_above`` rows the two neighbouring order statistics are picked by rank.
    """
    known = df.where(F.col(value).isNotNull())
    if not by and split_above is None:
        names = list(probs)
        values = quantiles(known, [value], [probs[p] for p in names])[value]
        cells = [F.lit(v).cast("double").alias(p) for p, v in zip(names, values, strict=True)]
        return known.agg(F.count("*").alias("n")).select("n", *cells)
    if largest_group(known, by) <= (SPLIT_ABOVE if split_above is None else split_above):
        all_at_once = F.percentile(value, F.array(*[F.lit(p) for p in probs.values()])).alias("_p")
        found = known.groupBy(*by).agg(F.count("*").alias("n"), all_at_once)
        return found.select(*by, "n", *[F.col("_p")[i].alias(name) for i, name in enumerate(probs)])
    positions = {}
    for name, p in probs.items():
        positions[f"_lo_{name}"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        positions[f"_hi_{name}"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    picked = value_at_rank(known, value, positions, by, split_above=split_above)
    cols = []
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*by, "n", *cols)


CELLS = 1024
#: Accuracy of the sketch: its rank errors are below one part in ``SKETCH``. Columns of fewer values are not bracketed.
SKETCH, BRACKETED = 10_000, 5_000

#: A counting pass: open intervals (column, lo, hi) in, rows (k, cell, n, lo, hi) out. ``k`` numbers the intervals; ``-1 - g``
#: stands for the values of a column between its intervals, where ``g`` counts the gaps from the lowest.
Counting = Callable[[list[tuple[str, float, float]]], DataFrame]


def finite_double(df: DataFrame, c: str) -> tuple[Column, Column]:
    """(values, finite values) of a column as doubles: NaN is no value, infinite ones are values that stand at the ends."""
    x = F.col(f"`{c}`").cast("double")
    if not isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType, T.StringType)):
        return x, x
    given = F.when(~F.isnan(x), x)
    return given, F.when(F.abs(given) < float("inf"), given)


def sketch(df: DataFrame, c: str, probs: Sequence[float]) -> Column:
    """One struct of a column: its ends, numbers of values, and a bracket of values around every wanted rank."""
    given, x = finite_double(df, c)
    edges = sorted({min(1.0, max(0.0, p + side * 4 / SKETCH)) for p in probs for side in (-1, 1)})
    return F.struct(
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(given).alias("n"), F.count(x).alias("finite"),
        F.count_if(given == float("-inf")).alias("below"), F.percentile_approx(x, edges, SKETCH).alias("edges"))


def _numbered(x: Column, column: str, keys: Sequence[tuple[str, float, float]]) -> Column:
    """The (k, cell, v) of one column's value: the open interval and cell that hold it, or the gap between intervals."""
    own = sorted((lo, hi, k) for k, (c, lo, hi) in enumerate(keys) if c == column)
    entry = F.struct(F.lit(-1 - len(own)).alias("k"), F.lit(0).alias("cell"), x.alias("v"))
    for g, (lo, hi, k) in reversed(list(enumerate(own))):
        at = F.floor((x / 2 - lo / 2) * min(CELLS / (hi / 2 - lo / 2 or 5e-324), 1e308))
        inside = F.struct(F.lit(k).alias("k"), F.least(at, F.lit(CELLS - 1)).cast("int").alias("cell"), x.alias("v"))
        gap = F.struct(F.lit(-1 - g).alias("k"), F.lit(0).alias("cell"), x.alias("v"))
        entry = F.when(x < lo, gap).when(x <= hi, inside).otherwise(entry)
    return F.when(x.isNotNull(), F.struct(F.lit(column).alias("c"), entry.alias("e")))


def counting(df: DataFrame, columns: Sequence[str]) -> Counting:
    """Counts of whole columns: one read of the columns with open intervals, one entry per value, combined before the shuffle."""

    def count(keys: list[tuple[str, float, float]]) -> DataFrame:
        open_ = [c for c in columns if any(k[0] == c for k in keys)]
        cells = F.array_compact(F.array(*[_numbered(finite_double(df, c)[1], c, keys) for c in open_]))
        rows = df.select(F.explode(cells).alias("r")).select("r.c", "r.e.*")
        return rows.groupBy("c", "k", "cell").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))

    return count


def counting_values(counts: DataFrame, columns: Sequence[str]) -> Counting:
    """The same from (column, x, n) rows, where equal values are one row: a join with the few intervals and gaps of each column."""

    def count(keys: list[tuple[str, float, float]]) -> DataFrame:
        spans = []
        for c in columns:
            own, edge = sorted((lo, hi, k) for k, (named, lo, hi) in enumerate(keys) if named == c), float("-inf")
            for g, (lo, hi, k) in enumerate(own):
                spans += [(c, -1 - g, True, edge, lo, 0.0), (c, k, False, lo, hi, min(CELLS / (hi / 2 - lo / 2 or 5e-324), 1e308))]
                edge = hi
            spans += [(c, -1 - len(own), True, edge, float("inf"), 0.0) for _ in own[:1]]
        table = counts.sparkSession.createDataFrame(spans, "c string, k int, gap boolean, low double, high double, scale double")
        x = F.col("x")
        inside = F.when(F.col("gap"), (x > F.col("low")) & (x < F.col("high"))).otherwise((x >= F.col("low")) & (x <= F.col("high")))
        met = counts.where("abs(x) < double('inf')").join(table, (F.col("column") == F.col("c")) & inside)
        at = F.least(F.floor((x / 2 - F.col("low") / 2) * F.col("scale")), F.lit(CELLS - 1)).cast("int")
        cell = F.when(F.col("gap"), F.lit(0)).otherwise(at).alias("cell")
        return met.groupBy("c", "k", cell).agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))

    return count


def _brackets(facts: Row, ranks: set[int], probs: Sequence[float]) -> list[tuple[float, float]]:
    """Disjoint intervals that hold the wanted ranks: the sketch's, joined where they meet, or the whole column."""
    if facts["finite"] < BRACKETED or facts["finite"] < facts["n"] or not facts["edges"]:
        return [(facts["lo"], facts["hi"])]
    sides = sorted({min(1.0, max(0.0, p + side * 4 / SKETCH)) for p in probs for side in (-1, 1)})
    at = dict(zip(sides, facts["edges"], strict=True))
    out: list[tuple[float, float]] = []
    for p in sorted(set(probs)):
        lo = facts["lo"] if p * SKETCH <= 4 else at[p - 4 / SKETCH]
        hi = facts["hi"] if (1 - p) * SKETCH <= 4 else at[p + 4 / SKETCH]
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def exact_quantiles(
    facts: dict[str, Row], probs: Sequence[float], count: Counting,
) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles from sketches and counting passes.

    A pass counts each open interval in ``CELLS`` even cells, and all values between the intervals, so the exact rank of every
    cell is known. A cell that holds a wanted rank and more than two values is an interval of the next pass. The sketch's
    brackets hold 8 / ``SKETCH`` of the rows, so one pass is the rule up to some hundred thousand rows and two up to some hundred
    millions. A pass returns at most a cell table per wanted rank.
    """
    found: dict[tuple[str, int], float] = {}
    wanted: dict[str, set[int]] = {}
    open_: list[tuple[str, float, float]] = []
    for c, f in facts.items():
        ranks = {r for p in probs for r in (math.floor((f["n"] - 1) * p), math.ceil((f["n"] - 1) * p))} if f["n"] else set()
        found.update({(c, r): float("-inf") for r in ranks if r < f["below"]})
        found.update({(c, r): float("inf") for r in ranks if r >= f["below"] + f["finite"]})
        ranks = {r for r in ranks if (c, r) not in found}
        if ranks and f["lo"] == f["hi"]:
            found.update({(c, r): f["lo"] for r in ranks})
        elif ranks:
            wanted[c] = ranks
            open_ += [(c, lo, hi) for lo, hi in _brackets(f, ranks, probs)]
    while open_:
        by_column: dict[str, list[Row]] = {}
        for r in count(open_).collect():
            by_column.setdefault(r["c"], []).append(r)
        left: list[tuple[str, float, float]] = []
        for c, rows in by_column.items():
            before = facts[c]["below"]
            for r in sorted(rows, key=lambda r: (r["lo"], r["hi"])):
                here = {q for q in wanted[c] if before <= q < before + r["n"] and (c, q) not in found}
                # The two ends are known at once, so a cell with up to two values needs no further pass.
                ends = {before: r["lo"], before + r["n"] - 1: r["hi"]}
                found.update({(c, q): r["lo"] if r["lo"] == r["hi"] else ends[q] for q in here if q in ends or r["lo"] == r["hi"]})
                here = {q for q in here if (c, q) not in found}
                if here and (c, r["lo"], r["hi"]) in open_:
                    # The pass did not divide this cell: its values differ by less than a double can scale.
                    found.update({(c, q): r["lo"] for q in here})
                elif here:
                    left.append((c, r["lo"], r["hi"]))
                before += r["n"]
        open_ = left
    out: dict[str, list[float | None]] = {}
    for c, f in facts.items():
        n, values = f["n"], []
        for p in probs:
            at = (n - 1) * p
            lo, hi = found.get((c, math.floor(at))), found.get((c, math.ceil(at)))
            values.append(None if not n else lo + (hi - lo) * (at - math.floor(at)))
        out[c] = values
    return out


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of whole columns, without sorting or shuffling a row.

    One read takes a mergeable sketch of all columns at once, the next counts what lies in its brackets.
    """
    facts = df.agg(*[sketch(df, c, probs).alias(str(i)) for i, c in enumerate(columns)]).first()
    return exact_quantiles({c: facts[str(i)] for i, c in enumerate(columns)}, probs, counting(df, columns))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "position") -> DataFrame:
    """The first ``k`` rows of every group. Spark cuts each partition to ``k`` rows per key before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def cumulative_by_group(df: DataFrame, group: str, value: str, out: str = "running_total") -> DataFrame:
    """Aggregate per group value first, then accumulate in the order of the groups."""
    sums = df.groupBy(group).agg(F.sum(value).alias(value))
    return running_total(sums, value, out, [group])


def year_over_year(df: DataFrame, period: str, value: str, by: Sequence[str], periods_back: int) -> DataFrame:
    """Change against the row whose integer ``period`` lies ``periods_back`` earlier (an equi-join, no window)."""
    past = df.select(*by, (F.col(period) + periods_back).alias(period), F.col(value).alias("_past"))
    joined = _join_back(df, past, [*by, period])
    return joined.withColumn("change", F.col(value) - F.col("_past")).withColumn(
        "change_pct", F.try_divide(F.col(value) - F.col("_past"), F.col("_past"))
    ).drop("_past")
