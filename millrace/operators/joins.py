"""Joins and what guards them: key checks, key suggestions, co-occurrence, tolerance joins, metric merges."""

from __future__ import annotations

import difflib
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.missing import ISO_DATE
from millrace.operators.aggregates import grouped_metrics
from millrace.operators.windows import row_numbers
from millrace.session import kept

# Pair limit, suggestion weights and thresholds.
MAX_PAIRS = 1_000_000
#: Pairs per row below which no shorter way to them is looked for.
FEW_PAIRS = 16
#: Pairs that one task counts.
PAIRS_PER_TASK = 500_000
SAME_NAME, FUZZY_NAME, FUZZY_GAIN, FUZZY_FROM = 0.65, 0.45, 0.15, 0.86
OVERLAP_WEIGHT, UNIQUE_WEIGHT, ID_BONUS = 0.35, 0.15, 0.10
DATE_NAMES = ("date", "time", "timestamp", "created", "updated", "dt")


def check_keys(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str]) -> None:
    lost = [f"left.{k}" for k in left_on if k not in left.columns] + [f"right.{k}" for k in right_on if k not in right.columns]
    if lost:
        raise ValueError(f"join keys not found: {', '.join(lost)}")
    if not left_on or len(left_on) != len(right_on):
        raise ValueError("a join names its keys on both sides")


def equi_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str] | None = None, how="inner"):
    """Join on named keys. No hint: runtime sizes decide between broadcast and sort-merge, and skewed parts are split."""
    right_on = list(right_on or left_on)
    check_keys(left, right, left_on, right_on)
    if list(left_on) == right_on:
        return left.join(right, list(left_on), how)
    cond = F.lit(True)
    for a, b in zip(left_on, right_on, strict=True):
        cond = cond & (left[a] == right[b])
    return left.join(right, cond, how)


def share_with_match(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """(n, matched, share) of left rows with at least one partner; right keys are made distinct first."""
    keys = right.select(F.col(right_on).alias("_k")).where("_k is not null").distinct()
    joined = left.join(keys, left[left_on] == keys["_k"], "left")
    return joined.agg(F.count("*").alias("n"), F.count("_k").alias("matched"),
                      F.avg(F.col("_k").isNotNull().cast("double")).alias("share"))


def every_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of two small tables, refused above a million pairs. Sizes are counted up to the limit only."""
    n = left.limit(MAX_PAIRS + 1).count()
    m = right.limit(MAX_PAIRS + 1).count()
    if n * m > MAX_PAIRS:
        raise ValueError(f"{n} x {m} rows make more than {MAX_PAIRS:,} pairs; join on a key instead")
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")


def _norm(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _texts(table: DataFrame, name: str, position: int, keep_pad: int) -> DataFrame:
    long = table.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in table.columns])
    return long.unpivot([], table.columns, "column", "v").where("v is not null and v <> ''").select(
        F.lit(position).alias("t"), F.lit(name).alias("table"), "column", F.lower("v").alias("v"))


def column_values(tables: dict[str, DataFrame]) -> DataFrame:
    """(t, table, column, v, n): distinct lower-cased values of every column with their counts."""
    out = None
    for i, (name, table) in enumerate(tables.items()):
        one = _texts(table, name, i, 0)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("t", "table", "column", "v").agg(F.count("*").alias("n"))


def suggest_join_keys(tables: dict[str, DataFrame], top: int = 8) -> DataFrame:
    """Column pairs across tables that look like join keys, best first.

    Only pairs whose names match (a schema's worth, decided on the driver) are measured. Each distinct value meets its
    twin once per pair, so work grows with distinct values and never with pairs of rows.
    """
    names = list(tables)
    pairs = []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            for x in tables[a].columns:
                for y in tables[b].columns:
                    if _norm(x) == _norm(y):
                        pairs.append((a, x, b, y, SAME_NAME))
                        continue
                    sim = difflib.SequenceMatcher(None, _norm(x), _norm(y)).ratio()
                    if sim >= FUZZY_FROM:
                        pairs.append((a, x, b, y, FUZZY_NAME + FUZZY_GAIN * sim))
    schema = "lt string, lc string, rt string, rc string, base double"
    spark = next(iter(tables.values())).sparkSession
    if not pairs:
        return spark.createDataFrame([], "left_dataset string, right_dataset string, left_key string, right_key string, "
                                         "confidence double, match_rate double")
    wanted = {(a, x) for a, x, *_ in pairs} | {(b, y) for *_, b, y, _ in [(0, *p[2:]) for p in pairs]}
    needed = {n: tables[n].select(*[c for c in tables[n].columns if (n, c) in wanted]) for n in names
              if any((n, c) in wanted for c in tables[n].columns)}
    values = column_values(needed)
    facts = values.groupBy("table", "column").agg(
        F.count("*").alias("u"), F.sum("n").alias("n"),
        F.avg(F.col("v").rlike(r"^[A-Za-z0-9\-_]+$").cast("double")).alias("plain"))
    pair_rows = spark.createDataFrame(pairs, schema)
    # One row per (pair, value) on each side, merged by value: two rows make a shared value.
    left = pair_rows.select("lt", "lc", "rt", "rc", F.col("lt").alias("table"), F.col("lc").alias("column"))
    right = pair_rows.select("lt", "lc", "rt", "rc", F.col("rt").alias("table"), F.col("rc").alias("column"))
    sides = left.unionByName(right).join(values, ["table", "column"])
    shared = sides.groupBy("lt", "lc", "rt", "rc", "v").agg(F.count("*").alias("k")).where("k = 2")
    shared = shared.groupBy("lt", "lc", "rt", "rc").agg(F.count("*").alias("shared"))

    def side(t, c, p):
        f = facts.select(*[F.col(x).alias(f"{p}{x}") for x in facts.columns])
        return f, (F.col(t) == F.col(f"{p}table")) & (F.col(c) == F.col(f"{p}column"))

    lf, lcond = side("lt", "lc", "l_")
    rf, rcond = side("rt", "rc", "r_")
    joined = pair_rows.join(shared, ["lt", "lc", "rt", "rc"], "left").join(lf, lcond, "left").join(rf, rcond, "left")
    overlap = F.coalesce(F.col("shared") / F.least("l_u", "r_u"), F.lit(0.0))
    ul, ur = (F.coalesce(F.col(f"{p}u") / F.col(f"{p}n"), F.lit(0.0)) for p in ("l_", "r_"))

    def id_like(name, unique, plain):
        return F.lower(name).endswith("id") | ((unique >= 0.75) & (F.coalesce(F.col(plain), F.lit(0.0)) >= 0.6))

    bonus = F.when(id_like("lc", ul, "l_plain") | id_like("rc", ur, "r_plain"), ID_BONUS).otherwise(0.0)
    score = F.col("base") + OVERLAP_WEIGHT * F.least(F.lit(1.0), overlap * 1.2) + UNIQUE_WEIGHT * F.least(
        F.lit(1.0), (ul + ur) / 2) + bonus
    ranked = joined.withColumn("_s", F.least(F.lit(1.0), score)).orderBy(F.desc(F.round("_s", 6)), "lt", "lc", "rt", "rc")
    return ranked.limit(top).select(
        F.col("lt").alias("left_dataset"), F.col("rt").alias("right_dataset"), F.col("lc").alias("left_key"),
        F.col("rc").alias("right_key"), F.round("_s", 2).alias("confidence"), F.round(overlap, 2).alias("match_rate"))


def comparison_table(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table: what to show instead of a join when no key fits."""
    out = None
    for name, table in tables.items():
        one = table.agg(F.lit(name).alias("dataset"), F.count("*").alias("n_rows"),
                        F.lit(len(table.columns)).alias("n_columns"), F.lit(",".join(sorted(table.columns))).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def column_shapes(df: DataFrame) -> DataFrame:
    """Per column, how much reads as a date, a year, a month, a day, a short code or a long label."""
    cells = []
    for c in df.columns:
        text = F.trim(F.col(c).cast("string"))
        v = F.when(text != "", text)

        def share(pattern, v=v):
            return F.coalesce(F.avg(v.rlike(pattern).cast("double")), F.lit(0.0))

        cells.append(F.struct(
            F.lit(c).alias("column"), share(ISO_DATE).alias("date"), share(r"^\d{4}$").alias("year"),
            share(r"^(0?[1-9]|1[0-2])$").alias("month"), share(r"^(0?[1-9]|[12][0-9]|3[01])$").alias("day"),
            share(r"^[A-Z0-9]{2,4}$").alias("code"),
            F.coalesce(F.avg(((F.length(v) >= 6) & v.contains(" ")).cast("double")), F.lit(0.0)).alias("label")))
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def code_label_pairs(left: DataFrame, right: DataFrame, share: float = 0.5) -> DataFrame:
    """Columns of short codes on one side and of long labels on the other: a lookup may be needed before joining."""
    a, b = column_shapes(left).collect(), column_shapes(right).collect()
    rows = [(x["column"], y["column"], "left") for x in a for y in b if x["code"] >= share and y["label"] >= share]
    rows += [(y["column"], x["column"], "right") for x in a for y in b if y["code"] >= share and x["label"] >= share]
    return left.sparkSession.createDataFrame(rows, "code_column string, label_column string, code_side string")


def join_at_date_grain(left: DataFrame, right: DataFrame, date: str, grain: str, key: str, how: str = "inner") -> DataFrame:
    """Join a date on the left to a year, month or day number on the right."""
    part = {"year": F.year, "month": F.month, "day": F.dayofmonth}[grain]
    derived = left.withColumn("_g", part(date))
    return derived.join(right, F.col("_g") == right[key], how).drop("_g")


def cosine_pairs(baskets: DataFrame, basket: str, item: str, at_least: int = 1, parts: int = 1, by_prefix: bool | None = None) -> DataFrame:
    """(a, b, together, similarity) for items that share a basket; each unordered pair once, no zeros, no selves.

    Baskets are made distinct, and items seen in fewer than ``at_least`` baskets leave before any pair is formed, since
    they cannot reach that count. ``parts`` spreads the partners of a very large basket over several tasks.

    An item of n baskets needs a partner in its n - at_least + 1 smallest baskets (by size, then basket), and so does the
    partner: ``at_least`` common baskets cannot all lie among the last at_least - 1 of either. With ``by_prefix`` pairs are formed there
    only and then counted over the baskets of the rarer item, so that large baskets form no pairs of items whose other
    baskets are smaller. None decides by the rows that either way would join, which one count by basket gives.
    """
    rows = baskets.select(F.col(basket).alias("k"), F.col(item).alias("i")).dropna().distinct()
    sizes = rows.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    rows = rows.join(sizes, "i").select("k", "i", "n")
    if at_least > 1 and by_prefix is not False:
        rows = kept(rows, "baskets")
        pairs, many = _all_pairs(rows)
        # Small baskets form so few pairs that looking for less does not pay.
        heads = _smallest_baskets(rows, at_least) if by_prefix or pairs > FEW_PAIRS * many else None
        if heads is not None and (by_prefix or _cheaper(heads, rows)):
            return _with_similarity(_counted(_pairs(heads, parts).distinct(), rows), at_least)
        # Few pairs repeat: counting them before they are dealt would only hold nearly all of a task's pairs in its memory.
        dealt = _pairs(rows, parts).repartition(max(1, math.ceil(pairs / PAIRS_PER_TASK)), "a", "b")
    else:
        dealt = _pairs(rows, parts)
    counted = dealt.groupBy("a", "b").agg(F.count("*").alias("together"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return _with_similarity(counted, at_least)


def _pairs(rows: DataFrame, parts: int) -> DataFrame:
    left = rows.select("k", F.col("i").alias("a"), F.col("n").alias("na"),
                       F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int").alias("p"))
    right = rows.select("k", F.col("i").alias("b"), F.col("n").alias("nb"),
                        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    return left.join(right, ["k", "p"]).where(F.col("a") < F.col("b")).select("a", "b", "na", "nb")


def _with_similarity(counted: DataFrame, at_least: int) -> DataFrame:
    return counted.where(F.col("together") >= at_least).select(
        "a", "b", "together", (F.col("together") / F.sqrt(F.col("na").cast("double") * F.col("nb"))).alias("similarity"))


def _smallest_baskets(rows: DataFrame, at_least: int) -> DataFrame:
    """The rows of each item without its ``at_least - 1`` largest baskets."""
    sized = rows.join(rows.groupBy("k").agg(F.count("*").alias("_size")), "k")
    placed = row_numbers(sized, "_at", ["_size", "k"], ["i"])
    return kept(placed.where(F.col("_at") <= F.col("n") - (at_least - 1)).select("k", "i", "n"), "smallest-baskets")


def _cheaper(heads: DataFrame, rows: DataFrame) -> bool:
    """Whether pairs of ``heads``, each then counted over some item's baskets, take fewer rows than all pairs of ``rows``."""
    short = heads.groupBy("k").agg((_pairs_of_group() * (1 + F.avg("n"))).alias("c")).agg(F.sum("c")).first()[0] or 0
    return short < _all_pairs(rows)[0]


def _all_pairs(rows: DataFrame) -> tuple[float, int]:
    """Pairs over all baskets, and the rows that form them."""
    return rows.groupBy("k").agg(_pairs_of_group().alias("c"), F.count("*").alias("s")).agg(F.coalesce(F.sum("c"), F.lit(0.0)), F.coalesce(F.sum("s"), F.lit(0))).first()


def _pairs_of_group() -> Column:
    return F.count("*") * (F.count("*") - 1) / 2


def _counted(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidates with the number of baskets that hold both items: those of the rarer item, looked up with the other."""
    rarer = F.col("na") <= F.col("nb")
    asked = candidates.withColumns({"_one": F.when(rarer, F.col("a")).otherwise(F.col("b")), "_other": F.when(rarer, F.col("b")).otherwise(F.col("a"))})
    inside = asked.join(rows.select(F.col("i").alias("_one"), "k"), "_one").join(rows.select(F.col("i").alias("_other"), "k"), ["_other", "k"])
    return inside.groupBy("a", "b").agg(F.count("*").alias("together"), F.first("na").alias("na"), F.first("nb").alias("nb"))


def _grid(v: Column, relative: float, absolute: float) -> Column:
    """Cell on a grid as wide as the tolerance: even steps while the absolute part rules, growing steps beyond."""
    turn, size = absolute / relative, F.abs(v)
    growing = F.floor(F.log(F.greatest(size, F.lit(turn)) / turn) / math.log1p(relative * 1.05))
    cell = F.when(size <= turn, F.floor(size / absolute)).otherwise(math.floor(turn / absolute) + growing)
    return (F.signum(v) * (cell + 1)).cast("bigint")


def within_tolerance(
    left: DataFrame, value: str, evidence: DataFrame, known: str, relative: float = 0.01, absolute: float = 0.01
) -> DataFrame:
    """Distinct left values that lie within max(absolute, |known|·relative) of an evidence number.

    Both sides are distinct numbers. A value can only match evidence in its own grid cell or the two next to it, so the
    range test becomes an equi-join on the cell; nothing is broadcast or paired in full.
    """
    a = left.select(F.col(value).alias("x")).where("x is not null").distinct()
    b = evidence.select(F.col(known).cast("double").alias("k")).where("k is not null").distinct()
    at = _grid(F.col("x"), relative, absolute)
    a = a.withColumn("cell", F.explode(F.sequence(at - 2, at + 2)))
    b = b.withColumn("cell", _grid(F.col("k"), relative, absolute))
    close = F.abs(F.col("x") - F.col("k")) <= F.greatest(F.lit(absolute), F.abs("k") * relative)
    return a.join(b, "cell").where(close).select(F.col("x").alias(value)).distinct()


def merge_metrics(df: DataFrame, by: Sequence[str], groups: Sequence[dict[str, tuple[str, str | None]]]) -> DataFrame:
    """Full outer join of separately computed metric tables on their group key; keys are unique by construction."""
    out = None
    for metrics in groups:
        one = grouped_metrics(df, by, metrics)
        out = one if out is None else out.join(one, list(by), "full_outer")
    return out


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table itself when the keys are unique, else an error naming how many rows repeat one."""
    repeats = df.groupBy(*keys).count().agg(F.sum(F.col("count") - 1)).first()[0] or 0
    if repeats:
        raise ValueError(f"{repeats} rows repeat the key {', '.join(keys)}")
    return df


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return sorted({c.lower() for c in left.columns} & {c.lower() for c in right.columns})
