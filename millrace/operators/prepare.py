"""Preparation learned from training rows and applied to any rows without looking at them again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import dates as D
from millrace.functions import numbers as N
from millrace.functions.missing import parse_day
from millrace.functions.text import BOOLEAN_PAIRS, to_boolean
from millrace.operators.aggregates import value_counts
from millrace.operators.profile import kind_of, sample_skewness
from millrace.operators.windows import quantiles, top_per_group
from millrace.session import new_path, reread, spread

# Preparation thresholds.
REFUSE_IMPUTATION = 0.60
INDICATOR_FROM = 0.05
SKEW_FOR_MEDIAN = 1.0
RARE_BELOW = 0.01
PARSE_SHARE = 0.90
MODE_SHARE = 0.5
MISSING_LABEL, OTHER_LABEL = "__missing__", "__other__"
DATE_PARTS = ("year", "month", "day", "dayofweek", "hour")

#: Bytes of a column's rare levels that may be sent to every task; beyond that they are joined by a shuffle.
SENT_BYTES = 64 << 20


@dataclass
class PreparationPlan:
    """Everything learned at fit time.

    Rare levels are kept as a table in the shared folder, because a column can have any number of them.
    """

    numeric: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    booleans: dict[str, tuple[str, str]] = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)
    imputations: dict[str, tuple[str, object]] = field(default_factory=dict)
    unimputable: dict[str, float] = field(default_factory=dict)
    indicators: list[str] = field(default_factory=list)
    rare: dict[str, int] = field(default_factory=dict)
    rare_path: str = ""
    rare_bytes: dict[str, int] = field(default_factory=dict)
    date_parts: list[str] = field(default_factory=list)
    cyclical: list[str] = field(default_factory=list)
    ratios: list[tuple[str, str, str]] = field(default_factory=list)
    fitted_rows: int = 0

    def add_ratio(self, numerator: str, denominator: str, name: str) -> PreparationPlan:
        self.ratios.append((numerator, denominator, name))
        return self


def _text_evidence(df: DataFrame, texts: Sequence[str]) -> dict[str, dict]:
    """Per text column: how much reads as a number, a date or one of the boolean pairs. One pass, one row."""
    cells = []
    for c in texts:
        col = F.col(c)
        low = F.lower(F.trim(col))
        pairs = [F.coalesce(F.min(low.isin(*p).cast("int")), F.lit(0)).alias("_".join(p)) for p in BOOLEAN_PAIRS]
        cells.append(F.struct(
            F.count(col).alias("n"), F.count(N.parse_costumed(col)).alias("numbers"),
            F.count(parse_day(col)).alias("days"), F.max(col.rlike("[-/:]").cast("int")).alias("separators"),
            *pairs).alias(c))
    return df.agg(*cells).first().asDict(recursive=True) if cells else {}


def fit_preparation(train: DataFrame, target: str | None = None, modelling: bool = True) -> PreparationPlan:
    """Learn types, fills, indicators and level groups from training rows only.

    Three passes in all: text evidence, one aggregation of moments, one (column, value) count for the levels.
    """
    with reread(train) as rows:
        return _fit(rows, target, modelling)


def _fit(train: DataFrame, target: str | None, modelling: bool) -> PreparationPlan:
    plan = PreparationPlan()
    columns = [c for c in train.columns if c != target]
    kinds = {f.name: kind_of(f) for f in train.schema.fields}
    texts = [c for c in columns if kinds[c] == "text"]
    for c, e in _text_evidence(train, texts).items():
        if e["n"] and e["numbers"] / e["n"] >= PARSE_SHARE:
            plan.numeric.append(c)
        elif e["n"] and e["separators"] and e["days"] / e["n"] >= PARSE_SHARE:
            plan.dates.append(c)
        else:
            pair = next((p for p in BOOLEAN_PAIRS if e["n"] and e["_".join(p)] == 1), None)
            if pair:
                plan.booleans[c] = pair
            else:
                plan.texts.append(c)
    # Fill statistics are read on the repaired types with gaps as found: text is not yet trimmed or emptied.
    repaired = _repair(train, plan, empty_texts=False)
    numbers = plan.numeric + [c for c in columns if kinds[c] == "numeric"]
    labels = plan.texts + list(plan.booleans)
    cells = [F.count("*").alias("_rows")]
    for c in columns:
        x = F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")
        cells.append(F.struct(F.count(c).alias("n"), F.avg(x).alias("mean"), sample_skewness(x).alias("skew")).alias(c))
    facts = repaired.agg(*cells).first()
    plan.fitted_rows = rows = facts["_rows"]
    levels = {}
    if labels:
        counted = value_counts(repaired.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in labels]), labels)
        # The counts are read three times, so they are written once.
        kept_at = new_path(train.sparkSession, "levels")
        counted.write.parquet(kept_at)
        counted = train.sparkSession.read.parquet(kept_at)
        # At most 1 / RARE_BELOW levels can be frequent, so what comes back is bounded whatever the column holds.
        kept = counted.where(F.col("n") >= max(rows, 1) * RARE_BELOW).collect()
        for r in kept:
            levels.setdefault(r["column"], []).append((r["value"], r["n"]))
        sizes = {r["column"]: r["k"] for r in counted.groupBy("column").agg(F.count("*").alias("k")).collect()}
    skewed = [c for c in columns if c in numbers and facts[c]["n"] and abs(facts[c]["skew"] or 0.0) >= SKEW_FOR_MEDIAN]
    medians = quantiles(repaired.select(*[F.col(c).cast("double").alias(c) for c in skewed]), skewed, [0.5]) if skewed else {}
    for c in columns:
        n, missing = facts[c]["n"], 1 - facts[c]["n"] / max(rows, 1)
        if missing >= REFUSE_IMPUTATION:
            plan.unimputable[c] = round(missing, 4)
        elif c in numbers and n:
            if c in medians:
                plan.imputations[c] = ("median", medians[c][0])
            else:
                plan.imputations[c] = ("mean", facts[c]["mean"])
            if missing == 0 and isinstance(train.schema[c].dataType, T.IntegralType):
                # A column of whole numbers without gaps keeps its type; its fill is only a precaution.
                plan.imputations[c] = (plan.imputations[c][0], round(plan.imputations[c][1]))
        elif c in labels and n:
            best = min(levels.get(c, []), key=lambda v: (-v[1], v[0]), default=None)
            if best and best[1] / n >= MODE_SHARE:
                plan.imputations[c] = ("mode", best[0])
            else:
                plan.imputations[c] = ("constant", MISSING_LABEL)
        if modelling and missing > 0 and missing >= INDICATOR_FROM:
            plan.indicators.append(c)
        if c in plan.texts and 0 < len(levels.get(c, [])) < sizes.get(c, 0):
            plan.rare[c] = sizes[c] - len(levels[c])
    if plan.rare:
        plan.rare_path = new_path(train.sparkSession, "rare-levels")
        rare = counted.where((F.col("n") < rows * RARE_BELOW) & F.col("column").isin(*plan.rare))
        rare.select("column", "value").write.partitionBy("column").parquet(plan.rare_path)
        sizes = rare.groupBy("column").agg(F.sum(F.octet_length("value") + 64).alias("b")).collect()
        plan.rare_bytes = {r["column"]: r["b"] for r in sizes}
    plan.date_parts = plan.dates + [c for c in columns if kinds[c] == "datetime"]
    plan.cyclical = list(plan.date_parts) if modelling else []
    return plan


def _repair(df: DataFrame, plan: PreparationPlan, empty_texts: bool = True) -> DataFrame:
    fixes: dict[str, Column] = {}
    for c in plan.numeric:
        if c in df.columns:
            fixes[c] = N.parse_costumed(F.col(c))
    for c in plan.dates:
        if c in df.columns:
            fixes[c] = parse_day(F.col(c)).cast("timestamp")
    for c, pair in plan.booleans.items():
        if c in df.columns:
            fixes[c] = to_boolean(F.col(c), pair)
    if empty_texts:
        for c in plan.texts:
            if c in df.columns and isinstance(df.schema[c].dataType, T.StringType):
                fixes[c] = F.when(~N.is_null_token(F.col(c)), F.trim(c))
    return df.withColumns(fixes) if fixes else df


def apply_preparation(df: DataFrame, plan: PreparationPlan) -> DataFrame:
    """Repair types, mark gaps, fill, group rare levels, derive parts: no statistic is read."""
    out = _repair(spread(df), plan)
    marks = {f"{c}__was_missing": F.col(c).isNull().cast("int") for c in plan.indicators if c in df.columns}
    out = out.withColumns(marks) if marks else out
    fixes: dict[str, Column] = {}
    for c, (_, value) in plan.imputations.items():
        if c in df.columns and value is not None:
            if c in plan.booleans:
                # A sentinel label turns a two-valued column back to text, so gaps stay null there instead.
                value = None if value == MISSING_LABEL else value == "true"
            fill = F.lit(value).cast(df.schema[c].dataType) if isinstance(value, int) and c not in plan.booleans else F.lit(value)
            fixes[c] = F.coalesce(F.col(c), fill) if value is not None else F.col(c)
    out = out.withColumns(fixes) if fixes else out
    for c in plan.rare:
        if c in df.columns:
            # Levels not seen at fit time stay as they are, so this is a lookup and not a "not among the frequent" test.
            levels = df.sparkSession.read.parquet(plan.rare_path).where(F.col("column") == c).select(
                F.col("value").alias(c), F.lit(True).alias("_rare"))
            small = plan.rare_bytes.get(c, SENT_BYTES + 1) <= SENT_BYTES
            out = out.join(F.broadcast(levels) if small else levels, c, "left").withColumn(c, F.when(F.col("_rare"), OTHER_LABEL).otherwise(F.col(c))).drop("_rare")
    derived: dict[str, Column] = {}
    for c in plan.date_parts:
        if c in df.columns:
            parts = D.date_parts(F.col(c))
            derived.update({f"{c}__{p}": parts[p] for p in DATE_PARTS})
    for c in plan.cyclical:
        if c in df.columns:
            derived[f"{c}__month_sin"], derived[f"{c}__month_cos"] = D.month_cycle(F.col(c))
    for numerator, denominator, name in plan.ratios:
        if numerator in df.columns and denominator in df.columns:
            derived[name] = N.ratio(F.col(numerator), F.col(denominator))
    return out.withColumns(derived) if derived else out


def plan_rows(df: DataFrame, plan: PreparationPlan) -> DataFrame:
    """The plan as rows (column, action, detail), for a report."""
    rows = [(c, "coerce_numeric", "") for c in plan.numeric]
    rows += [(c, "parse_datetime", "") for c in plan.dates]
    rows += [(c, "coerce_boolean", "/".join(p)) for c, p in plan.booleans.items()]
    rows += [(c, "impute", s) for c, (s, _) in plan.imputations.items()]
    rows += [(c, "flag_unimputable", str(m)) for c, m in plan.unimputable.items()]
    rows += [(c, "add_indicator", "") for c in plan.indicators]
    rows += [(c, "group_rare", str(k)) for c, k in plan.rare.items()]
    rows += [(c, "add_date_parts", "") for c in plan.date_parts]
    rows += [(c, "add_cyclical", "") for c in plan.cyclical]
    rows += [(name, "add_ratio", f"{a}/{b}") for a, b, name in plan.ratios]
    return df.sparkSession.createDataFrame(rows, "column string, action string, detail string")


def fill_choices(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, strategy, value) the fit would use for numeric columns, as rows."""
    cells = []
    for c in columns:
        x = F.col(c).cast("double")
        skewed = F.abs(sample_skewness(x)) >= SKEW_FOR_MEDIAN
        cells.append(F.struct(F.lit(c).alias("column"), F.when(skewed, "median").otherwise("mean").alias("strategy"),
                              F.avg(x).alias("mean")))
    base = df.agg(F.array(*cells).alias("r")).select(F.inline("r"))
    medians = df.sparkSession.createDataFrame(
        [(c, v[0]) for c, v in quantiles(df.select(*columns), columns, [0.5]).items()], "column string, median double")
    value = F.when(F.col("strategy") == "median", F.col("median")).otherwise(F.col("mean"))
    return base.join(medians, "column").select("column", "strategy", value.alias("value"))


def mode_choices(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, strategy, value) for label columns: the mode when it holds half of the values, else a sentinel."""
    counts = value_counts(df, columns)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    best = top_per_group(counts, ["column"], [F.desc("n"), F.asc("value")], 1).join(totals, "column")
    strong = F.col("n") / F.col("total") >= MODE_SHARE
    return best.select("column", F.when(strong, "mode").otherwise("constant").alias("strategy"),
                       F.when(strong, F.col("value")).otherwise(MISSING_LABEL).alias("value"))
