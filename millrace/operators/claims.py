"""Sentences checked against numbers: claim splitting, wording flags, invented figures, wrong superlatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import within_tolerance
from millrace.session import cut_lineage, spread

# Wording lists, number pattern and scales.
CAUSAL = ("cause", "causes", "caused", "causing", "drive", "drives", "driven by", "drove", "lead to", "leads to", "led to",
          "result in", "results in", "resulted in", "because of", "due to", "responsible for", "impact of", "effect of",
          "influence", "influences", "determine", "determines")
NOT_CAUSAL = ("root cause", "causal analysis", "cause analysis")
ABSOLUTE = ("will always", "always", "never", "guarantees", "guaranteed", "certainly", "definitely", "will increase",
            "will decrease", "ensures")
SIGNIFICANCE = ("significant", "significantly", "statistically")
LOWEST = ("lowest", "smallest", "minimum", "laggard")
HIGHEST = ("highest", "largest", "greatest", "maximum", "leader")
NUMBER = (
    r"(?<![\w.])-?(?:\d{1,3}(?:[,   ]\d{3})+|\d{1,3}(?: \d{3}){2,}|\d+)(?:\.\d+)?"
    r"(?:\s?%|\s?percent\b|\s?(?:thousand|million|billion|trillion)\b|(?:[kKmMbBtT]|bn|Bn|BN|mn|tn)(?![\w]))?")
SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9,
          "t": 1e12, "tn": 1e12, "trillion": 1e12}


def mentions(c: Column, terms: Sequence[str]) -> Column:
    return F.lower(c).rlike(r"\b(?:" + "|".join(terms) + r")\b")


def split_claims(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, claim): sentences and lines of more than 15 characters, code removed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), r"`[^`\n]*`", " ")
    parts = F.split(F.regexp_replace(bare, r"([.!?])\s+", "$1\n"), "\n+")
    kept = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > 15)
    return df.select(key, F.posexplode(kept).alias("position", "claim"))


def wording_flags(claims: DataFrame, causal_evidence: bool = False, test_evidence: bool = False) -> DataFrame:
    """Adds ``causal``, ``absolute`` and ``significance``: wording the evidence does not license."""
    c = F.col("claim")
    false_positive = F.lower(c).rlike("|".join(NOT_CAUSAL))
    return claims.withColumns({
        "causal": mentions(c, CAUSAL) & ~false_positive & F.lit(not causal_evidence), "absolute": mentions(c, ABSOLUTE),
        "significance": mentions(c, SIGNIFICANCE) & F.lit(not test_evidence)})


def stated_numbers(claims: DataFrame, key: str) -> DataFrame:
    """(key, position, raw, value, is_percent, decimals) for the figures of each claim; typographic minus signs count."""
    signs = F.regexp_replace(F.regexp_replace("claim", r"[-−–]\s?[$€£₹]", "-"), "[−–]", "-")
    # Plain patterns read ASCII text exactly as Unicode-aware ones do, several times faster.
    signed = claims.select(key, "position", signs.alias("_signs"))
    raws = F.when(F.length("_signs") == F.octet_length("_signs"), F.regexp_extract_all("_signs", F.lit(NUMBER), F.lit(0))).otherwise(
        F.regexp_extract_all("_signs", F.lit("(?U)" + NUMBER), F.lit(0)))
    scales = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])

    # Step by step over the figures, so that no step is worked out again for each later use of it.
    def without_percent(raw: Column) -> Column:
        t = F.trim(raw)
        return F.struct(raw.alias("raw"), t.rlike(r"(?i)(%|percent)$").alias("is_percent"), F.regexp_replace(t, r"(?i)\s?(%|percent)$", "").alias("bare"))

    def without_unit(f: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(f["bare"], r"\s?[A-Za-z]+$", ""), r"[,    ]", "")
        return F.struct(f["raw"].alias("raw"), f["is_percent"].alias("is_percent"), digits.alias("digits"),
                        F.lower(F.regexp_extract(f["bare"], r"([A-Za-z]+)$", 1)).alias("unit"))

    def read(f: Column) -> Column:
        value = f["digits"].try_cast("double") * F.coalesce(F.try_element_at(scales, f["unit"]), F.lit(1.0))
        return F.struct(f["raw"].alias("raw"), value.alias("value"), f["is_percent"].alias("is_percent"),
                        F.length(F.regexp_extract(f["digits"], r"\.(\d+)$", 1)).alias("decimals"), (f["unit"] != "").alias("is_scaled"))

    figures = F.transform(F.transform(F.transform(raws, without_percent), without_unit), read)
    return signed.select(key, "position", F.inline(figures)).where("value is not null")


def invented_numbers(claims: DataFrame, key: str, evidence: DataFrame, known: str) -> DataFrame:
    """(key, position, raw, value) of figures that no evidence number supports.

    Small whole counts and calendar years are exempt unless they are percentages; a percentage may also match a
    fraction. Values are matched once each, then looked up by every claim that states them.
    """
    v = F.col("value")
    whole = v % 1 == 0
    exempt = ~F.col("is_percent") & whole & ((F.abs(v) < 10) | v.between(1900, 2100))
    # Figures are read three times below; finding them in the text is the dear part, so it is done once.
    numbers = cut_lineage(stated_numbers(spread(claims), key).where(~exempt))
    direct = within_tolerance(numbers, "value", evidence, known).withColumn("_ok", F.lit(True))
    hundred = evidence.select((F.col(known) * 100).alias("_h"))
    as_share = within_tolerance(numbers.where("is_percent"), "value", hundred, "_h", absolute=0.051).withColumn(
        "_share", F.lit(True))
    looked = numbers.join(direct, "value", "left").join(as_share, "value", "left")
    supported = F.col("_ok").isNotNull() | (F.col("is_percent") & F.col("_share").isNotNull())
    return looked.where(~supported).select(key, "position", "raw", "value")


def ordering_contradicted(claims: DataFrame, key: str, result: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(key, position, direction): "lowest" / "highest" claims none of whose located figures is that extreme.

    A figure is located in a result column when a value rounds to it at the precision it is stated with; figures and
    values meet on that rounded number.
    """
    long = result.unpivot([], list(columns), "column", "v").where("v is not null")
    long = long.withColumn("v", F.col("v").cast("double"))
    ends = long.groupBy("column").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).where("n >= 2")
    flagged = claims.withColumns({"low": mentions(F.col("claim"), LOWEST), "high": mentions(F.col("claim"), HIGHEST)})
    flagged = flagged.where("low or high")
    numbers = cut_lineage(stated_numbers(flagged, key).where("not is_percent and not is_scaled"))
    step = F.pow(F.lit(10.0), F.col("decimals"))
    at = F.round(F.col("value") * step).cast("bigint")
    spots = numbers.select("value", "decimals").distinct().withColumn("cell", F.explode(F.array(at - 1, at, at + 1)))
    grains = [F.lit(r["decimals"]) for r in spots.select("decimals").distinct().collect()] or [F.lit(0)]
    cells = long.distinct().join(ends.select("column"), "column").withColumn("decimals", F.explode(F.array(*grains))).withColumn(
        "cell", F.floor(F.col("v") * step + 0.5))
    half = 0.5 / step + 1e-9
    located = spots.join(cells, ["decimals", "cell"]).where(F.abs(F.col("value") - F.col("v")) <= half)
    located = located.select("value", "decimals", "column").distinct().join(ends, "column")
    verdict = located.groupBy("value", "decimals").agg(
        F.max((F.abs(F.col("value") - F.col("lo")) <= half).cast("int")).alias("is_lo"),
        F.max((F.abs(F.col("value") - F.col("hi")) <= half).cast("int")).alias("is_hi"))
    per_claim = numbers.join(verdict, ["value", "decimals"]).groupBy(key, "position").agg(
        F.max("is_lo").alias("is_lo"), F.max("is_hi").alias("is_hi"))
    joined = flagged.join(per_claim, [key, "position"])
    wrong = F.array_compact(F.array(F.when(F.col("low") & (F.col("is_lo") == 0), "lowest"),
                                    F.when(F.col("high") & (F.col("is_hi") == 0), "highest")))
    return joined.select(key, "position", F.explode(wrong).alias("direction"))


def vocabulary(df: DataFrame) -> DataFrame:
    """Distinct word tokens of all column names and text values."""
    camel = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+"

    def words(c: Column) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(camel), F.lit(0)), F.lower)

    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "v string")
    values = df.select(*texts).unpivot([], texts, "column", "v").select("v") if texts else names
    found = names.unionByName(values).select(F.explode(F.array_distinct(words(F.col("v")))).alias("word"))
    return found.where((F.length("word") >= 3) & ~F.col("word").rlike(r"^\d+$")).distinct()


def unanchored_words(df: DataFrame, request: Sequence[str]) -> DataFrame:
    """Request words that no name or value of the table supports, whole or as part of a word of four letters or more."""
    spark = df.sparkSession
    asked = F.array(*[F.lit(w.lower()) for w in request])
    word = F.col("word")
    hits = F.filter(asked, lambda t: (t == word) | ((F.length(word) >= 4) & (t.contains(word) | word.contains(t))))
    anchored = vocabulary(df).select(F.explode(hits).alias("token")).distinct()
    tokens = spark.createDataFrame([(w.lower(),) for w in request], "token string").distinct()
    return tokens.join(anchored, "token", "left_anti")
