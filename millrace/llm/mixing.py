"""Mixing sources to target weights: whole epochs first, then a weighted sample up to the word budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, running, unit

#: Weights that the sources take in turn, and how often a document may be repeated.
TURN = 3
MOST_EPOCHS = 3
#: A word with the white space before it.
LED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, with ``weight`` and ``target``.

    The targets share the sum of all sizes by weight; none is above ``MOST_EPOCHS`` times its source. Sharing the excess
    again and again ends at ``min(cap, level * weight)`` with one common level. In the order of cap / weight the level that
    results if exactly the sources before a row are at their cap rises up to the first free source and falls after
    it, so the level is the greatest of them: no loop is needed. The windows have no key, and one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % TURN + 1).withColumn("cap", MOST_EPOCHS * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    free_words = F.sum("source_size").over(everything) - (F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    free_weight = F.sum("weight").over(everything) - (F.sum("weight").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight"))
    levels = ranked.withColumn("_level", free_words.cast("double") / free_weight.cast("double"))
    level = F.max("_level").over(everything)
    return levels.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).drop("_level", "cap")


def sample_key(doc_id: Column, quality: Column) -> Column:
    """Exponential with rate ``quality``: the smallest keys are a weighted sample without replacement."""
    return -F.ln(unit(doc_id, "mix")) / quality


def with_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` with ``_quality``: 2 where labelled good, 0.5 where labelled poor, else 1."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("quality").alias("_label"))
    weight = F.when(F.col("_label") == 1, 2.0).when(F.col("_label") == 0, 0.5).otherwise(1.0)
    return documents.join(known, documents["doc_id"] == known["_labelled"], "left").withColumn("_quality", weight).drop("_labelled", "_label")


def mix(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document with the words that the mix takes of it, and one row per source with its plan.

    A source's words are taken whole ``floor(target / size)`` times. For the rest, its documents are sorted by their
    key and taken whole up to the document that the budget ends in, of which ``part`` words are taken, so that a source's
    words are within one of its target. The plan keeps that document's key, doc_id and size and the words left for it, so that
    the choice can be applied to full rows without a join on doc_id. Null and empty texts have size 0 and take 0 words. Rows
    that share a doc_id share their key and are sorted by size; rows equal in all of these share evenly what is left for them,
    and may leave fewer words than there are such rows. Rows without a source are a source of their own, the
    last one; its size may be any share of all. Other columns play no part; an empty table gives no rows.
    """
    slim = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    slim = with_quality(slim, labels).withColumn("key", sample_key(F.col("doc_id"), F.col("_quality"))).drop("_quality")
    placed = running(slim, ["source"], ["key", "doc_id", "size"], "size", "before")
    sizes = source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")))
    sizes = sizes.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    sizes = sizes.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "_source")
    begun = placed.where("size > 0").join(sizes, placed["source"].eqNullSafe(sizes["_source"])).where(F.col("before") < F.col("rest"))
    cuts = begun.groupBy(F.col("_source").alias("_at")).agg(F.max(F.struct("key", "doc_id", "size")).alias("cut"))
    open_plan = sizes.join(cuts, sizes["_source"].eqNullSafe(cuts["_at"]), "left").drop("_at")
    tied = placed.join(open_plan, placed["source"].eqNullSafe(open_plan["_source"])).where(_place() == F.col("cut"))
    room = tied.groupBy(F.col("_source").alias("_at")).agg(((F.max("rest") - F.min("before")) / F.count(F.lit(1))).alias("room"))
    plan = open_plan.join(room, open_plan["_source"].eqNullSafe(room["_at"]), "left").drop("_at")
    taken = placed.join(plan, placed["source"].eqNullSafe(plan["_source"])).withColumn("copies", copies()).withColumn("part", part())
    words = (F.col("size") * F.col("copies") + F.col("part")).cast("long")
    return taken.select("doc_id", "size", "source_size", "target", words.alias("taken"), "source", "copies", "part"), plan


def _place() -> Column:
    return F.struct("key", "doc_id", "size")


def copies(least: float = 1.0) -> Column:
    """How often a row with ``key``, ``doc_id`` and ``size`` is taken whole under its source's plan: the row of the cut once more
    if at least the share ``least`` of it fits."""
    fits = F.when(_place() == F.col("cut"), F.col("room") >= least * F.col("size")).otherwise(_place() < F.col("cut"))
    return (F.col("epochs") + F.coalesce(fits, F.lit(False)).cast("int")).cast("int")


def part() -> Column:
    """The words taken of a row beside its whole copies: the budget ends inside it."""
    ends = (_place() == F.col("cut")) & (F.col("room") < F.col("size"))
    return F.when(ends, F.floor("room")).otherwise(0).cast("long")


def mixed_documents(documents: DataFrame, labels: DataFrame, in_part: bool = False) -> DataFrame:
    """The documents of the mix themselves, each as many times as it is taken, with their own columns only.

    Documents without words are left out: they can take no part of a word budget. The document that a budget ends in comes whole if at
    least half of it fits, else not at all; with ``in_part`` it comes cut to the words that ``mix`` takes of it.
    """
    own = documents.columns
    whole = documents.select(F.col("doc_id"), F.col("source"), F.col("text"), F.struct("*").alias("_row"))
    _, plan = mix(whole.select("doc_id", "source", "text"), labels)
    keyed = with_quality(whole.withColumn("size", word_count(F.col("text"))), labels).withColumn("key", sample_key(F.col("doc_id"), F.col("_quality")))
    joined = keyed.where("size > 0").join(plan, keyed["source"].eqNullSafe(plan["_source"]))
    counted = joined.withColumn("_n", copies(1.0 if in_part else 0.5)).withColumn("_part", part() if in_part else F.lit(0).cast("long"))
    # A copy's words: null where it is whole.
    each = F.concat(F.array_repeat(F.lit(None).cast("int"), F.col("_n")), F.when(F.col("_part") > 0, F.array(F.col("_part").cast("int"))).otherwise(F.array().cast("array<int>")))
    rows = counted.select("_row", F.explode(each).alias("_words"))
    return rows.select(*[(F.when(F.col("_words").isNull(), F.col("_row")[c]).otherwise(first_words(F.col("_row")[c], F.col("_words"))) if c.lower() == "text" else F.col("_row")[c]).alias(c) for c in own])


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(LED_WORD), F.lit(0)), F.lit(1), words), "")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), q AS (
  SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), k AS (
  SELECT d.*, -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS key
  FROM d LEFT JOIN q ON d.doc_id = q.doc_id
), p AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size) AS through,
    count(*) OVER (PARTITION BY source, key, doc_id, size) AS alike FROM k
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST) AS pos FROM s
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - (sum(3 * source_size) OVER (ORDER BY pos) - 3 * source_size))::DOUBLE
    / ((SELECT sum(weight) FROM s) - (sum(weight) OVER (ORDER BY pos) - weight))::DOUBLE AS level FROM o
), t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT max(level) FROM l) * weight) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), x AS (
  SELECT p.doc_id, p.size, p.source, e.source_size, e.target, e.epochs,
    least(size, greatest(0, floor((target - epochs * source_size - (through - alike * size)) / alike)))::BIGINT AS words
  FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, source, (epochs + CASE WHEN size > 0 AND words = size THEN 1 ELSE 0 END)::INT AS copies,
  CASE WHEN words < size THEN words ELSE 0 END::BIGINT AS part, (size * epochs + words)::BIGINT AS taken FROM x
"""
