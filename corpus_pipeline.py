"""A training corpus from ``documents``: five stages, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact, langid, mixing, nearcopies, packing
from millrace.llm.common import written
from millrace.llm.queries import tokenizer_path
from millrace.session import read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those unlike every language learned, go."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    # Columns of the input that are called like the operator's results step aside meanwhile.
    aside = {c: f"_own_{c}" for c in docs.columns if c.lower() in ("lang_pred", "score", "rejected")}
    judged = langid.identify(docs.withColumnsRenamed(aside), model).where("NOT rejected")
    return judged.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the smallest doc_id stays."""
    return exact.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return nearcopies.without_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its word budget takes them."""
    return mixing.mixed_documents(docs, read_table(spark, sf_dir, "labels"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.concatenate_and_cut(docs, tokenizer_path())


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixed", mixed), ("packed", packed)]

#: Language models and tokenization cannot be expressed in SQL; tests/llm tests the operators, but not the stages or ``run``.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
