"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import running, unit


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score ``-weight / ln(u(key, shard))``; ties go to the lower shard number.

    The score of a shard depends on nothing but the key and that shard, so a further shard only takes over records that
    it scores highest on, and a removed one only gives up its own. A null key is placed like an empty one.
    """
    return _best(_scores(key, weights), len(weights))


def _scores(key: Column, weights: Sequence[float]) -> Column:
    """One (score, minus shard number) per shard, as an array."""
    if not weights or min(weights) <= 0:
        raise ValueError("at least one shard is needed, and every weight must be positive")
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    return F.transform(shards, lambda s: F.struct((-s["w"] / F.ln(unit(key, s["i"]))).alias("score"), (-s["i"]).alias("shard")))


def _best(scores: Column, shards: int) -> Column:
    return (-F.array_max(F.slice(scores, 1, shards))["shard"]).cast("int")


def shard_records(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] = ()) -> DataFrame:
    """``df`` with ``shard`` and, if ``grown`` gives the weights of shards to come, ``grown_shard`` with those as well.

    A narrow map over the scan: no shuffle, whatever the key's distribution. Columns of these names are replaced.
    """
    scored = df.withColumn("_scores", _scores(F.col(key), [*weights, *grown]))
    placed = scored.withColumn("shard", _best(F.col("_scores"), len(weights)))
    if grown:
        placed = placed.withColumn("grown_shard", _best(F.col("_scores"), len(weights) + len(grown)))
    return placed.drop("_scores")


def with_slots(df: DataFrame, shard: str, order: Sequence[str]) -> DataFrame:
    """``slot``: the record's place in its shard, gapless from 0 in ``order``; a shard may hold any share of the rows."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), [shard], order, "_one", "slot").drop("_one")


def document_shards(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Every document's shard, its place there, and its shard if there were one more.

    Null texts have size 1 and the checksum of no bytes. Repeated rows stay separate rows: same shard, own slots. Rows
    without a doc_id share one shard. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard_records(slim, "doc_id", [1.0] * shards, [1.0])
    slots = with_slots(placed, "shard", ["doc_id", "text_crc32"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The reflected polynomial of CRC-32. The SQL folds the text's bytes one by one.
SQL = """
WITH crc_bits(i, v, k) AS (
  SELECT i, i::UBIGINT, 0 FROM range(256) r(i)
), crc_steps AS (
  WITH RECURSIVE s(i, v, k) AS (
    SELECT * FROM crc_bits
    UNION ALL
    SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM s WHERE k < 8
  ) SELECT i, v FROM s WHERE k = 8
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps),
d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), sized AS (
  SELECT doc_id, octet_length(encode(text)) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::UBIGINT)),
      lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM d, crc_table
), scores AS (
  SELECT doc_id, s, -1.0 / ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS score
  FROM (SELECT DISTINCT doc_id FROM d), range(17) r(s)
), homes AS (
  SELECT doc_id, arg_max(s, score) FILTER (s < 16) AS shard, arg_max(s, score) AS grown_shard FROM scores GROUP BY doc_id
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM sized JOIN homes USING (doc_id)
"""
