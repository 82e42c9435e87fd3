"""Keyed pseudonyms, tokens and checksums as expressions."""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 64


@lru_cache(maxsize=16)
def _pads(spark: SparkSession, key: bytes) -> DataFrame:
    """The key's two pads as a table of one row: its rows are data, which no plan, explanation or event log shows."""
    key = hashlib.sha256(key).digest() if len(key) > BLOCK else key
    key = key.ljust(BLOCK, b"\0")
    pads = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return spark.createDataFrame(spark.sparkContext.parallelize([pads], 1), "inner binary, outer binary")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256. Spark has none built in, so the two padded digests are nested; no Python runs per row.

    The key is no literal: scalar subqueries fetch its pads when a query runs, once per key and query.
    """
    if not key:
        raise ValueError("refusing to pseudonymise without a key: an unkeyed digest can be reversed by guessing")
    pads = _pads(SparkSession.active(), key)
    digest = F.sha2(F.concat(pads.select("inner").scalar(), F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(pads.select("outer").scalar(), F.unhex(digest)), 256)


def pseudonym(value: Column, key: bytes, salt: str = "", length: int = 16) -> Column:
    """Stable token of a value under a key and a salt (the column name); nulls stay null."""
    return F.substring(hmac_sha256(key, F.concat(F.lit(salt + "\0"), value.cast("string"))), 1, length)


def tail_token(value: Column, key: bytes, salt: str = "", keep: int = 4) -> Column:
    """Same-length token that shows the last ``keep`` characters."""
    text = value.cast("string")
    head_length = F.length(text) - keep
    full = hmac_sha256(key, F.concat(F.lit(salt + "\0"), text))
    head = hmac_sha256(key, F.concat(F.lit(salt + "\0"), F.substr(text, F.lit(1), F.greatest(head_length, F.lit(0)))))
    short = F.when(F.length(text) == 0, F.substring(full, 1, 4)).otherwise(F.substr(full, F.lit(1), F.length(text)))
    return F.when(head_length <= 0, short).otherwise(
        F.concat(F.substr(head, F.lit(1), head_length), F.right(text, F.lit(keep))))


def export_actor(actor: Column, received_at: Column, secret: bytes, epoch_days: int = 28) -> Column:
    """Pseudonym that changes every ``epoch_days``; null without an actor or a time."""
    day = F.unix_date(received_at.cast("date"))
    message = F.concat(F.lit("export:"), F.floor(day / epoch_days).cast("string"), F.lit(":"), actor.cast("string"))
    return F.when(F.length(actor.cast("string")) > 0, F.substring(hmac_sha256(secret, message), 1, 32))


def luhn_valid(c: Column) -> Column:
    """Card checksum over the digits of a text with 12–19 of them."""
    digits = F.regexp_replace(c.cast("string"), r"\D", "")
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    weighted = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).otherwise(
        F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)))
    total = F.aggregate(weighted, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.length(digits).between(12, 19) & (total % 10 == 0)
