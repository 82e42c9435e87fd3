"""Exact deduplication by Grace hashing: spill files, recursive partitioning, and tables that compare whole contents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import shuffle_parts, written

#: Bytes of distinct contents that one table may hold.
TABLE_BYTES = 64 << 20
#: Hex digits of the digest by which each level of partitioning divides an oversize bucket: 256 children.
DIGITS = 2
_BLANK_BYTES = b" \t\n\v\f\r"


def squeezed(text: str | None) -> bytes:
    """The text's UTF-8 bytes with every run of white space as one space; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    body = b" ".join(raw.split())
    if not body:
        return b" " if raw else b""
    return (b" " if raw[0] in _BLANK_BYTES else b"") + body + (b" " if raw[-1] in _BLANK_BYTES else b"")


class ContentTable:
    """Open addressing with linear probing: slots point to contents, and equal means equal byte for byte."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = [-1] * slots
        self.contents: list[bytes] = []
        self.digests: list[bytes] = []
        self.size = 0

    def _probe(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (i := self.slots[at]) >= 0 and not (self.digests[i] == digest and self.contents[i] == content):
            at = (at + 1) & mask
        return at

    def find(self, digest: bytes, content: bytes) -> tuple[int, bool]:
        """The number of this content, and whether it is new."""
        at = self._probe(digest, content)
        if self.slots[at] >= 0:
            return self.slots[at], False
        number = self.slots[at] = len(self.contents)
        self.contents.append(content)
        self.digests.append(digest)
        self.size += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for i, (d, c) in enumerate(zip(self.digests, self.contents, strict=True)):
                self.slots[self._probe(d, c)] = i
        return number, True


def _spilled(df: DataFrame, id_col: str, text_col: str, table_bytes: int) -> DataFrame:
    """The spill files: every row with its digest, and one run's table already applied.

    ``_row`` names the row, ``_run`` the first row of the same content in the same run, ``_content`` is filled only in
    that first row. A run is what one table can hold, so memory is bounded and a group of copies of any size leaves a task
    as one content per run. Written once: a repeated task commits the same file.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() << 36) - 1
        table, first = ContentTable(), []
        for batch in batches:
            rows, heads, digests, contents, sizes = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                row += 1
                content = squeezed(text)
                digest = hashlib.sha256(content).digest()
                if table.size > table_bytes:
                    table, first = ContentTable(), []
                number, new = table.find(digest, content)
                if new:
                    first.append(row)
                rows.append(row)
                heads.append(first[number])
                digests.append(digest.hex())
                contents.append(content if new else None)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.int64()), pa.array(heads, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(contents, pa.binary()), pa.array(sizes, pa.int64())], names=["_id", "_row", "_run", "_sha", "_content", "_bytes"])

    schema = T.StructType([
        T.StructField("_id", df.schema[id_col].dataType), T.StructField("_row", T.LongType()), T.StructField("_run", T.LongType()),
        T.StructField("_sha", T.StringType()), T.StructField("_content", T.BinaryType()), T.StructField("_bytes", T.LongType())])
    return written(df.select(F.col(id_col).alias("_id"), text_col).mapInArrow(runs, schema), "spill")


def _bucket(shas: DataFrame, table_bytes: int) -> Column:
    """The bucket of a digest: its shortest prefix whose distinct contents fit one table.

    Level by level, only prefixes that do not fit are divided further. Each such prefix stands for more than one table
    of contents, so what is collected is bounded by levels x total bytes / table bytes: 8,000 short texts for 100 TB
    of distinct contents at the default size. Contents of one digest take one place, so copies never make a bucket large.
    """
    bucket, parents, level = F.lit(""), [""], 0
    while parents and level < 64:
        sizes = shas.withColumn("_p", F.substring("_sha", 1, level)).where(F.col("_p").isin(parents))
        parents = [r[0] for r in sizes.groupBy("_p").agg(F.sum("_bytes").alias("b")).where(F.col("b") > table_bytes).select("_p").collect()]
        if parents:
            bucket = F.when(F.substring("_sha", 1, level).isin(parents), F.substring("_sha", 1, level + DIGITS)).otherwise(bucket)
        level += DIGITS
    return bucket


def _resolved(contents: DataFrame) -> DataFrame:
    """(_run, _group): equal contents of one bucket get one group, named by the first run row that the table met.

    A hash partition can hold several buckets; they are sorted and met one after the other, so one table is alive at a time.
    """

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, table, first = None, ContentTable(), []
        for batch in batches:
            runs, groups = [], []
            for b, run, sha, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != bucket:
                    bucket, table, first = b, ContentTable(), []
                number, new = table.find(bytes.fromhex(sha), content)
                if new:
                    first.append(run)
                runs.append(run)
                groups.append(first[number])
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(groups, pa.int64())], names=["_run", "_group"])

    dealt = contents.repartition(shuffle_parts(contents), "_bucket").sortWithinPartitions("_bucket", "_sha", "_row")
    return dealt.select("_bucket", F.col("_row").alias("_run"), "_sha", "_content").mapInArrow(tables, "_run long, _group long")


def grace_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``df``: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after each run of white space became one space; null counts as empty. Of equal
    texts the row with the smallest id stays; ids that are null come last, and of repeated rows exactly one
    stays. Every run sends each of its contents once to the bucket of its digest, whatever the share of copies: a filter on
    the digests met twice would have to move the same contents. An empty table gives no rows.
    """
    spill = _spilled(df, id_col, text_col, table_bytes)
    heads = spill.where(F.col("_content").isNotNull())
    digests = written(heads.groupBy("_sha").agg(F.max("_bytes").alias("_bytes")), "digests")
    groups = _resolved(heads.withColumn("_bucket", _bucket(digests, table_bytes)))
    slim = spill.select("_id", "_row", "_run", "_sha")
    named = written(slim.join(groups, "_run", "left").withColumn("_group", F.coalesce("_group", "_run")).drop("_run"), "groups")
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r"))
    best = named.groupBy("_group").agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    return named.join(best, "_group").select(
        F.col("_id").alias(id_col), F.col("_best.i").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best.r")).alias("kept"),
        F.col("_sha").alias("text_sha256"))


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with its own columns.

    Rows are found again by id and digest. Repeated rows of one id and one content are one choice: the join gives each of
    them, so one is taken per (id, digest), and only where the decisions found such repeats.
    """
    own = df.columns
    decisions = grace_dedup(df.select(F.col(id_col), F.col(text_col)), id_col, text_col)
    stay = decisions.where("kept").select(F.col(id_col).alias("_keep"), F.col("text_sha256").alias("_sha"), (F.col("group_size") > 1).alias("_copied"))
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)
    whole = df.select(F.col(id_col).alias("_id"), digest.alias("_digest"), F.struct("*").alias("_whole"))
    met = whole.join(stay, whole["_id"].eqNullSafe(stay["_keep"]) & (whole["_digest"] == stay["_sha"]))
    alone = met.where(~F.col("_copied")).select("_whole")
    once = met.where("_copied").groupBy("_keep", "_sha").agg(F.first("_whole").alias("_whole")).select("_whole")
    return alone.unionByName(once).select(*[F.col("_whole")[c].alias(c) for c in own])


SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
