"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import new_path

#: White space as the corpus contracts define it: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """The same rows, read back from a fresh table in the shared folder.

    This cuts the lineage and fixes whatever depends on the partitioning: a lost executor can only repeat work that
    ends in the same committed files.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_fs(path: str, mapped: bool = False) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder, given as a URI or a plain path; ``mapped``: local files are mapped into memory."""
    system, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return (fs.LocalFileSystem(use_mmap=True), base) if mapped and isinstance(system, fs.LocalFileSystem) else (system, base)


def give_back() -> None:
    """Return this worker's freed memory to the system: later stages reuse its process, which would else keep its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def unit(key: Column, salt: Column | str) -> Column:
    """A number in (0, 1) from 52 bits of the key's MD5; a null key counts as the empty text."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), (salt if isinstance(salt, Column) else F.lit(salt)).cast("string"))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def running(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same group that come before this row in ``order``.

    Two passes, so that a group of any size is spread over all tasks: the rows are range-partitioned by group and order
    and written; the totals of each (group, partition) are summed over the partitions; inside a partition a window adds
    the rest. Rows equal in every order column are told apart by their place in the input. Only narrow rows should
    come here. The columns ``_part``, ``_salt`` and ``_before`` are used inside.
    """
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(shuffle_parts(df), *groups, *order, "_salt").withColumn("_part", F.spark_partition_id())
    kept = written(ranged, "ranges")
    totals = kept.groupBy(*groups, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy("_part")
    before = totals.withColumn("_before", F.sum("_sum").over(earlier) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy("_part", *groups).orderBy(*order, "_salt")
    local = kept.withColumn(out, F.sum(value).over(inside) - F.col(value))
    joined = local.join(before, same(local, before, [*groups, "_part"]))
    return joined.select(*[local[c] for c in df.columns], (local[out] + before["_before"]).alias(out))
