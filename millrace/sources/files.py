"""Columnar and nested files, folder classification, and the checks every table passes before use."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

XML_DETECT_BYTES = 64 * 1024 * 1024


class UnusableTable(ValueError):
    """The source has no single, readable table in it."""


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Files, folders or globs; ``col=value`` folders become columns. Any Hadoop URI works (s3a, gs, abfs, http mirrors)."""
    return spark.read.parquet(*paths)


def read_orc(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.orc(list(paths))


def read_with_jar(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    """Avro, Iceberg or Delta, when the session has the connector."""
    try:
        reader = spark.read.format(kind)
        for k, v in options.items():
            reader = reader.option(k, v)
        return reader.load(path)
    except Exception as exc:
        if "DATA_SOURCE_NOT_FOUND" in str(exc) or "Failed to find" in str(exc) or "AVRO" in str(exc):
            raise RuntimeError(f"reading {kind} needs its connector on the classpath (spark.jars.packages)") from exc
        raise


def classify_folders(listing: DataFrame, folder: str, key: str) -> DataFrame:
    """(folder, table_type, metadata_key) from object keys relative to each folder; no file is opened."""
    k = F.regexp_replace(F.col(key), "^/+", "")
    rows = listing.where(~F.col(key).endswith("/")).select(F.col(folder), F.concat(F.lit("/"), k).alias("k"))
    meta = F.col("k").rlike(r"(?i)/metadata/[^/]*\.metadata\.json$")
    parquet = F.lower("k").endswith(".parquet")
    hive = F.col("k").rlike(r"/[^/]+=[^/]+/")
    per = rows.groupBy(folder).agg(
        F.max(F.when(meta, F.substring("k", 2, 1 << 20))).alias("metadata_key"),
        F.max(parquet.cast("int")).alias("p"), F.max((parquet & hive).cast("int")).alias("h"))
    kind = F.when(F.col("metadata_key").isNotNull(), "iceberg").when(F.col("h") == 1, "hive_parquet").when(
        F.col("p") == 1, "parquet_dir").otherwise("unknown")
    every = listing.select(folder).distinct()
    return every.join(per.select(folder, kind.alias("table_type"), "metadata_key"), folder, "left").fillna(
        "empty", ["table_type"])


def folder_listing(spark: SparkSession, root: str) -> DataFrame:
    """Paths and sizes below a folder, read as metadata only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", "modificationTime")


def repeated_groups(schema: T.StructType, prefix: str = "") -> list[str]:
    """Keys that hold a list of records (or of lists): a second table, not a column."""
    found = []
    for f in schema.fields:
        name = prefix + f.name
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StructType, T.ArrayType)):
            found.append(name)
        elif isinstance(f.dataType, T.StructType):
            found += repeated_groups(f.dataType, name + ".")
    return found


def flatten(df: DataFrame) -> DataFrame:
    """Nested records as ``a.b`` columns; a repeated group is refused by name."""
    groups = repeated_groups(df.schema)
    if groups:
        raise UnusableTable(f"repeated groups {groups}: each record holds a list of records, which is a second table")

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here)))
        return out

    return df.select(*leaves(df.schema, ()))


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An array of records, one wrapped array of records, a single record, or (``lines``) one record per line.

    Line-delimited files are splittable; a document that is one JSON value is read by one task per file.
    """
    if lines:
        return flatten(spark.read.json(path))
    df = spark.read.option("multiLine", "true").json(path)
    if "_corrupt_record" in df.columns:
        raise UnusableTable(f"{path} is not a JSON table: expected an array of objects or one such array in an object")
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    if first is not None and first["value"].lstrip("﻿ \t").startswith("{"):
        tables = [f.name for f in df.schema.fields
                  if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        if len(tables) > 1:
            raise UnusableTable(f"{len(tables)} candidate tables ({sorted(tables)}); say which one is meant")
        if tables:
            df = df.select(F.inline(F.col(f"`{tables[0]}`")))
    return flatten(df)


def xml_row_tag(spark: SparkSession, path: str) -> str:
    """The one repeated child of the root; found by reading the root as a row, so only for documents of bounded size."""
    size = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    if size > XML_DETECT_BYTES:
        raise UnusableTable("name the row tag: the document is too large to look for it")
    head = " ".join(r["value"] for r in spark.read.text(path).limit(50).collect())
    root = re.search(r"<([A-Za-z_][\w.\-]*)", re.sub(r"<\?.*?\?>|<!--.*?-->", " ", head))
    if not root:
        raise UnusableTable(f"{path} holds no element")
    schema = spark.read.format("xml").option("rowTag", root.group(1)).load(path).schema
    tags = [f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if len(tags) != 1:
        raise UnusableTable(f"{len(tags)} candidate tables in {path} ({tags}); say which one is meant")
    return tags[0]


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Records of an XML document under the same nesting rule; splittable once the row tag is known."""
    return flatten(spark.read.format("xml").option("rowTag", row_tag or xml_row_tag(spark, path)).load(path))


def reject_unusable(df: DataFrame, name: str) -> DataFrame:
    """The table itself, or an error when its names are unreadable or it has no column or no row."""
    def printable(text: str) -> float:
        return sum(ch.isprintable() and ch != "�" for ch in text) / max(len(text), 1)

    unreadable = [c for c in df.columns if printable(c) < 0.7]
    if df.columns and len(unreadable) > len(df.columns) / 2:
        raise UnusableTable(f"{name}: column names are unreadable; the file is binary, compressed or oddly encoded")
    if not df.columns:
        raise UnusableTable(f"{name} has no usable columns")
    if df.isEmpty():
        raise UnusableTable(f"{name} has column headers but no rows ({', '.join(df.columns[:8])})")
    return df


class Table:
    """The same few questions for any source."""

    def __init__(self, df: DataFrame, order: Sequence[str]):
        self.df, self.order = df, list(order)

    def columns(self) -> list[str]:
        return list(self.df.columns)

    def row_count(self) -> int:
        return self.df.count()

    def row(self, index: int) -> DataFrame:
        from millrace.operators.sampling import row_at

        return row_at(self.df, self.order, index)

    def sample_rows(self, n: int, random: bool = False) -> DataFrame:
        from millrace.operators.sampling import exact_sample

        return exact_sample(self.df, self.order, n) if random else self.df.orderBy(*self.order).limit(n)

    def write(self, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
        self.df.write.format(kind).mode(mode).save(path)
