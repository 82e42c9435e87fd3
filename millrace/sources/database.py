"""Databases over JDBC, catalog questions and read-only, row-limited SQL."""

from __future__ import annotations

import re
from urllib.parse import quote_plus, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dialect names and how each limits and shuffles rows.
ROW_LIMIT = {
    "mssql": "SELECT TOP {n} * FROM ({q}) AS limited", "oracle": "SELECT * FROM ({q}) WHERE ROWNUM <= {n}",
    "default": "SELECT * FROM ({q}) AS limited LIMIT {n}",
}
RANDOM_ROWS = {
    "postgresql": "SELECT * FROM ({q}) AS base ORDER BY RANDOM() LIMIT {n}",
    "sqlite": "SELECT * FROM ({q}) AS base ORDER BY RANDOM() LIMIT {n}",
    "mysql": "SELECT * FROM ({q}) AS base ORDER BY RAND() LIMIT {n}",
    "mssql": "SELECT TOP {n} * FROM ({q}) AS base ORDER BY NEWID()",
    "oracle": "SELECT * FROM (SELECT * FROM ({q}) ORDER BY DBMS_RANDOM.VALUE) WHERE ROWNUM <= {n}",
}
READ_WORDS = ("select", "with", "show", "describe", "explain", "values")


def jdbc_url(kind: str, host: str, database: str, port: int | None = None, user: str = "", password: str = "") -> str:
    scheme = {"postgres": "postgresql", "mssql": "sqlserver"}.get(kind, kind)
    place = f"{host}:{port}" if port else host
    if scheme == "sqlserver":
        url = f"jdbc:sqlserver://{place};databaseName={database}"
        return url + (f";user={user};password={password}" if user else "")
    url = f"jdbc:{scheme}://{place}/{database}"
    return url + (f"?user={quote_plus(user)}&password={quote_plus(password)}" if user else "")


def split_target(uri: str) -> tuple[str, str, str]:
    """(url, "table" or "query", name or SQL) from ``url#table`` or ``url#query=...``."""
    url, mark, target = uri.partition("#")
    if not mark or not target:
        raise ValueError("name a table (#table) or a query (#query=...) after the database URL")
    if target.startswith("query="):
        return url, "query", unquote(target[len("query="):])
    return url, "table", target


def read_database(
    spark: SparkSession, uri: str, split_on: str | None = None, low: int | None = None, high: int | None = None,
    parts: int = 64, **options: str,
) -> DataFrame:
    """A table or query as a DataFrame; with ``split_on`` the table is read by ``parts`` tasks over key ranges."""
    url, kind, target = split_target(uri)
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if kind == "query":
        return reader.option("query", require_read_only(target)).load()
    reader = reader.option("dbtable", target)
    if split_on:
        reader = reader.option("partitionColumn", split_on).option("lowerBound", str(low)).option(
            "upperBound", str(high)).option("numPartitions", str(parts))
    return reader.load()


def require_read_only(sql: str) -> str:
    text = sql.strip().rstrip(";")
    if not text or text.split()[0].lower() not in READ_WORDS or ";" in re.sub(r"'[^']*'", "", text):
        raise ValueError("only a single read-only statement is accepted")
    return text


def limited_sql(sql: str, rows: int, dialect: str = "default") -> str:
    return ROW_LIMIT.get(dialect, ROW_LIMIT["default"]).format(q=require_read_only(sql), n=int(rows))


def random_rows_sql(sql: str, rows: int, dialect: str) -> str:
    if dialect not in RANDOM_ROWS:
        raise ValueError(f"no random order known for {dialect!r}")
    return RANDOM_ROWS[dialect].format(q=require_read_only(sql), n=int(rows))


def limited_query(spark: SparkSession, sql: str, rows: int) -> DataFrame:
    """Read-only SQL over the session's tables, cut to ``rows``."""
    return spark.sql(limited_sql(sql, rows))


def list_tables(spark: SparkSession) -> DataFrame:
    rows = [(t.name, bool(t.isTemporary)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, is_temporary boolean").orderBy("name")


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """(position, column, type, nullable); an unknown table is an error."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"unknown table {name!r}")
    fields = spark.table(name).schema.fields
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def table_sizes(spark: SparkSession, names: list[str]) -> DataFrame:
    out = None
    for n in names:
        one = spark.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out
