"""Reading files that Spark wrote from the test tables, and listing, sampling and limiting tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from millrace.operators import sampling as S
from millrace.plans.registry import query
from millrace.session import new_path
from millrace.session import read_table as t
from millrace.sources import collections as K
from millrace.sources import database as B
from millrace.sources import delimited as D
from millrace.sources import files as L

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
#: Rows of a file, and of the task that writes it, where a table is written as many files.
ROWS_PER_FILE = 250_000


def _written(spark, df, label, fmt="csv", **options):
    path = new_path(spark, label)
    df.write.format(fmt).options(**options).save(path)
    return path


@query("read_semicolon_text", "A1 A15", CUSTOMER)
def read_semicolon_text(spark, sf):
    path = _written(spark, t(spark, sf, "customer"), "semicolons", header="true", sep=";")
    return D.type_columns(D.read_delimited(spark, path))


@query("read_latin1_text", "A2", "SELECT c_custkey, 'Café ' || c_mktsegment AS place FROM customer")
def read_latin1_text(spark, sf):
    rows = t(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Café "), "c_mktsegment").alias("place"))
    path = _written(spark, rows, "latin1", header="true", encoding="ISO-8859-1")
    return D.type_columns(D.read_delimited(spark, path))


@query("read_strict_rows", "A3", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 9 <> 0")
def read_strict_rows(spark, sf):
    k = F.col("c_custkey")
    line = F.concat_ws(",", k.cast("string"), "c_mktsegment")
    body = t(spark, sf, "customer").select(F.when(k % 9 == 0, F.concat(line, F.lit(",extra"))).otherwise(line).alias("value"))
    head = spark.createDataFrame([("c_custkey,c_mktsegment",)], "value string")
    path = _written(spark, head.union(body).coalesce(1), "ragged", "text")
    return D.type_columns(D.read_delimited(spark, path, ",", strict=True))


@query("null_words_kept_as_labels", "A4", """
SELECT CASE c_custkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'NA' WHEN 2 THEN c_mktsegment END AS method, count(*) AS n, count(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END) AS amounts,
 round(sum(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END), 2) AS total FROM customer GROUP BY 1
""")
def null_words_kept_as_labels(spark, sf):
    k = F.col("c_custkey")
    rows = t(spark, sf, "customer").select(
        k, F.when(k % 4 == 0, "None").when(k % 4 == 1, "NA").when(k % 4 == 2, F.col("c_mktsegment")).alias("method"),
        F.when(k % 3 == 0, "N/A").otherwise(F.col("c_acctbal").cast("string")).alias("amount"))
    typed = D.type_columns(D.read_delimited(spark, _written(spark, rows, "nullwords", header="true")))
    return typed.groupBy("method").agg(F.count("*").alias("n"), F.count("amount").alias("amounts"),
                                       F.round(F.sum("amount"), 2).alias("total"))


@query("blank_columns_dropped", "A5", "SELECT c_custkey, c_name FROM customer")
def blank_columns_dropped(spark, sf):
    rows = t(spark, sf, "customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("Unnamed: 2"))
    return D.drop_blank_columns(rows)[0]


@query("read_parquet_folder", "A6", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders, round(sum(l_extendedprice), 2) AS total FROM lineitem")
def read_parquet_folder(spark, sf):
    lines = t(spark, sf, "lineitem")
    files = max(6, math.ceil(lines.count() / ROWS_PER_FILE))
    path = _written(spark, lines.repartition(files), "many-files", "parquet")
    rows = L.read_parquet(spark, f"{path}/*.parquet")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("read_hive_partitions", "A7", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def read_hive_partitions(spark, sf):
    path = new_path(spark, "by-status")
    t(spark, sf, "orders").write.partitionBy("o_orderstatus").parquet(path)
    return L.read_parquet(spark, path).where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("classified_folders", "A8", """
SELECT 'f' || (p_size % 5) AS folder, CASE p_size % 5 WHEN 0 THEN 'iceberg' WHEN 1 THEN 'hive_parquet' WHEN 2 THEN 'parquet_dir' WHEN 3 THEN 'unknown' ELSE 'empty' END AS table_type,
 CASE WHEN p_size % 5 = 0 THEN max('metadata/v' || lpad(p_partkey::VARCHAR, 8, '0') || '.metadata.json') END AS metadata_key FROM part GROUP BY p_size % 5
""")
def classified_folders(spark, sf):
    kind, number = F.col("p_size") % 5, F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    key = (F.when(kind == 0, F.concat(F.lit("metadata/v"), number, F.lit(".metadata.json")))
           .when(kind == 1, F.concat(F.lit("/day="), number, F.lit("/a.parquet"))).when(kind == 2, F.concat(number, F.lit(".parquet")))
           .when(kind == 3, F.concat(number, F.lit(".log"))).otherwise("sub/"))
    listing = t(spark, sf, "part").select(F.concat(F.lit("f"), kind.cast("string")).alias("folder"), key.alias("key"))
    return L.classify_folders(listing, "folder", "key")


NESTED = "SELECT c_custkey AS id, c_mktsegment AS \"where.segment\", c_nationkey::BIGINT AS \"where.nation\" FROM customer"


@query("read_nested_json", "A9", NESTED)
def read_nested_json(spark, sf):
    rows = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.struct(
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("where"))
    return L.read_json(spark, _written(spark, rows, "nested", "json"), lines=True)


@query("read_nested_xml", "A10", NESTED)
def read_nested_xml(spark, sf):
    rows = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.struct(
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("where"))
    path = _written(spark, rows, "xml", "xml", rootTag="customers", rowTag="customer")
    return L.read_xml(spark, path, "customer")


@query("read_orc", "A11", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def read_orc(spark, sf):
    return L.read_orc(spark, _written(spark, t(spark, sf, "supplier"), "orc", "orc")).select("s_suppkey", "s_name", "s_acctbal")


@query("flattened_documents", "A16", """
SELECT event_id, (props->>'$.k') AS k, event_type FROM events
""")
def flattened_documents(spark, sf):
    return K.flatten_documents(t(spark, sf, "events").select("event_id", "event_type", "props"), "props")


@query("document_key_kinds", "A16", "SELECT 'k' AS key, 'int' AS kind, count(*) AS n FROM events WHERE props->>'$.k' IS NOT NULL")
def document_key_kinds(spark, sf):
    return K.key_kinds(t(spark, sf, "events"), "props")


@query("collection_query", "A17", """
SELECT event_id, k FROM (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events) WHERE k > 90 ORDER BY k DESC, event_id LIMIT 100
""")
def collection_query(spark, sf):
    flat = K.flatten_documents(t(spark, sf, "events"), "props").withColumn("k", F.col("k").cast("bigint"))
    return K.run_spec(flat, {"filter": "k > 90", "projection": ["event_id", "k"], "sort": [("k", -1), ("event_id", 1)], "limit": 100})


@query("limited_query", "A18", "SELECT n FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority) ORDER BY n LIMIT 1000")
def limited_query(spark, sf):
    t(spark, sf, "orders").createOrReplaceTempView("millrace_orders")
    return B.limited_query(spark, "SELECT count(*) AS n FROM millrace_orders GROUP BY o_orderpriority;", 1000)


@query("random_rows", "A19", "SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey::VARCHAR), c_custkey LIMIT 50")
def random_rows(spark, sf):
    return S.exact_sample(t(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"], 50)


@query("described_table", "A20", """
SELECT (row_number() OVER () - 1)::INTEGER AS position, column_name AS "column", CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS type FROM (DESCRIBE SELECT * FROM nation)
""")
def described_table(spark, sf):
    t(spark, sf, "nation").createOrReplaceTempView("millrace_nation")
    return B.describe_table(spark, "millrace_nation").select("position", "column", "type")


@query("row_lookup", "A21", "SELECT count(*) AS n_rows, (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 100) AS at_100 FROM orders")
def row_lookup(spark, sf):
    table = L.Table(t(spark, sf, "orders"), ["o_totalprice", "o_orderkey"])
    return table.row(100).select(F.lit(table.row_count()).cast("bigint").alias("n_rows"), F.col("o_orderkey").alias("at_100"))


@query("usable_table", "A22", "SELECT count(*) AS n FROM nation")
def usable_table(spark, sf):
    return L.reject_unusable(t(spark, sf, "nation"), "nation").agg(F.count("*").alias("n"))


@query("consistent_delimiter", "A23", "SELECT '|' AS delimiter, 4 AS width, count(*) AS rows FROM supplier")
def consistent_delimiter(spark, sf):
    line = F.concat_ws("|", F.col("s_suppkey").cast("string"), F.concat("s_name", F.lit(", Ltd")), F.col("s_nationkey").cast("string"), F.col("s_acctbal").cast("string"))
    return D.consistent_delimiter(t(spark, sf, "supplier").select(line.alias("value")))


@query("header_below_title", "A24", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def header_below_title(spark, sf):
    body = t(spark, sf, "supplier").select(F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name", F.col("s_acctbal").cast("string")).alias("value"))
    head = spark.createDataFrame([("Supplier report",), ("",), ("s_suppkey,s_name,s_acctbal",)], "value string").coalesce(1)
    path = _written(spark, head.union(body).coalesce(1), "titled", "text")
    return D.type_columns(D.read_delimited(spark, path))


@query("split_reads_are_exact", "A25", "SELECT count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem")
def split_reads_are_exact(spark, sf):
    path = _written(spark, t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").coalesce(1), "one-file", header="true")
    rows = spark.read.option("header", "true").schema("l_orderkey long, l_linenumber int").csv(path)
    return rows.agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("records_of_several_lines", "A1 A25", "SELECT doc_id, md5(text) AS digest, length(text) AS n_chars, lang FROM documents")
def records_of_several_lines(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "text", "lang")
    path = _written(spark, rows, "several-lines", header="true", escape='"', quoteAll="true", emptyValue="")
    read = D.read_delimited(spark, path)
    return read.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("digest"), F.char_length("text").cast("bigint").alias("n_chars"), "lang")
