"""Writing from the test tables and reading back what was committed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.registry import query
from millrace.session import new_path
from millrace.session import read_table as t
from millrace.sources import sinks as W


@query("written_formats", "M1", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, 2 * count(*) AS n, round(2 * sum(s_acctbal), 2) AS total FROM supplier" for k in ("csv", "json", "parquet", "orc")))
def written_formats(spark, sf):
    supplier, out = t(spark, sf, "supplier"), None
    for kind in ("csv", "json", "parquet", "orc"):
        path = new_path(spark, f"written-{kind}")
        W.write_files(supplier, path, kind, "overwrite")
        W.write_files(supplier, path, kind, "append")
        back = spark.read.format(kind).option("header", "true").schema(supplier.schema).load(path)
        row = back.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


@query("partitioned_parquet", "M2", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def partitioned_parquet(spark, sf):
    path = new_path(spark, "partitioned")
    W.write_files(t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, by=["o_orderstatus"], compression="snappy")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("staged_commits", "M3", "SELECT count(*) AS n, count(DISTINCT c_custkey) AS keys FROM customer WHERE c_acctbal > 0")
def staged_commits(spark, sf):
    customer, target = t(spark, sf, "customer"), new_path(spark, "committed")
    W.staged_write(customer, target, "first", "append")
    W.staged_write(customer.where("c_acctbal > 5000"), target, "second", "overwrite")
    for _ in range(2):  # a retry of the same job changes nothing
        W.staged_write(customer.where("c_acctbal > 0 and c_acctbal <= 5000"), target, "third", "append")
    return W.read_committed(spark, target).agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("keys"))


@query("empty_overwrite_refused", "M4 M5", "SELECT count(*) AS n, 2 AS refused FROM customer")
def empty_overwrite_refused(spark, sf):
    customer, target = t(spark, sf, "customer"), new_path(spark, "kept")
    W.staged_write(customer, target, "load")
    refused = 0
    for attempt in (lambda: W.staged_write(customer.where("c_acctbal > 1e12"), target, "wipe", "overwrite"),
                    lambda: W.refuse_empty_source(customer, F.col("c_mktsegment") == "NOWHERE")):
        try:
            attempt()
        except W.RefusedWrite:
            refused += 1
    return W.read_committed(spark, target).agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@query("destination_checks", "M6 M7 I10", """
SELECT 'C_Extra' AS "column", 'missing' AS problem FROM customer UNION SELECT 'c_name', 'string into numeric' FROM customer
""")
def destination_checks(spark, sf):
    result = t(spark, sf, "customer").withColumn("C_Extra", F.lit(1))
    destination = T.StructType([T.StructField(n, k) for n, k in (
        ("C_CUSTKEY", T.LongType()), ('"c_name"', T.DoubleType()), ("c_nationkey", T.IntegerType()), ("c_acctbal", T.DoubleType()),
        ("c_mktsegment", T.StringType()), ("loaded_at", T.TimestampType()))])
    rows = [(c, "missing") for c in W.missing_in_destination(result, destination)]
    rows += [(c, f"{a} into {b}") for c, a, b in W.type_conflicts(result, destination)]
    return spark.createDataFrame(rows, "column string, problem string")


@query("create_table_text", "M8", """
SELECT 'CREATE TABLE "orders" ("o_orderkey" BIGINT, "o_custkey" BIGINT, "o_orderstatus" TEXT, "o_totalprice" DOUBLE PRECISION, "o_orderdate" TIMESTAMP, "o_orderpriority" TEXT)' AS sql FROM orders LIMIT 1
""")
def create_table_text(spark, sf):
    sql = W.create_table_sql("orders", t(spark, sf, "orders").schema)
    return spark.createDataFrame([(sql,)], "sql string")


@query("transferred_table", "M9", """
SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
""")
def transferred_table(spark, sf):
    target = new_path(spark, "transfer")
    schema = T.StructType([T.StructField("O_ORDERPRIORITY", T.StringType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
    W.transfer(t(spark, sf, "orders"), lambda df: df.groupBy("o_orderpriority").agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n")), target, "nightly", "overwrite",
        F.col("o_orderstatus") == "F", schema)
    return W.read_committed(spark, target)
