"""Joins on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import joins as J
from millrace.plans.registry import query
from millrace.session import read_table as t


@query("left_join_on_keys", "H1 H4", """
SELECT n_name, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def left_join_on_keys(spark, sf):
    joined = J.equi_join(t(spark, sf, "customer"), t(spark, sf, "orders"), ["c_custkey"], ["o_custkey"], "left")
    joined = J.equi_join(joined, t(spark, sf, "nation"), ["c_nationkey"], ["n_nationkey"])
    return joined.groupBy("n_name").agg(F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("share_with_match", "H2", """
SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS matched,
 round(count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) / count(*), 6) AS share FROM customer
""")
def share_with_match(spark, sf):
    open_orders = t(spark, sf, "orders").where("o_orderstatus = 'P'")
    return J.share_with_match(t(spark, sf, "customer"), open_orders, "c_custkey", "o_custkey").withColumn("share", F.round("share", 6))


@query("guarded_pairs", "H3", "SELECT r_name, n_name, r_regionkey = n_regionkey AS same FROM region, nation")
def guarded_pairs(spark, sf):
    pairs = J.every_pair(t(spark, sf, "region"), t(spark, sf, "nation"))
    return pairs.select("r_name", "n_name", (F.col("r_regionkey") == F.col("n_regionkey")).alias("same"))


KEY_SQL = """
WITH c AS (SELECT DISTINCT lower(c_custkey::VARCHAR) AS v FROM customer), o AS (SELECT DISTINCT lower(o_custkey::VARCHAR) AS v FROM orders),
 s AS (SELECT (SELECT count(*) FROM c JOIN o USING (v)) / least((SELECT count(*) FROM c), (SELECT count(*) FROM o)) AS mr,
  (SELECT count(*) FROM c) / (SELECT count(*) FROM customer) AS ua, (SELECT count(*) FROM o) / (SELECT count(*) FROM orders) AS ub)
SELECT 'customers' AS left_dataset, 'orders' AS right_dataset, 'cust_id' AS left_key, 'CustID' AS right_key,
 round(least(1.0, 0.65 + 0.35 * least(1.0, mr * 1.2) + 0.15 * least(1.0, (ua + ub) / 2) + 0.10), 2)::DOUBLE AS confidence, round(mr, 2)::DOUBLE AS match_rate FROM s
"""


@query("join_key_suggestions", "H5", KEY_SQL)
def join_key_suggestions(spark, sf):
    customers = t(spark, sf, "customer").select(F.col("c_custkey").alias("cust_id"), F.col("c_acctbal").alias("balance"))
    orders = t(spark, sf, "orders").select(F.col("o_custkey").alias("CustID"), F.col("o_totalprice").alias("amount"))
    return J.suggest_join_keys({"customers": customers, "orders": orders})


@query("comparison_without_key", "H5", """
SELECT 'part' AS dataset, count(*) AS n_rows, 6 AS n_columns, 'p_brand,p_name,p_partkey,p_retailprice,p_size,p_type' AS columns FROM part
UNION ALL SELECT 'region', count(*), 2, 'r_name,r_regionkey' FROM region
""")
def comparison_without_key(spark, sf):
    return J.comparison_table({"part": t(spark, sf, "part"), "region": t(spark, sf, "region")})


@query("item_cosine", "H7", """
WITH d AS (SELECT DISTINCT l_suppkey AS k, l_returnflag || l_linenumber::VARCHAR AS i FROM lineitem), n AS (SELECT i, count(*) AS n FROM d GROUP BY 1)
SELECT a.i AS a, b.i AS b, count(*) AS together, round(count(*) / sqrt(max(x.n)::DOUBLE * max(y.n)), 6) AS similarity
FROM d a JOIN d b ON a.k = b.k AND a.i < b.i JOIN n x ON x.i = a.i JOIN n y ON y.i = b.i GROUP BY 1, 2
""")
def item_cosine(spark, sf):
    baskets = t(spark, sf, "lineitem").select("l_suppkey", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("item"))
    return J.cosine_pairs(baskets, "l_suppkey", "item", parts=4).withColumn("similarity", F.round("similarity", 6))


@query("order_part_cosine", "H7", """
WITH d AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS i FROM lineitem), n AS (SELECT i, count(*) AS n FROM d GROUP BY 1)
SELECT a.i AS a, b.i AS b, count(*) AS together, round(count(*) / sqrt(max(x.n)::DOUBLE * max(y.n)), 6) AS similarity
FROM d a JOIN d b ON a.k = b.k AND a.i < b.i JOIN n x ON x.i = a.i JOIN n y ON y.i = b.i GROUP BY 1, 2 HAVING count(*) >= 2
""")
def order_part_cosine(spark, sf):
    return J.cosine_pairs(t(spark, sf, "lineitem"), "l_orderkey", "l_partkey", at_least=2).withColumn("similarity", F.round("similarity", 6))


@query("tolerance_join", "H8", """
SELECT DISTINCT a.x FROM (SELECT DISTINCT round(c_acctbal / 7, 1) AS x FROM customer) a
WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT s_acctbal AS k FROM supplier) b WHERE abs(a.x - b.k) <= greatest(0.01, abs(b.k) * 0.01))
""")
def tolerance_join(spark, sf):
    stated = t(spark, sf, "customer").select(F.round(F.col("c_acctbal") / 7, 1).alias("x"))
    return J.within_tolerance(stated, "x", t(spark, sf, "supplier"), "s_acctbal")


@query("merged_metrics", "H9", """
SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean_price, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1
""")
def merged_metrics(spark, sf):
    parts = [{"mean_price": ("mean", "o_totalprice")}, {"n": ("count", None), "customers": ("count_distinct", "o_custkey")}]
    return J.merge_metrics(t(spark, sf, "orders"), ["o_orderpriority"], parts).withColumn("mean_price", F.round("mean_price", 4))


@query("date_grain_join", "H10", """
WITH y AS (SELECT year(l_shipdate)::INT AS yr, round(sum(l_quantity), 2) AS shipped FROM lineitem GROUP BY 1)
SELECT yr, shipped, count(*) AS orders FROM orders JOIN y ON year(o_orderdate) = yr GROUP BY 1, 2
""")
def date_grain_join(spark, sf):
    by_year = t(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("yr")).agg(F.round(F.sum("l_quantity"), 2).alias("shipped"))
    joined = J.join_at_date_grain(t(spark, sf, "orders"), by_year, "o_orderdate", "year", "yr")
    return joined.groupBy("yr", "shipped").agg(F.count("*").alias("orders"))


@query("code_label_hint", "H11", "SELECT 'lang' AS code_column, 'c_label' AS label_column, 'left' AS code_side FROM customer LIMIT 1")
def code_label_hint(spark, sf):
    docs = t(spark, sf, "documents").select(F.upper("lang").alias("lang"), "source")
    labels = t(spark, sf, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit(" group")).alias("c_label"), "c_acctbal")
    return J.code_label_pairs(docs, labels)
