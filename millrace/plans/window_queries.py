"""Windows, sorts and set operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import windows as W
from millrace.plans.registry import query
from millrace.session import read_table as t


@query("running_total", "I1", """
SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders
""")
def running_total(spark, sf):
    df = W.running_total(t(spark, sf, "orders"), F.col("o_totalprice").cast("decimal(18,2)"), "running", ["o_orderdate", "o_orderkey"])
    return df.select("o_orderkey", F.round(F.col("running").cast("double"), 2).alias("running"))


@query("running_total_sliced", "I1", """
SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders
""")
def running_total_sliced(spark, sf):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    df = W.running_total(t(spark, sf, "orders"), price, "running", ["o_orderdate", "o_orderkey"], split_above=0)
    return df.select("o_orderkey", F.round(F.col("running").cast("double"), 2).alias("running"))


@query("monthly_cumulative", "I1", """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT month, round(total, 2) AS total, round(sum(total) OVER (ORDER BY month), 2) AS running_total FROM m
""")
def monthly_cumulative(spark, sf):
    orders = t(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").alias("total"))
    df = W.cumulative_by_group(orders, "month", "total")
    return df.select("month", F.round("total", 2).alias("total"), F.round("running_total", 2).alias("running_total"))


LAG_SQL = """
SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""


@query("lag_lead", "I2", LAG_SQL)
def lag_lead(spark, sf):
    df = t(spark, sf, "events")
    df = W.shifted(df, "value", "before", ["ts", "event_id"], ["user_id"], 1)
    return W.shifted(df, "value", "after", ["ts", "event_id"], ["user_id"], -1).select("event_id", "before", "after")


@query("lag_sliced", "I2", LAG_SQL.replace(", lead(value) OVER w AS after", ""))
def lag_sliced(spark, sf):
    return W.shifted(t(spark, sf, "events"), "value", "before", ["ts", "event_id"], ["user_id"], 1, split_above=0).select("event_id", "before")


WEEKLY = """
WITH k AS (SELECT o_orderpriority AS p, datediff('day', DATE '1990-01-01', o_orderdate::DATE) // 7 AS week, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
"""


def _weekly(spark, sf):
    week = F.floor(F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")) / 7)
    return t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), week.alias("week")).agg(F.sum("o_totalprice").alias("total"))


@query("trailing_mean", "I3", WEEKLY + """
SELECT p, week, round(avg(total) OVER (PARTITION BY p ORDER BY week ROWS 3 PRECEDING), 5) AS trailing FROM k
""")
def trailing_mean(spark, sf):
    return W.trailing_mean(_weekly(spark, sf), "total", "trailing", ["week"], ["p"], 4).select("p", "week", F.round("trailing", 5).alias("trailing"))


@query("year_over_year", "I3", WEEKLY + """
SELECT a.p, a.week, round(a.total - b.total, 2) AS change, round((a.total - b.total) / b.total, 6) AS change_pct FROM k a LEFT JOIN k b ON a.p = b.p AND a.week = b.week + 52
""")
def year_over_year(spark, sf):
    df = W.year_over_year(_weekly(spark, sf), "week", "total", ["p"], 52)
    return df.select("p", "week", F.round("change", 2).alias("change"), F.round("change_pct", 6).alias("change_pct"))


@query("rank_columns", "I4", """
SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)::INTEGER AS rn,
 rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC)::INTEGER AS rk, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC)::INTEGER AS dr FROM supplier
""")
def rank_columns(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"))
    unique = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return t(spark, sf, "supplier").select("s_suppkey", F.row_number().over(unique).alias("rn"), F.rank().over(w).alias("rk"),
                                           F.dense_rank().over(w).alias("dr"))


@query("multi_key_sort", "I5", "SELECT s_nationkey, s_name, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_name")
def multi_key_sort(spark, sf):
    return t(spark, sf, "supplier").orderBy("s_nationkey", F.desc("s_acctbal"), "s_name").select("s_nationkey", "s_name", "s_acctbal")


@query("top_by_measure", "I6", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_by_measure(spark, sf):
    return t(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("top_per_group", "I6", """
SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS position FROM orders) WHERE position <= 5
""")
def top_per_group(spark, sf):
    orders = t(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return W.top_per_group(orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


@query("appended_tables", "I7", """
SELECT kind, count(*) AS n, count(segment) AS with_segment, round(sum(balance), 2) AS balance FROM
 (SELECT 'customer' AS kind, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_acctbal, NULL FROM supplier) GROUP BY 1
""")
def appended_tables(spark, sf):
    a = t(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count("segment").alias("with_segment"), F.round(F.sum("balance"), 2).alias("balance"))


@query("distinct_values", "I8", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_values(spark, sf):
    return t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("union_of_ids", "I9", """
SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def union_of_ids(spark, sf):
    a = t(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    b = t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return a.union(b).distinct()


@query("set_difference", "I10", """
SELECT c_custkey AS id, 'no_order' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL (SELECT o_custkey, 'both' FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, 'both' FROM orders WHERE o_orderstatus = 'P')
""")
def set_difference(spark, sf):
    orders, customer = t(spark, sf, "orders"), t(spark, sf, "customer")
    lone = customer.join(orders, customer.c_custkey == orders.o_custkey, "left_anti").select(F.col("c_custkey").alias("id"))
    f = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    p = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return lone.withColumn("kind", F.lit("no_order")).unionByName(f.intersect(p).withColumn("kind", F.lit("both")))


FILL_SQL = """
WITH d AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS forward,
 first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM d
"""


def _filled(spark, sf, **kw):
    v = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    df = t(spark, sf, "events").select("event_id", "user_id", "ts", v.alias("forward"), v.alias("backward"))
    df = W.fill_along(df, "forward", ["ts", "event_id"], ["user_id"], **kw)
    return W.fill_along(df, "backward", ["ts", "event_id"], ["user_id"], backward=True, **kw).select("event_id", "forward", "backward")


@query("fill_along_time", "C11", FILL_SQL)
def fill_along_time(spark, sf):
    return _filled(spark, sf)


@query("fill_along_time_sliced", "C11", FILL_SQL)
def fill_along_time_sliced(spark, sf):
    return _filled(spark, sf, split_above=0)


@query("percentiles_by_rank", "D12", """
SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1
""")
def percentiles_by_rank(spark, sf):
    probs = {"p25": 0.25, "p50": 0.5, "p99": 0.99}
    df = W.percentiles(t(spark, sf, "lineitem"), "l_extendedprice", probs, ["l_returnflag"], split_above=0)
    return df.select("l_returnflag", "n", *[F.round(p, 6).alias(p) for p in probs])
