"""Aggregation operators bound to the test tables, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.operators import windows as W
from millrace.plans.registry import query
from millrace.session import read_table as t


@query("column_summary", "D1", """
SELECT "column", count(x) AS non_null, round(sum(x), 2) AS sum, round(avg(x), 4) AS mean, round(median(x), 6) AS median,
       min(x) AS min, max(x) AS max, round(max(x) - min(x), 4) AS range, count(x)::DOUBLE AS count
FROM (SELECT 'l_quantity' AS "column", l_quantity AS x FROM lineitem
      UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
      UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
GROUP BY "column"
""")
def column_summary(spark, sf):
    df = A.column_summary(
        t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"],
        ["sum", "mean", "median", "min", "max", "range", "count"])
    return df.withColumn("sum", F.round("sum", 2)).withColumn("mean", F.round("mean", 4)).withColumn(
        "range", F.round("range", 4))


@query("group_totals", "D2 H1", """
SELECT c_mktsegment AS "group", round(sum(o_totalprice), 2) AS value
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_mktsegment ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10
""")
def group_totals(spark, sf):
    joined = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    df = A.group_comparison(joined, "c_mktsegment", "o_totalprice", how="sum")
    return df.withColumn("value", F.round("value", 2))


@query("group_means_null_cut", "D2", """
WITH r AS (SELECT nullif(p_brand, 'Brand#7') AS g, round(avg(p_retailprice), 6) AS value,
                  avg(p_retailprice) AS raw
           FROM part GROUP BY 1 ORDER BY raw DESC NULLS LAST, g NULLS FIRST LIMIT 10)
SELECT g AS "group", value FROM r WHERE g IS NOT NULL
""")
def group_means_null_cut(spark, sf):
    part = t(spark, sf, "part").withColumn("brand", F.nullif("p_brand", F.lit("Brand#7")))
    return A.group_comparison(part, "brand", "p_retailprice", how="mean")


@query("group_row_counts", "D2 I6", """
SELECT p_brand AS "group", count(*)::DOUBLE AS value FROM part
GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10
""")
def group_row_counts(spark, sf):
    return A.group_comparison(t(spark, sf, "part"), "p_brand")


@query("metric_actions", "D3 D4", """
SELECT l_returnflag, nullif(l_linestatus, 'F') AS status, round(avg(l_quantity), 4) AS mean_qty,
       median(l_quantity) AS median_qty, round(sum(l_extendedprice), 2) AS total_price, count(l_tax) AS n_tax,
       count(DISTINCT l_suppkey) AS n_suppliers, min(l_discount) AS min_disc, max(l_discount) AS max_disc,
       round(stddev_samp(l_quantity), 6) AS std_qty, count(*) AS n_rows
FROM lineitem GROUP BY 1, 2
""")
def metric_actions(spark, sf):
    keys = ["l_returnflag", "status"]
    wanted = [
        ("mean_qty", "mean", "l_quantity"), ("median_qty", "median", "l_quantity"),
        ("total_price", "sum", "l_extendedprice"), ("n_tax", "count", "l_tax"),
        ("n_suppliers", "count_distinct", "l_suppkey"), ("min_disc", "min", "l_discount"),
        ("max_disc", "max", "l_discount"), ("std_qty", "std", "l_quantity"), ("n_rows", "count", None),
        ("bad", "mean", "l_returnflag"),
    ]
    actions = [{"name": n, "operation": op, "column": c, "group_by": keys} for n, op, c in wanted]
    line = t(spark, sf, "lineitem").withColumn("status", F.nullif("l_linestatus", F.lit("F")))
    tables, _ = A.run_metric_actions(line, actions)
    df = tables[tuple(keys)]
    return df.withColumn("mean_qty", F.round("mean_qty", 4)).withColumn(
        "total_price", F.round("total_price", 2)).withColumn("std_qty", F.round("std_qty", 6))


@query("grouped_multi_aggregate", "D5 D6 P4", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean,
       round(stddev_samp(o_totalprice), 3) AS std, round(var_samp(o_totalprice) / 1e6, 4) AS var_millions,
       count(DISTINCT o_custkey) AS customers, arg_min(o_totalprice, o_orderkey) AS first_price,
       arg_max(o_totalprice, o_orderkey) AS last_price,
       round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS total_f
FROM orders GROUP BY o_orderpriority
""")
def grouped_multi_aggregate(spark, sf):
    x = F.col("o_totalprice")
    return t(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.sum(x), 2).alias("total"), F.round(F.avg(x), 4).alias("mean"),
        F.round(F.stddev_samp(x), 3).alias("std"), F.round(F.var_samp(x) / 1e6, 4).alias("var_millions"),
        F.countDistinct("o_custkey").alias("customers"), F.min_by(x, "o_orderkey").alias("first_price"),
        F.max_by(x, "o_orderkey").alias("last_price"),
        F.round(F.sum(F.when(F.col("o_orderstatus") == "F", x)), 2).alias("total_f"))


@query("flag_above_group_mean", "D7", """
SELECT o_orderstatus, o.is_high, count(*) AS n FROM
 (SELECT a.*, o_totalprice > m * 1.5 AS is_high FROM orders a
  JOIN (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1) b ON a.o_custkey = b.o_custkey) o
GROUP BY 1, 2
""")
def flag_above_group_mean(spark, sf):
    flagged = A.aggregate_and_flag(t(spark, sf, "orders"), ["o_custkey"], "o_totalprice", 1.5)
    return flagged.groupBy("o_orderstatus", "is_high").agg(F.count("*").alias("n"))


@query("monthly_trend", "D8", """
SELECT strftime(o_orderdate, '%Y-%m') AS period, round(avg(o_totalprice), 4) AS value FROM orders
WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1
""")
def monthly_trend(spark, sf):
    return A.monthly_trend(t(spark, sf, "orders"), "o_orderdate", "o_totalprice").withColumn(
        "value", F.round("value", 4))


@query("monthly_trend_change", "D8", """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1)
SELECT min(period) AS first_period, arg_min(value, period) AS first_value, max(period) AS last_period,
       arg_max(value, period) AS last_value, count(*) AS n_months,
       round(arg_max(value, period) - arg_min(value, period), 1) AS change FROM m
""")
def monthly_trend_change(spark, sf):
    monthly = A.monthly_trend(t(spark, sf, "orders"), "o_orderdate", "o_totalprice", "sum")
    return A.trend_change(monthly.withColumn("value", F.round("value", 2))).withColumn("change", F.round("change", 1))


@query("missingness", "D9", """
WITH c AS (
 SELECT 'doc_id' AS "column", count(*) - count(d.doc_id) AS missing, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id)
 UNION ALL SELECT 'lang', count(*) - count(lang), count(*) FROM documents LEFT JOIN labels USING (doc_id)
 UNION ALL SELECT 'source', count(*) - count(source), count(*) FROM documents LEFT JOIN labels USING (doc_id)
 UNION ALL SELECT 'quality', count(*) - count(quality), count(*) FROM documents LEFT JOIN labels USING (doc_id)
 UNION ALL SELECT 'toxic', count(*) - count(toxic), count(*) FROM documents LEFT JOIN labels USING (doc_id))
SELECT "column", missing, round(missing / n * 100, 6) AS missing_pct FROM c ORDER BY missing DESC, "column" LIMIT 10
""")
def missingness(spark, sf):
    joined = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    return A.missingness(joined, ["doc_id", "lang", "source", "quality", "toxic"])


PAIRS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
PAIR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS r FROM lineitem"
    for i, a in enumerate(PAIRS) for b in PAIRS[i + 1:])


@query("correlation_top_pairs", "D10", f"""
SELECT "left", "right", round(r, 6) AS r FROM ({PAIR_SQL}) ORDER BY abs(round(r, 6)) DESC, 1, 2 LIMIT 5
""")
def correlation_top_pairs(spark, sf):
    return A.strongest_pairs(t(spark, sf, "lineitem"), PAIRS)


@query("correlation_flagged_pairs", "D10", f"""
WITH p AS (SELECT "left", "right", round(abs(r), 4) AS corr FROM ({PAIR_SQL}))
SELECT * FROM p WHERE corr >= 0.9 OR (SELECT max(corr) FROM p) < 0.9 ORDER BY corr DESC, 1, 2 LIMIT 15
""")
def correlation_flagged_pairs(spark, sf):
    return A.flagged_pairs(t(spark, sf, "lineitem"), PAIRS)


@query("correlation_with_target", "D11", "SELECT \"column\", r FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(corr({c}, l_extendedprice), 6) AS r FROM lineitem"
    for c in PAIRS if c != "l_extendedprice") + ") ORDER BY abs(r) DESC, 1 LIMIT 10")
def correlation_with_target(spark, sf):
    return A.target_scan(t(spark, sf, "lineitem"), "l_extendedprice", PAIRS)


@query("group_percentiles", "D12", """
SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.25), 6) AS p25,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
       round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95,
       round(quantile_cont(value, 0.99), 6) AS p99
FROM events GROUP BY event_type
""")
def group_percentiles(spark, sf):
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    df = W.percentiles(t(spark, sf, "events"), "value", probs, ["event_type"])
    return df.select("event_type", "n", *[F.round(p, 6).alias(p) for p in probs])


@query("crosstab_sum", "D21", """
SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS "F",
       round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS "O" FROM lineitem GROUP BY 1
""")
def crosstab_sum(spark, sf):
    df = A.crosstab(t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], "l_quantity")
    return df.select("l_returnflag", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"))


@query("unpivot_long", "D21", """
SELECT "variable", count(value) AS n, round(sum(value), 2) AS total FROM
 (SELECT 'l_quantity' AS "variable", l_quantity AS value FROM lineitem
  UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY 1
""")
def unpivot_long(spark, sf):
    long = A.long_form(t(spark, sf, "lineitem"), ["l_orderkey"], ["l_quantity", "l_tax"])
    return long.groupBy("variable").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("hour_weekday_heatmap", "D22", """
SELECT isodow(ts)::INTEGER - 1 AS weekday, hour(ts)::INTEGER AS hour, count(*) AS n, round(avg(value), 4) AS mean
FROM events GROUP BY 1, 2
""")
def hour_weekday_heatmap(spark, sf):
    return A.heatmap(t(spark, sf, "events"), "ts", "value").withColumn("mean", F.round("mean", 4))


@query("decile_rates", "D23 F15", """
WITH r AS (SELECT ntile(10) OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS decile,
                  l_extendedprice, (l_returnflag = 'R')::INTEGER AS y FROM lineitem)
SELECT decile::INTEGER AS decile, count(*) AS n, round(avg(y), 6) AS rate, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi
FROM r GROUP BY 1
""")
def decile_rates(spark, sf):
    from millrace.operators.sampling import rank_buckets

    line = t(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    order = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    bucketed = rank_buckets(line.select(*order, "y"), order, 10, "decile")
    return bucketed.groupBy("decile").agg(
        F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("rate"),
        F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


@query("shrunk_ranking", "D24", """
WITH p AS (SELECT l_suppkey, count(*) AS votes, avg(l_quantity) AS rating FROM lineitem GROUP BY 1),
     c AS (SELECT avg(l_quantity) AS m FROM lineitem)
SELECT l_suppkey, votes, round(rating, 6) AS rating,
       round(votes / (votes + 500.0) * rating + 500.0 / (votes + 500.0) * m, 6) AS score
FROM p, c WHERE votes >= 500
""")
def shrunk_ranking(spark, sf):
    df = A.shrunk_ranking(t(spark, sf, "lineitem"), "l_suppkey", "l_quantity", 500)
    return df.select("l_suppkey", "votes", F.round("rating", 6).alias("rating"), F.round("score", 6).alias("score"))


@query("rate_difference_test", "D25", """
WITH s AS (SELECT count(*) FILTER (WHERE l_linestatus = 'F')::DOUBLE AS n1,
                  count(*) FILTER (WHERE l_linestatus = 'O')::DOUBLE AS n2,
                  count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R')::DOUBLE AS k1,
                  count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'R')::DOUBLE AS k2 FROM lineitem)
SELECT round(k1 / n1, 6) AS rate1, round(k2 / n2, 6) AS rate2,
       round((k1 / n1 - k2 / n2) / sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 5) AS z
FROM s
""")
def rate_difference_test(spark, sf):
    line = t(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    df = A.rate_difference(line, "l_linestatus", "y", "F", "O")
    return df.select(F.round("rate1", 6).alias("rate1"), F.round("rate2", 6).alias("rate2"), F.round("z", 5).alias("z"))


@query("mean_difference_test", "D25", """
WITH s AS (SELECT avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS m1, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS m2,
       var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') / count(*) FILTER (WHERE o_orderstatus = 'F') AS e1,
       var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'O') / count(*) FILTER (WHERE o_orderstatus = 'O') AS e2,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS n1, count(*) FILTER (WHERE o_orderstatus = 'O') AS n2 FROM orders)
SELECT round(m1, 4) AS m1, round(m2, 4) AS m2, round((m1 - m2) / sqrt(e1 + e2), 5) AS t,
       round((e1 + e2) ** 2 / (e1 ** 2 / (n1 - 1) + e2 ** 2 / (n2 - 1)), 3) AS dof FROM s
""")
def mean_difference_test(spark, sf):
    df = A.mean_difference(t(spark, sf, "orders"), "o_orderstatus", "o_totalprice", "F", "O")
    return df.select(F.round("m1", 4).alias("m1"), F.round("m2", 4).alias("m2"), F.round("t", 5).alias("t"),
                     F.round("dof", 3).alias("dof"))


@query("daily_volatility", "D26", """
WITH d AS (SELECT user_id, ts::DATE AS day, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT user_id, count(*) AS n_days, round(stddev_samp(total), 4) AS volatility FROM d GROUP BY 1
HAVING stddev_samp(total) IS NOT NULL ORDER BY round(stddev_samp(total), 6) DESC, user_id LIMIT 20
""")
def daily_volatility(spark, sf):
    df = A.daily_volatility(t(spark, sf, "events"), "user_id", "ts", "value", 20)
    return df.withColumn("volatility", F.round("volatility", 4))


@query("junk_counts", "D27", """
SELECT 'zero_discount' AS "check", count(*) FILTER (WHERE l_discount = 0) AS n FROM lineitem
UNION ALL SELECT 'zero_tax', count(*) FILTER (WHERE l_tax = 0) FROM lineitem
UNION ALL SELECT 'tiny_price', count(*) FILTER (WHERE l_extendedprice < 1000) FROM lineitem
""")
def junk_counts(spark, sf):
    return A.predicate_counts(t(spark, sf, "lineitem"), {
        "zero_discount": F.col("l_discount") == 0, "zero_tax": F.col("l_tax") == 0,
        "tiny_price": F.col("l_extendedprice") < 1000})


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax"]


@query("exact_numeric_profile", "D28 P3", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count({c}) AS count, min({c})::DOUBLE AS min, "
    f"max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM lineitem"
    for c in LINE_NUMBERS))
def exact_numeric_profile(spark, sf):
    numeric, _ = A.exact_profile(t(spark, sf, "lineitem"), LINE_NUMBERS)
    return numeric.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


def top_values_sql(table: str, columns: list[str], top: int) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value FROM {table}" for c in columns)
    return (
        f'SELECT "column", value, n, position FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, '
        f'value)::INTEGER AS position FROM (SELECT "column", value, count(*) AS n FROM ({rows}) WHERE value IS NOT NULL '
        f'GROUP BY 1, 2)) WHERE position <= {top}')


@query("exact_top_values", "D28 E23", top_values_sql("part", ["p_name", "p_brand", "p_type"], 10))
def exact_top_values(spark, sf):
    return A.exact_profile(t(spark, sf, "part"), ["p_name", "p_brand", "p_type"])[1]


@query("merged_shard_verdict", "D29", """
WITH s AS (SELECT l_suppkey, avg(l_discount) AS d, stddev_samp(l_discount) AS sd FROM lineitem GROUP BY 1)
SELECT CASE max(CASE WHEN d > 0.07 THEN 2 WHEN d > 0.052 THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn'
       ELSE 'pass' END AS verdict FROM s
""")
def merged_shard_verdict(spark, sf):
    shards = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("d"))
    verdict = F.when(F.col("d") > 0.07, "fail").when(F.col("d") > 0.052, "warn").otherwise("pass")
    return A.merge_verdicts(shards.withColumn("verdict", verdict))


@query("best_shard_model", "D29", """
WITH s AS (SELECT l_suppkey AS shard, round(stddev_pop(l_quantity), 6) AS score FROM lineitem GROUP BY 1)
SELECT arg_min(shard, (score, shard)) AS from_shard, min(score) AS score, count(score) AS candidates_considered FROM s
""")
def best_shard_model(spark, sf):
    shards = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("shard")).agg(
        F.round(F.stddev_pop("l_quantity"), 6).alias("score"))
    return A.best_model(shards, "rmse")


@query("top_groups_with_first_row", "D30", """
SELECT o_custkey, count(*) AS n, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus,
       arg_min(o_orderpriority, o_orderkey) AS o_orderpriority
FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 25
""")
def top_groups_with_first_row(spark, sf):
    return A.top_groups_with_first(t(spark, sf, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"],
                                   "o_orderkey", 25)


@query("suffixed_aggregate", "D31", """
SELECT l_shipmode AS flag, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 4) AS l_quantity_mean,
       round(sum(l_tax), 2) AS l_tax_sum, round(avg(l_tax), 6) AS l_tax_mean
FROM (SELECT *, nullif(l_returnflag, 'N') AS l_shipmode FROM lineitem) WHERE l_shipmode IS NOT NULL GROUP BY 1
""")
def suffixed_aggregate(spark, sf):
    line = t(spark, sf, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    df = A.suffixed_aggregate(line, ["flag", "l_tax"], ["l_quantity", "l_tax"], ["sum", "mean"])
    places = {"l_quantity_sum": 2, "l_quantity_mean": 4, "l_tax_sum": 2, "l_tax_mean": 6}
    return df.select("flag", *[F.round(c, p).alias(c) for c, p in places.items()])


@query("value_index", "D32", """
WITH v AS (SELECT 'p_name' AS c, p_name AS v FROM part UNION ALL SELECT 'p_brand', p_brand FROM part
           UNION ALL SELECT 'p_type', p_type FROM part),
     d AS (SELECT DISTINCT lower(trim(v)) AS value, c FROM v WHERE v IS NOT NULL AND trim(v) <> '')
SELECT value, string_agg(c, ',' ORDER BY c) AS columns FROM d GROUP BY 1
""")
def value_index(spark, sf):
    return A.value_index(t(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


@query("scoped_group_totals", "E25", """
SELECT c_mktsegment AS "group", round(sum(c_acctbal), 2) AS value, (SELECT count(*) FROM customer) AS rows_used,
       (SELECT count(*) FROM customer)  AS rows_total, 'all' AS scope
FROM customer GROUP BY 1 ORDER BY sum(c_acctbal) DESC LIMIT 10
""")
def scoped_group_totals(spark, sf):
    customer = t(spark, sf, "customer")
    answer = A.group_comparison(customer, "c_mktsegment", "c_acctbal", "sum").withColumn("value", F.round("value", 2))
    return A.with_scope(answer, customer, customer.count())
