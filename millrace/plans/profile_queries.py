"""Profiles and quality findings on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import profile as P
from millrace.operators.aggregates import correlation_pairs, pearson
from millrace.plans.registry import query
from millrace.session import read_table as t

CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
            "c_mktsegment": "string"}
ROLES = {"c_custkey": "id", "c_name": "id", "c_nationkey": "numeric", "c_acctbal": "numeric",
         "c_mktsegment": "categorical"}


@query("column_roles", "E1", " UNION ALL ".join(
    f"SELECT '{c}' AS name, '{d}' AS dtype, CASE WHEN count(DISTINCT {c}) <= 1 THEN 'constant' "
    + (f"WHEN count(DISTINCT {c}) >= 0.98 * count({c}) THEN 'id' "
       f"WHEN avg(length({c}::VARCHAR)) > 40 THEN 'text' ELSE 'categorical' END" if d == "string" else
       f"WHEN count(DISTINCT {c}) >= 0.98 * count({c}) AND bool_and({c} % 1 = 0) THEN 'id' ELSE 'numeric' END")
    + " AS role FROM customer" for c, d in CUSTOMER.items()))
def column_roles(spark, sf):
    return P.profile(t(spark, sf, "customer")).select("name", "dtype", "role")


def numeric_profile_sql(table: str, c: str) -> str:
    return f"""SELECT '{c}' AS name, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_unique, min({c})::DOUBLE AS min,
 max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std,
 round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.75), 4) AS p75, round(skewness({c}), 4) AS skew,
 (SELECT count(*) FROM {table}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {table}) f
  WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS n_outliers FROM {table}"""


PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"]


@query("numeric_profile", "E2", " UNION ALL ".join(numeric_profile_sql("lineitem", c) for c in PROFILED))
def numeric_profile(spark, sf):
    out = P.profile(t(spark, sf, "lineitem"), PROFILED)
    return out.select("name", "missing", "n_unique", "min", "max", *[
        F.round(c, 4).alias(c) for c in ("mean", "median", "std", "p25", "p75", "skew")], "n_outliers")


def top_sql(table: str, columns: list[str], top: int) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::VARCHAR AS value FROM {table}" for c in columns)
    return (f"SELECT name, position, value, n AS count FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, "
            f"value)::INTEGER AS position FROM (SELECT name, value, count(*) AS n FROM ({rows}) WHERE value IS NOT NULL "
            f"GROUP BY 1, 2)) WHERE position <= {top}")


@query("top_values_profile", "E2", top_sql("orders", ["o_orderstatus", "o_orderpriority"], 10))
def top_values_profile(spark, sf):
    out = P.profile(t(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])
    return out.select("name", F.inline("top_values"))


@query("quality_score", "E3", """
WITH d AS (SELECT 100 - (CASE WHEN (SELECT count(*) FROM labels) > (SELECT count(*) FROM (SELECT DISTINCT * FROM labels)) THEN 6 ELSE 0 END)
 - 12 * ((SELECT avg((quality IS NULL)::INT) FROM documents LEFT JOIN labels USING (doc_id)) >= 0.3)::INT
 - 12 * ((SELECT avg((toxic IS NULL)::INT) FROM documents LEFT JOIN labels USING (doc_id)) >= 0.3)::INT
 - 10 * ((SELECT count(*) FROM documents) < 200)::INT AS score)
SELECT score::BIGINT AS score, ((100 - score) // 12)::BIGINT AS n_issues FROM d
""")
def quality_score(spark, sf):
    joined = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", "lang", "source", "quality", "toxic")
    issues = P.quality_issues(P.profile(joined), P.duplicate_rows(joined))
    return P.quality_score(issues)


@query("duplicate_rows", "E3 G7", """
SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, text FROM documents)) AS duplicates,
 round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, text FROM documents))) / count(*), 6) AS ratio FROM documents
""")
def duplicate_rows(spark, sf):
    return P.duplicate_rows(t(spark, sf, "documents"), ["lang", "source", "text"]).withColumn("ratio", F.round("ratio", 6))


@query("text_number_verdict", "E6", """
WITH e AS (SELECT regexp_extract(props, '([0-9]+)', 1) AS a, event_type AS b, CASE WHEN event_id % 20 = 0 THEN value::VARCHAR ELSE 'x' END AS c FROM events),
 l AS (SELECT 'a' AS "column", a AS v FROM e UNION ALL SELECT 'b', b FROM e UNION ALL SELECT 'c', c FROM e)
SELECT "column", count(*) AS n_rows, count(*) FILTER (WHERE v IS NULL OR lower(trim(v)) IN ('', 'na', 'nan', 'null', 'none')) AS missing,
 count(try_cast(v AS DOUBLE)) AS parsed, count(try_cast(v AS DOUBLE)) >= greatest(3.0, count(*) * 0.1) AS is_numeric FROM l GROUP BY 1
""")
def text_number_verdict(spark, sf):
    events = t(spark, sf, "events").select(
        F.regexp_extract("props", "([0-9]+)", 1).alias("a"), F.col("event_type").alias("b"),
        F.when(F.col("event_id") % 20 == 0, F.col("value").cast("string")).otherwise("x").alias("c"))
    return P.text_number_verdict(events, ["a", "b", "c"])


@query("chart_profile", "E8", """
SELECT 'o_orderkey' AS name, 'numeric' AS dtype, 'identifier' AS role, false AS is_year, count(DISTINCT o_orderkey) AS n_unique FROM orders
UNION ALL SELECT 'o_custkey', 'numeric', 'measure', false, count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'o_orderstatus', 'categorical', 'dimension', false, count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', 'numeric', 'measure', false, count(DISTINCT o_totalprice) FROM orders
UNION ALL SELECT 'o_orderdate', 'datetime', 'time', false, count(DISTINCT o_orderdate::DATE) FROM orders
UNION ALL SELECT 'o_orderpriority', 'categorical', 'dimension', false, count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'order_year', 'categorical', 'dimension', true, count(DISTINCT year(o_orderdate)) FROM orders
""")
def chart_profile(spark, sf):
    orders = t(spark, sf, "orders").withColumn("order_year", F.year("o_orderdate"))
    return P.chart_profile(orders).select("name", "dtype", "role", "is_year", "n_unique")


def moments_sql(table: str, c: str) -> str:
    return (f"SELECT '{c}' AS name, round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS "
            f"n_unique, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS "
            f"std, round(avg(({c} - (SELECT avg({c}) FROM {table})) ** 3) / stddev_pop({c}) ** 3, 4) AS skewness, "
            f"round(median({c}), 4) AS median FROM {table}")


@query("full_numeric_stats", "E9", " UNION ALL ".join(moments_sql("lineitem", c) for c in PROFILED[:4]))
def full_numeric_stats(spark, sf):
    out = P.full_numeric_stats(t(spark, sf, "lineitem"), PROFILED[:4])
    return out.select("name", "missing_pct", "n_unique", "min", "max", *[
        F.round(c, 4).alias(c) for c in ("mean", "std", "skewness", "median")])


@query("full_text_stats", "E9", """
WITH l AS (SELECT 'l_returnflag' AS "column", l_returnflag AS value FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem),
 c AS (SELECT "column", value, count(*) AS n FROM l GROUP BY 1, 2)
SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INTEGER AS position, value, n AS count,
 round(100.0 * n / sum(n) OVER (PARTITION BY "column"), 1) AS pct, count(*) OVER (PARTITION BY "column") AS n_unique FROM c
""")
def full_text_stats(spark, sf):
    return P.full_text_stats(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("feature_ranking", "E10", """
WITH n AS (SELECT 'p_size' AS name, var_pop(p_size) AS raw FROM part UNION ALL SELECT 'p_retailprice', var_pop(p_retailprice) FROM part),
 c AS (SELECT 'p_name' AS name, count(DISTINCT p_name) * ln(count(DISTINCT p_name)) AS raw FROM part
       UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) * ln(count(DISTINCT p_brand)) FROM part
       UNION ALL SELECT 'p_type', count(DISTINCT p_type) * ln(count(DISTINCT p_type)) FROM part)
SELECT name, round(raw / max(raw) OVER (), 6) AS score FROM n UNION ALL SELECT name, round(raw / max(raw) OVER (), 6) FROM c
UNION ALL SELECT 'p_partkey', 0.0
""")
def feature_ranking(spark, sf):
    return P.feature_ranking(P.chart_profile(t(spark, sf, "part"))).withColumn("score", F.round("score", 6))


@query("bias_issues", "E11", """
SELECT 'fixed' AS "column", 'constant' AS type UNION ALL SELECT 'fixed', 'imbalance'
UNION ALL SELECT 'quality', 'missing' FROM documents LEFT JOIN labels USING (doc_id) HAVING avg((quality IS NULL)::INT) > 0.4
UNION ALL SELECT 'rare', 'imbalance' FROM (SELECT count(*) AS n FROM documents GROUP BY doc_id % 50 = 0) HAVING max(n) / sum(n) > 0.95
""")
def bias_issues(spark, sf):
    joined = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left").select(
        "lang", "source", "quality", F.lit("one").alias("fixed"),
        F.when(F.col("doc_id") % 50 == 0, "seldom").otherwise("often").alias("rare"))
    return P.bias_issues(joined, P.chart_profile(joined), joined.columns)


@query("dataset_summary", "E12", """
WITH d AS (SELECT n_chars, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'mostly_empty' AS finding, 'quality' AS subject, round(avg((quality IS NULL)::INT), 6) AS value FROM d HAVING avg((quality IS NULL)::INT) > 0.2
UNION ALL SELECT 'heavy_skew', 'n_chars', round(avg((n_chars - (SELECT avg(n_chars) FROM d)) ** 3) / stddev_pop(n_chars) ** 3, 6) FROM d
 HAVING abs(avg((n_chars - (SELECT avg(n_chars) FROM d)) ** 3) / stddev_pop(n_chars) ** 3) >= 2
""")
def dataset_summary(spark, sf):
    joined = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left").select("n_chars", "quality")
    out = P.dataset_summary(joined, P.chart_profile(joined))
    return out.withColumn("value", F.round("value", 6))


@query("redundant_measures", "E13", """
SELECT 'gross' AS "column", 'l_extendedprice' AS same_as, round(corr(l_extendedprice, l_extendedprice * 1.1), 4) AS r FROM lineitem
""")
def redundant_measures(spark, sf):
    line = t(spark, sf, "lineitem").withColumn("gross", F.col("l_extendedprice") * 1.1)
    found = P.redundant_measures(line, ["l_extendedprice", "l_quantity", "gross", "l_discount"])
    return spark.createDataFrame([(c, k, round(r, 4)) for c, k, r in found], "column string, same_as string, r double")


@query("mirror_columns", "E13", """
SELECT 'code' AS "column", 'n_regionkey' AS same_as UNION ALL SELECT 'n_name', 'n_nationkey'
""")
def mirror_columns(spark, sf):
    nation = t(spark, sf, "nation").withColumn("code", F.concat(F.lit("r"), "n_regionkey"))
    return P.mirror_columns(nation, ["n_nationkey", "n_regionkey", "n_name", "code"])


@query("chart_importance", "E14", """
WITH c AS (SELECT l_returnflag || l_linestatus AS id, count(*) AS n, abs(corr(l_quantity, l_extendedprice)) AS r,
                  row_number() OVER (ORDER BY l_returnflag, l_linestatus) AS rank FROM lineitem GROUP BY l_returnflag, l_linestatus)
SELECT id, greatest(0, least(100, round_even(55 + 30 * r + CASE WHEN rank = 1 THEN 5 ELSE 0 END - 3 * (rank - 1)
  - CASE WHEN n < 10 THEN 20 WHEN n < 30 THEN 10 ELSE 0 END, 0)))::INTEGER AS importance FROM c
""")
def chart_importance(spark, sf):
    from pyspark.sql import Window

    line = t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), pearson("l_quantity", "l_extendedprice").alias("r"))
    rank = F.row_number().over(Window.orderBy("l_returnflag", "l_linestatus"))
    charts = line.select(F.concat("l_returnflag", "l_linestatus").alias("id"), F.lit("scatter").alias("kind"), "n", "r",
                         rank.alias("rank"), (rank == 1).alias("from_domain"))
    return P.chart_importance(charts).select("id", "importance")


@query("structural_nulls", "E16", """
SELECT quality IS NULL AS is_missing, lang = 'en' AS condition, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2
""")
def structural_nulls(spark, sf):
    joined = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    return P.structural_null_table(joined, "quality", F.col("lang") == "en")


def tidy_sql(c: str, numeric: bool) -> str:
    body = numeric_profile_sql("supplier", c) if numeric else None
    if numeric:
        negative = ", (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS neg" if c == "s_acctbal" else ", 0 AS neg"
        return (f"SELECT name AS \"column\", missing, n_unique AS \"unique\", CASE WHEN kind THEN NULL ELSE mean END AS mean, "
                f"CASE WHEN kind THEN NULL ELSE median END AS median, CASE WHEN NOT kind AND n_outliers > 0 THEN n_outliers || "
                f"' IQR outliers' ELSE '' END AS issues FROM (SELECT *, '{c}' = 's_suppkey' AS kind{negative} FROM ({body}))")
    return (f"SELECT '{c}', count(*) - count({c}), count(DISTINCT {c}), NULL, NULL, CASE WHEN count(DISTINCT {c}) > "
            f"count(DISTINCT lower(trim({c}))) THEN (count(DISTINCT {c}) - count(DISTINCT lower(trim({c})))) || "
            f"' values differ only by case or spaces' ELSE '' END FROM supplier")


@query("quality_table", "E15", " UNION ALL ".join([
    tidy_sql("s_suppkey", True), tidy_sql("s_nationkey", True), tidy_sql("s_acctbal", True), tidy_sql("s_name", False),
    """SELECT '(dataset)', NULL, NULL, NULL, NULL, CASE WHEN count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM supplier))
    THEN (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM supplier))) || ' exact duplicate rows' ELSE '' END FROM supplier"""]))
def quality_table(spark, sf):
    out = P.quality_table(t(spark, sf, "supplier"))
    return out.select("column", "missing", "unique", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"),
                      "issues")


@query("result_contract", "E22", """
SELECT 'missing_column' AS kind, 'margin' AS "column", 1.0::DOUBLE AS found UNION ALL SELECT 'wrong_dtype', 'o_orderstatus', 1.0
UNION ALL SELECT 'out_of_range', 'total', round(max(s), 0) FROM (SELECT sum(o_totalprice) AS s FROM orders GROUP BY o_orderstatus) HAVING max(s) > 1000
UNION ALL SELECT 'too_many_rows', '', round(count(DISTINCT o_orderstatus)::DOUBLE, 0) FROM orders HAVING count(DISTINCT o_orderstatus) > 2
""")
def result_contract(spark, sf):
    orders = t(spark, sf, "orders")
    result = orders.groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    found = P.check_contract(result, orders, {
        "columns": {"O_ORDERSTATUS": {"dtype": "numeric"}, "total": {"dtype": "numeric", "min": 0, "max": 1000},
                    "margin": {}},
        "row_relation": {"type": "at_most", "n": 2}, "unique_key": ["o_orderstatus"], "not_null": ["total"]})
    return found.withColumn("found", F.round("found", 0))


@query("result_contract_groups", "E22", "SELECT 'x' AS kind, 'x' AS \"column\", 0.0::DOUBLE AS found WHERE false")
def result_contract_groups(spark, sf):
    orders = t(spark, sf, "orders")
    result = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return P.check_contract(result, orders, {
        "row_relation": {"type": "one_per_group", "group_by": ["o_custkey"]}, "unique_key": ["o_custkey"],
        "not_null": ["o_custkey"]})


@query("one_pass_profile", "E23", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN count(try_cast({c} AS DOUBLE)) >= 0.9 * count({c}) THEN 'numeric' ELSE 'categorical' END AS type, "
    f"count(*) AS total_count, count(*) - count({c}) AS null_count, count(try_cast({c} AS DOUBLE)) AS numeric_count, "
    f"CASE WHEN count(try_cast({c} AS DOUBLE)) >= 0.9 * count({c}) THEN round(avg(try_cast({c} AS DOUBLE)), 4) END AS mean, "
    f"CASE WHEN count(try_cast({c} AS DOUBLE)) >= 0.9 * count({c}) THEN round(stddev_pop(try_cast({c} AS DOUBLE)), 4) END AS std "
    f"FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def one_pass_profile(spark, sf):
    out = P.one_pass_profile(t(spark, sf, "customer")).drop("min", "max")
    return out.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@query("observations", "E24", """
SELECT 'dominant_segment' AS remark, 'lang' AS name, round((SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) / count(*), 6) AS value FROM documents
UNION ALL SELECT 'skewed', 'n_chars', round(skewness(n_chars), 4) FROM documents HAVING abs(skewness(n_chars)) > 1.5
UNION ALL SELECT 'identifier', 'doc_id', 1.0
UNION ALL SELECT 'high_missing', 'quality', round(avg((quality IS NULL)::INT), 4) FROM documents LEFT JOIN labels USING (doc_id) HAVING avg((quality IS NULL)::INT) >= 0.3
""")
def observations(spark, sf):
    joined = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", "quality")
    out = P.observations(P.profile(joined), correlation_pairs(joined, ["n_chars", "quality"]))
    return out.withColumn("value", F.round("value", 6))


@query("next_steps", "E24", """
SELECT 'model_target' AS step, 'quality' AS "column" UNION ALL SELECT 'breakdown', 'lang' UNION ALL SELECT 'measure', 'n_chars'
""")
def next_steps(spark, sf):
    joined = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left").select(
        "lang", "source", "n_chars", "quality")
    return P.next_steps(P.profile(joined))
