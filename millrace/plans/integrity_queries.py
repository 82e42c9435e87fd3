"""Leakage, duplicate and identifier checks on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import integrity as I
from millrace.operators import sampling as S
from millrace.plans.registry import query
from millrace.session import read_table as t


def _leaky(spark, sf):
    line = t(spark, sf, "lineitem")
    y = (F.col("l_returnflag") == "R").cast("int")
    return line.select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_linestatus", "l_returnflag", y.alias("target"),
        (y * 100 + F.col("l_discount") * 10).alias("score"), F.when(y == 1, "returned").otherwise("kept").alias("outcome_label"),
        y.alias("copy"), F.lit("only").alias("constant"))


@query("profile_leakage", "G5", """
WITH d AS (SELECT (l_returnflag = 'R')::INT AS y, l_discount FROM lineitem)
SELECT 'score' AS "column", 'near_perfect_correlation' AS kind, round(abs(corr(y * 100 + l_discount * 10, y)), 4) AS value FROM d
UNION ALL SELECT 'copy', 'near_perfect_correlation', 1.0 UNION ALL SELECT 'outcome_label', 'deterministic_mapping', 1.0 UNION ALL SELECT 'l_returnflag', 'deterministic_mapping', 1.0
""")
def profile_leakage(spark, sf):
    leaky = _leaky(spark, sf)
    return I.profile_leakage(leaky, "target", I.skip_unique(leaky, [c for c in leaky.columns if c != "target"]))


@query("target_leakage", "G6", """
WITH d AS (SELECT (l_returnflag = 'R')::INT AS y, l_discount FROM lineitem)
SELECT 'score' AS "column", 'near_perfect_correlation' AS method, round(abs(corr(y * 100 + l_discount * 10, y)), 6) AS correlation FROM d
UNION ALL SELECT 'outcome_label', 'near_perfect_correlation', 1.0 UNION ALL SELECT 'copy', 'exact_copy', 1.0
""")
def target_leakage(spark, sf):
    leaky = _leaky(spark, sf)
    return I.target_leakage(leaky, "target", [c for c in leaky.columns if c != "target"])


@query("wide_target_leakage", "G6", """
WITH d AS (SELECT o_custkey, 'c' || (o_custkey * 7919 % 100003) AS code, o_orderpriority AS noise, o_totalprice FROM orders),
 o AS (SELECT code, o_custkey, count(*) AS n FROM d GROUP BY 1, 2 HAVING count(*) > 1)
SELECT 'code' AS "column", 'near_perfect_association' AS method, 1.0::DOUBLE AS correlation FROM o HAVING count(*) > 50
""")
def wide_target_leakage(spark, sf):
    key = F.col("o_custkey")
    leaky = t(spark, sf, "orders").select(
        key, F.concat(F.lit("c"), (key * 7919 % 100003).cast("string")).alias("code"), F.col("o_orderpriority").alias("noise"), "o_totalprice")
    return I.target_leakage(leaky, "o_custkey", ["code", "noise", "o_totalprice"])


@query("duplicate_record_block", "G7", """
WITH d AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS dup FROM documents)
SELECT dup AS duplicates, round(dup / n, 6) AS ratio, dup / n >= 0.01 AS blocking FROM d
""")
def duplicate_record_block(spark, sf):
    from millrace.operators.profile import duplicate_rows

    dup = duplicate_rows(t(spark, sf, "documents"), ["text"])
    return dup.select("duplicates", F.round("ratio", 6).alias("ratio"), (F.col("ratio") >= I.BLOCKING_DUPLICATES).alias("blocking"))


@query("identifier_roles", "G8", """
SELECT 'order_id' AS "column", 'row_or_occurrence_identifier' AS role, 'exclude' AS recommendation, count(*) AS non_null, count(DISTINCT l_orderkey) AS "unique", round(count(DISTINCT l_orderkey) / count(*), 6) AS uniqueness FROM lineitem
UNION ALL SELECT 'customerId', 'group_identifier', 'exclude', count(*), count(DISTINCT l_partkey), round(count(DISTINCT l_partkey) / count(*), 6) FROM lineitem
UNION ALL SELECT 'product_id', 'repeated_entity_identifier', 'keep', count(*), count(DISTINCT l_partkey), round(count(DISTINCT l_partkey) / count(*), 6) FROM lineitem
UNION ALL SELECT 'depot_key', 'repeated_entity_identifier', 'keep', count(*), count(DISTINCT l_suppkey), round(count(DISTINCT l_suppkey) / count(*), 6) FROM lineitem
""")
def identifier_roles(spark, sf):
    line = t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("customerId"), F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("depot_key"), "l_quantity")
    return I.classify_identifiers(line)


@query("near_constant_features", "G9", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) <= 1 THEN 'constant_feature' ELSE 'near_constant_feature' END AS \"check\", count(DISTINCT {c}) AS "
    f"n_unique FROM (SELECT *, 'one' AS same FROM lineitem) HAVING count(DISTINCT {c}) <= 1 OR (count(*) >= 100 AND count(DISTINCT {c}) / count(*) <= 0.01)"
    for c in ("l_quantity", "l_extendedprice", "l_returnflag", "l_suppkey", "same")))
def near_constant_features(spark, sf):
    line = t(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag", "l_suppkey", F.lit("one").alias("same"))
    found = I.integrity_report(line).where(F.col("check").isin("constant_feature", "near_constant_feature"))
    return found.select("column", "check", F.col("evidence").cast("bigint").alias("n_unique"))


@query("temporal_leakage", "G10", f"""
WITH d AS (SELECT o_orderdate, (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT) % 5 > 0 AS is_train FROM orders)
SELECT max(o_orderdate) FILTER (WHERE is_train) AS train_max, min(o_orderdate) FILTER (WHERE NOT is_train) AS test_min FROM d
""")
def temporal_leakage(spark, sf):
    orders = S.group_folds(t(spark, sf, "orders"), "o_orderkey", 5).withColumn("is_train", F.col("fold") > 0)
    return I.temporal_overlap(orders, "o_orderdate", "is_train")


@query("temporal_split_is_clean", "G10", "SELECT o_orderdate AS train_max, o_orderdate AS test_min FROM orders WHERE false")
def temporal_split_is_clean(spark, sf):
    split = S.temporal_holdout(t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", ["o_orderkey"])
    return I.temporal_overlap(split, "o_orderdate", "is_train")


@query("integrity_report", "G11", """
WITH d AS (SELECT s_nationkey, s_suppkey, 'one' AS same, s_nationkey AS target FROM supplier), n AS (SELECT count(*) AS n, count(DISTINCT s_nationkey) AS u FROM d),
 f AS (SELECT 1 AS sev, 'target_correlation' AS "check", 's_nationkey' AS "column", 1.0::DOUBLE AS evidence
 UNION ALL SELECT 2, 'constant_feature', 'same', 1.0 UNION ALL SELECT 2, 'identifier_feature', 's_suppkey', n::DOUBLE FROM n
 UNION ALL SELECT 3, 'near_constant_feature', 's_nationkey', u::DOUBLE FROM n WHERE u / n <= 0.01)
SELECT row_number() OVER (ORDER BY sev, "check", "column")::INTEGER AS position, "check", CASE sev WHEN 1 THEN 'blocker' WHEN 2 THEN 'warning' ELSE 'info' END AS severity, "column", evidence FROM f
""")
def integrity_report(spark, sf):
    supplier = t(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.lit("one").alias("same"), F.col("s_nationkey").alias("target"))
    return I.integrity_report(supplier, "target")
