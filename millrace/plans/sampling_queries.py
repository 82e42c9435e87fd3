"""Sampling and splitting on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import sampling as S
from millrace.plans.registry import query
from millrace.session import read_table as t

FRACTION = "(('0x' || substr(md5({k}), 1, 8))::BIGINT / 4294967296.0)"


@query("random_sample", "F1", f"""
SELECT l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem
WHERE (SELECT count(*) FROM lineitem) <= 20000 OR
 {FRACTION.format(k="l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR")} < 10000 / (SELECT count(*) FROM lineitem)
GROUP BY 1
""")
def random_sample(spark, sf):
    kept = S.random_sample(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], rows=10_000, above=20_000)
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


STRATIFIED_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY {s} ORDER BY md5({k}::VARCHAR), {k}) AS i,
                  count(*) OVER (PARTITION BY {s}) AS c FROM {table})
"""


@query("stratified_fraction", "F2", STRATIFIED_SQL.format(s="o_orderpriority", k="o_orderkey", table="orders") + """
SELECT o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM r WHERE i <= round_even(c * 0.2, 0)
GROUP BY 1
""")
def stratified_fraction(spark, sf):
    kept = S.stratified_fraction(t(spark, sf, "orders"), "o_orderpriority", 0.2, ["o_orderkey"])
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("proportional_sample", "F3", """
WITH s AS (SELECT c_mktsegment, count(*) AS c FROM customer GROUP BY 1),
 a AS (SELECT *, c / sum(c) OVER () * 500 AS raw FROM s),
 b AS (SELECT *, floor(raw)::BIGINT AS base, round(raw - floor(raw), 9) AS frac FROM a),
 d AS (SELECT *, row_number() OVER (ORDER BY frac DESC, c_mktsegment) AS place, 500 - sum(base) OVER () AS rest FROM b),
 q AS (SELECT c_mktsegment, least(base + (place <= rest)::INT, c) AS quota FROM d),
 r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR), c_custkey) AS i FROM customer)
SELECT r.c_custkey, r.c_mktsegment FROM r JOIN q USING (c_mktsegment) WHERE i <= quota
""")
def proportional_sample(spark, sf):
    kept = S.proportional_sample(t(spark, sf, "customer"), "c_mktsegment", 500, ["c_custkey"])
    return kept.select("c_custkey", "c_mktsegment")


@query("best_stratify_column", "F4", """
SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS n_unique FROM orders
""")
def best_stratify_column(spark, sf):
    return S.best_stratify_column(t(spark, sf, "orders"))


@query("capped_strata", "F5", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag
   ORDER BY md5(l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR), l_orderkey, l_linenumber, l_partkey, l_suppkey) AS i,
   count(*) OVER (PARTITION BY l_returnflag) AS c FROM lineitem)
SELECT l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS keys, round(max(c / least(c, 2500)), 6) AS weight
FROM r WHERE i <= 2500 GROUP BY 1
""")
def capped_strata(spark, sf):
    kept = S.capped_strata(t(spark, sf, "lineitem"), "l_returnflag", 2500, ["l_orderkey", "l_linenumber"])
    return kept.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"), F.round(F.max("_weight"), 6).alias("weight"))


@query("quantile_strata", "F6", """
WITH e AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b,
                  quantile_cont(o_totalprice, 0.75) AS c FROM orders),
 m AS (SELECT orders.*, (o_totalprice >= a)::INT + (o_totalprice >= b)::INT + (o_totalprice >= c)::INT AS bucket FROM orders, e),
 r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS i,
              count(*) OVER (PARTITION BY bucket) AS n_all FROM m)
SELECT bucket, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(n_all / least(n_all, 250)), 4) AS weight
FROM r WHERE i <= 250 GROUP BY 1
""")
def quantile_strata(spark, sf):
    kept = S.quantile_strata(t(spark, sf, "orders"), "o_totalprice", 1000, ["o_orderkey"])
    return kept.groupBy(F.col("_bucket").alias("bucket")).agg(
        F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("_weight"), 4).alias("weight"))


def _sparse(c):
    return (f"SELECT '{c}' AS \"column\", count(*) AS n_unique, avg((n < 1000)::INT::DOUBLE) AS metric FROM "
            f"(SELECT {c}, count(*) AS n FROM part GROUP BY 1)")


def _skewed(c):
    return (f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, abs(avg(({c} - m) ** 3) / max(s) ** 3) AS "
            f"metric FROM part, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM part)")


@query("stratification_candidates", "F7", f"""
WITH x AS ({" UNION ALL ".join(_sparse(c) for c in ("p_name", "p_brand", "p_type"))}),
 y AS ({" UNION ALL ".join(_skewed(c) for c in ("p_partkey", "p_size", "p_retailprice"))})
SELECT "column", n_unique, CASE WHEN n_unique <= 20 THEN 'categorical_low' ELSE 'categorical_medium' END AS kind,
  round(metric, 6) AS metric FROM x WHERE n_unique BETWEEN 2 AND 100
UNION ALL SELECT "column", n_unique, 'numerical_skewed', round(metric, 6) FROM y WHERE n_unique > 20
""")
def stratification_candidates(spark, sf):
    return S.stratification_candidates(t(spark, sf, "part")).withColumn("metric", F.round("metric", 6))


@query("sample_portfolio", "F8 E7", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY md5(p_partkey::VARCHAR), p_partkey) AS i,
                  count(*) OVER (PARTITION BY p_type) AS c FROM part),
 e AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b,
              quantile_cont(p_retailprice, 0.75) AS c FROM part),
 m AS (SELECT part.*, (p_retailprice >= a)::INT + (p_retailprice >= b)::INT + (p_retailprice >= c)::INT AS k FROM part, e),
 q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY md5(p_partkey::VARCHAR), p_partkey) AS i,
              count(*) OVER (PARTITION BY k) AS c FROM m),
 b AS (SELECT * FROM part ORDER BY md5(p_partkey::VARCHAR), p_partkey LIMIT 300)
SELECT 'strat_p_type' AS sample, count(*) AS n, sum(p_partkey)::BIGINT AS keys, round(sum(c / least(c, 40)), 3) AS weight FROM a WHERE i <= 40
UNION ALL SELECT 'quantile_p_retailprice', count(*), sum(p_partkey)::BIGINT, round(sum(c / least(c, 40)), 3) FROM q WHERE i <= 40
UNION ALL SELECT 'random_baseline', count(*), sum(p_partkey)::BIGINT, round(count(*)::DOUBLE, 3) FROM b
""")
def sample_portfolio(spark, sf):
    part = t(spark, sf, "part")
    wanted = [("p_type", "categorical_low"), ("p_retailprice", "numerical_skewed")]
    portfolio = S.sample_portfolio(part, ["p_partkey"], wanted, cap=40, baseline_rows=300)
    out = None
    for name, sample in portfolio.items():
        row = sample.agg(F.lit(name).alias("sample"), F.count("*").alias("n"), F.sum("p_partkey").alias("keys"),
                         F.round(F.sum("_weight"), 3).alias("weight"))
        out = row if out is None else out.unionByName(row)
    return out


def hex_mod10(h: str) -> str:
    p = [f"('0x' || substr({h}, {i}, 8))::BIGINT" for i in (1, 9, 17, 25)]
    return f"((6 * ({p[0]} + {p[1]} + {p[2]}) + {p[3]}) % 10)"


@query("hash_split", "F10", f"""
SELECT {hex_mod10("md5(concat(c_custkey, c_name, c_nationkey, c_mktsegment))")} < 8 AS is_train, count(*) AS n,
       sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1
""")
def hash_split(spark, sf):
    split = S.hash_split(t(spark, sf, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return split.groupBy("is_train").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("temporal_holdout", "F11", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(count(*) OVER () * 0.8) AS is_train FROM orders)
SELECT is_train, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day,
       strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, sum(o_orderkey)::BIGINT AS keys FROM r GROUP BY 1
""")
def temporal_holdout(spark, sf):
    split = S.temporal_holdout(t(spark, sf, "orders"), "o_orderdate", ["o_orderkey"])
    return split.groupBy("is_train").agg(
        F.count("*").alias("n"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"), F.sum("o_orderkey").alias("keys"))


@query("last_fold_sizes", "F12", """
SELECT event_type, count(*) AS n, count(*) - count(*) // 6 AS n_train_rows, count(*) // 6 AS n_validation_rows
FROM events GROUP BY 1
""")
def last_fold_sizes(spark, sf):
    sizes = t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    last = S.expanding_sizes(F.col("n"), 5)
    return sizes.select("event_type", "n", last["n_train_rows"].alias("n_train_rows"), last["n_validation_rows"].alias("n_validation_rows"))


@query("expanding_folds", "F12 O10", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT greatest(-1, floor((i - (n - 5 * (n // 6))) / (n // 6)))::INTEGER AS fold, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day,
  strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, sum(o_orderkey)::BIGINT AS keys FROM r GROUP BY 1
""")
def expanding_folds(spark, sf):
    folds, _ = S.assign_folds(t(spark, sf, "orders"), "regression", 5, ["o_orderkey"], "o_totalprice", entity="o_custkey", time="o_orderdate")
    return folds.groupBy("fold").agg(
        F.count("*").alias("n"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"), F.sum("o_orderkey").alias("keys"))


@query("stratified_folds", "F13 O10", """
WITH r AS (SELECT o_orderpriority, o_orderkey, (row_number() OVER (ORDER BY o_orderpriority, md5(o_orderkey::VARCHAR), o_orderkey) - 1) % 5 AS fold FROM orders)
SELECT fold::INTEGER AS fold, o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM r GROUP BY 1, 2
""")
def stratified_folds(spark, sf):
    folds, _ = S.assign_folds(t(spark, sf, "orders"), "multiclass_classification", 5, ["o_orderkey"], "o_orderpriority")
    return folds.groupBy("fold", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("plain_folds", "F13 O10", """
WITH r AS (SELECT o_orderkey, ntile(7) OVER (ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) - 1 AS fold FROM orders)
SELECT fold::INTEGER AS fold, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM r GROUP BY 1
""")
def plain_folds(spark, sf):
    folds, _ = S.assign_folds(t(spark, sf, "orders"), "regression", 7, ["o_orderkey"], "o_totalprice")
    return folds.groupBy("fold").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("group_folds", "F13", """
SELECT ((('0x' || substr(md5(o_custkey::VARCHAR), 1, 8))::BIGINT) % 5)::INTEGER AS fold, count(*) AS n,
       count(DISTINCT o_custkey) AS entities FROM orders GROUP BY 1
""")
def group_folds(spark, sf):
    folds, _ = S.assign_folds(t(spark, sf, "orders"), "regression", 5, ["o_orderkey"], "o_totalprice", entity="o_custkey")
    return folds.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("entities"))


@query("sequential_shards", "F14", """
WITH r AS (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) AS shard FROM orders)
SELECT shard::INTEGER AS shard, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM r GROUP BY 1
""")
def sequential_shards(spark, sf):
    shards = S.rank_buckets(t(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 7, "shard")
    return shards.groupBy("shard").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("systematic_by_value", "F15", """
WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
 q AS (SELECT *, ((i + 1) * 4 - 1) // n AS quantile FROM r),
 b AS (SELECT *, i - n * quantile // 4 AS pos, greatest(1, (n * (quantile + 1) // 4 - n * quantile // 4) // 50) AS step FROM q)
SELECT quantile::INTEGER AS quantile, o_orderkey, o_totalprice FROM b WHERE pos % step = 0 AND pos // step < 50
""")
def systematic_by_value(spark, sf):
    orders = t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return S.systematic_by_value(orders, "o_totalprice", ["o_orderkey"], 4, 200)


@query("equal_strata", "F16", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS i FROM documents)
SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS keys FROM r
WHERE i <= greatest(1, 100 // (SELECT count(*) FROM (SELECT DISTINCT lang FROM documents))) GROUP BY 1
""")
def equal_strata(spark, sf):
    kept = S.equal_strata(t(spark, sf, "documents"), "lang", 100, ["doc_id"])
    return kept.groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("keys"))


@query("weighted_value_stats", "E4", """
WITH r AS (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag
   ORDER BY md5(l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR)) AS i,
   count(*) OVER (PARTITION BY l_returnflag) AS c FROM lineitem),
 k AS (SELECT * FROM r WHERE i <= 1000)
SELECT l_returnflag AS value, round(sum(c / least(c, 1000)))::BIGINT AS count,
       round(sum(c / least(c, 1000)) / (SELECT sum(c / least(c, 1000)) FROM k), 4) AS frequency, count(*) AS sample_count
FROM k GROUP BY 1
""")
def weighted_value_stats(spark, sf):
    kept = S.capped_strata(t(spark, sf, "lineitem"), "l_returnflag", 1000, ["l_orderkey", "l_linenumber"])
    return S.weighted_value_stats(kept, "l_returnflag")


@query("hybrid_numeric_stats", "E5", """
WITH e AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b,
                  quantile_cont(o_totalprice, 0.75) AS c FROM orders),
 m AS (SELECT orders.*, (o_totalprice >= a)::INT + (o_totalprice >= b)::INT + (o_totalprice >= c)::INT AS bucket FROM orders, e),
 r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS i FROM m),
 s AS (SELECT o_totalprice AS x FROM r WHERE i <= 300),
 l AS (SELECT list_sort(list(x)) AS v, count(*) AS n FROM s),
 b AS (SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std, count(o_totalprice) AS n,
              count(DISTINCT o_totalprice) AS u FROM orders)
SELECT 'o_totalprice' AS "column", b.n AS count, 0::BIGINT AS missing_count, u AS n_unique, round(mean, 4) AS mean,
  round(std, 4) AS std, round((SELECT median(x) FROM s), 4) AS median, round(v[l.n // 4 + 1], 4) AS percentile_25,
  round(v[3 * l.n // 4 + 1], 4) AS percentile_75, round(v[1], 4) AS min, round(v[-1], 4) AS max,
  round((SELECT avg((x - mean) ** 3) FROM s) / std ** 3, 4) AS skewness FROM l, b
""")
def hybrid_numeric_stats(spark, sf):
    orders = t(spark, sf, "orders")
    sample = S.quantile_strata(orders, "o_totalprice", 1200, ["o_orderkey"])
    return S.hybrid_numeric_stats(sample, orders, "o_totalprice")


@query("portfolio_overview", "E7", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{s}' AS source_sample, round((count(*) - count({c})) / count(*), 4) AS missing_ratio, "
    f"count(DISTINCT {c}) AS n_unique FROM part"
    for c, s in (("p_partkey", "base"), ("p_name", "base"), ("p_brand", "base"), ("p_type", "stratified"),
                 ("p_size", "base"), ("p_retailprice", "quantile + base"))))
def portfolio_overview(spark, sf):
    part = t(spark, sf, "part")
    wanted = [("p_type", "categorical_low"), ("p_retailprice", "numerical_skewed")]
    return S.portfolio_overview(part, S.sample_portfolio(part, ["p_partkey"], wanted, cap=40, baseline_rows=300))
