"""Chart aggregates on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import charts as C
from millrace.plans.registry import query
from millrace.session import read_table as t


@query("chart_categories", "D13", """
WITH v AS (SELECT trim(p_brand) AS k, count(*)::DOUBLE AS v FROM part GROUP BY 1)
SELECT row_number() OVER (ORDER BY v DESC, k)::INTEGER AS position, k AS x, v AS y,
       round(v / (SELECT sum(v) FROM v), 6) AS share FROM v ORDER BY v DESC, k LIMIT 15
""")
def chart_categories(spark, sf):
    return C.categories(t(spark, sf, "part"), "p_brand").withColumn("share", F.round("share", 6))


@query("chart_pie_with_other", "D13", """
WITH v AS (SELECT trim(p_name) AS k, sum(p_retailprice) AS v FROM part GROUP BY 1),
 r AS (SELECT *, row_number() OVER (ORDER BY v DESC, k)::INTEGER AS position FROM v)
SELECT position, k AS x, round(v, 2) AS y, round(v / (SELECT sum(v) FROM v), 6) AS share FROM r WHERE position <= 6
UNION ALL SELECT 7, 'Other', round(sum(v), 2), round(sum(v) / (SELECT sum(v) FROM v), 6) FROM r WHERE position > 6
""")
def chart_pie_with_other(spark, sf):
    pie = C.categories(t(spark, sf, "part"), "p_name", "p_retailprice", "sum", top=6, pie=True)
    return pie.withColumn("share", F.round("share", 6))


@query("chart_years_in_order", "D13", """
WITH v AS (SELECT year(o_orderdate)::VARCHAR AS k, avg(o_totalprice) AS v FROM orders GROUP BY 1),
 s AS (SELECT * FROM v ORDER BY k DESC LIMIT 5)
SELECT row_number() OVER (ORDER BY k)::INTEGER AS position, k AS x, round(v, 2) AS y, NULL::DOUBLE AS share FROM s
""")
def chart_years_in_order(spark, sf):
    orders = t(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return C.categories(orders, "year", "o_totalprice", "mean", top=5)


@query("chart_histogram", "D14", """
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
 b AS (SELECT greatest(0, least(floor((o_totalprice - lo) / ((hi - lo) / 30)), 29))::INTEGER AS bin, count(*) AS y FROM orders, r GROUP BY 1)
SELECT i::INTEGER AS bin, round(lo + i * ((hi - lo) / 30), 6) AS x0, round(lo + (i + 1) * ((hi - lo) / 30), 6) AS x1,
       coalesce(y, 0) AS y FROM r, range(30) g(i) LEFT JOIN b ON bin = i
""")
def chart_histogram(spark, sf):
    return C.histogram(t(spark, sf, "orders"), "o_totalprice", 30)


@query("chart_histogram_skewed", "D14", """
WITH x AS (SELECT n_chars::DOUBLE AS x FROM documents),
 r AS (SELECT min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.99) AS cap FROM x),
 b AS (SELECT greatest(0, least(floor((least(x, cap) - lo) / ((cap - lo) / 20)), 19))::INTEGER AS bin, count(*) AS y FROM x, r GROUP BY 1)
SELECT i::INTEGER AS bin, round(lo + i * ((cap - lo) / 20), 6) AS x0,
       CASE WHEN i = 19 THEN hi ELSE round(lo + (i + 1) * ((cap - lo) / 20), 6) END AS x1,
       coalesce(y, 0) AS y FROM r, range(20) g(i) LEFT JOIN b ON bin = i
""")
def chart_histogram_skewed(spark, sf):
    return C.histogram(t(spark, sf, "documents"), "n_chars", 20)


@query("chart_scatter_facts", "D15", """
SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r,
       least(500, ceil(count(*) / greatest(1, count(*) // 500)))::INTEGER AS points_shown, 0::BIGINT AS points_hidden FROM lineitem
""")
def chart_scatter_facts(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    facts, _ = C.scatter(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", order)
    return facts.withColumn("r", F.round("r", 6))


@query("chart_scatter_points", "D15", """
WITH r AS (SELECT o_totalprice AS x, o_custkey::DOUBLE AS y, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders)
SELECT x, y FROM r WHERE (i - 1) % greatest(1, n // 500) = 0 AND i <= greatest(1, n // 500) * 500
""")
def chart_scatter_points(spark, sf):
    return C.scatter(t(spark, sf, "orders"), "o_totalprice", "o_custkey", ["o_orderkey"])[1]


MONTHLY = """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*)::DOUBLE AS y FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
 s AS (SELECT count(*) AS k, min(period) AS a, max(period) AS b, median(y) AS md FROM m),
 p AS (SELECT period, y, k >= 4 AND period IN (a, b) AND y < 0.5 * md AS is_partial FROM m, s),
 c AS (SELECT *, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS n FROM p WHERE NOT is_partial)
"""


@query("chart_monthly", "D16", MONTHLY + "SELECT * FROM p")
def chart_monthly(spark, sf):
    return C.monthly_series(t(spark, sf, "orders"), "o_orderdate")


@query("chart_monthly_facts", "D16", MONTHLY + """
SELECT count(*) AS n_months, arg_max(period, (y, period)) AS peak, arg_min(period, (y, period)) AS low,
       round(avg(y), 6) AS mean,
       round(avg(y) FILTER (WHERE i > n // 2) / avg(y) FILTER (WHERE i <= n // 2) - 1, 6) AS half_change FROM c
""")
def chart_monthly_facts(spark, sf):
    facts = C.monthly_facts(C.monthly_series(t(spark, sf, "orders"), "o_orderdate"))
    return facts.withColumn("mean", F.round("mean", 6)).withColumn("half_change", F.round("half_change", 6))


@query("chart_seasonality", "D16", MONTHLY + """
, q AS (SELECT substr(period, 6, 2)::INTEGER AS month, avg(y) AS mean FROM c WHERE (SELECT count(*) FROM c) >= 24 GROUP BY 1)
SELECT month, round(mean, 6) AS mean, round(mean / avg(mean) OVER () - 1, 6) AS vs_overall FROM q
""")
def chart_seasonality(spark, sf):
    out = C.seasonality(C.monthly_series(t(spark, sf, "orders"), "o_orderdate"))
    return out.select("month", F.round("mean", 6).alias("mean"), F.round("vs_overall", 6).alias("vs_overall"))


@query("rate_by_band_whole", "D17", """
WITH p AS (SELECT n_chars::DOUBLE AS x, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
 r AS (SELECT min(x) AS lo, max(x) AS hi, greatest(1.0, ceil((max(x) - min(x) + 1) / 8)) AS w FROM p),
 b AS (SELECT least(floor((x - lo) / w), ceil((hi - lo + 1) / w) - 1)::INTEGER AS band, count(*) AS n, round(avg(y), 4) AS rate FROM p, r GROUP BY 1)
SELECT band, lo + band * w AS low, CASE WHEN band = ceil((hi - lo + 1) / w) - 1 THEN hi ELSE lo + band * w + w - 1 END AS high, n, rate FROM b, r
""")
def rate_by_band_whole(spark, sf):
    joined = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    return C.rate_by_band(joined, "n_chars", "quality")


@query("rate_by_band", "D17", """
WITH p AS (SELECT l_extendedprice AS x, (l_returnflag = 'R')::INT AS y FROM lineitem),
 r AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 8 AS w FROM p),
 b AS (SELECT least(floor((x - lo) / w), 7)::INTEGER AS band, count(*) AS n, round(avg(y), 4) AS rate FROM p, r GROUP BY 1)
SELECT band, round(lo + band * w, 4) AS low, round(CASE WHEN band = 7 THEN hi ELSE lo + band * w + w END, 4) AS high, n, rate FROM b, r
""")
def rate_by_band(spark, sf):
    line = t(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    out = C.rate_by_band(line, "l_extendedprice", "y")
    return out.withColumn("low", F.round("low", 4)).withColumn("high", F.round("high", 4))


@query("rate_by_group", "D18", """
SELECT lang AS x, count(*) AS n, round(avg(quality), 4) AS rate FROM documents JOIN labels USING (doc_id)
WHERE quality IN (0, 1) GROUP BY 1 ORDER BY avg(quality) DESC, 1 LIMIT 15
""")
def rate_by_group(spark, sf):
    return C.rate_by_group(t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id"), "lang", "quality")


@query("rate_drivers", "D19", """
WITH d AS (SELECT lang, source, n_chars::DOUBLE AS x, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
 r AS (SELECT min(x) AS lo, max(x) AS hi, greatest(1.0, ceil((max(x) - min(x) + 1) / 8)) AS w FROM d),
 g AS (SELECT 'n_chars' AS "column", 'numeric' AS kind, least(floor((x - lo) / w), ceil((hi - lo + 1) / w) - 1)::VARCHAR AS k, count(*) AS n, round(avg(y), 4) AS rate FROM d, r GROUP BY 3
       UNION ALL SELECT 'lang', 'categorical', lang, count(*), round(avg(y), 4) FROM d GROUP BY 3
       UNION ALL SELECT 'source', 'categorical', source, count(*), round(avg(y), 4) FROM d GROUP BY 3),
 s AS (SELECT * FROM g WHERE n >= 20), o AS (SELECT "column", sum(rate * n) / sum(n) AS p FROM s GROUP BY 1)
SELECT s."column", kind, round((sum(n * (rate - p) ** 2) / (max(p) * (1 - max(p))) - (count(*) - 1)) / sqrt(2.0 * (count(*) - 1)), 5) AS z
FROM s JOIN o ON s."column" = o."column" GROUP BY 1, 2 HAVING count(*) >= 2 AND max(p) > 0 AND max(p) < 1
""")
def rate_drivers(spark, sf):
    joined = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    return C.rate_drivers(joined, "quality", ["n_chars"], ["lang", "source"]).withColumn("z", F.round("z", 5))


@query("missing_and_present", "D20", """
SELECT 'Present' AS x, count(quality)::DOUBLE AS y FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'Missing', (count(*) - count(quality))::DOUBLE FROM documents LEFT JOIN labels USING (doc_id)
""")
def missing_and_present(spark, sf):
    joined = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    return C.missing_and_present(joined, "quality")
