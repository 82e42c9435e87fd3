"""Column transforms on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import numbers as N
from millrace.functions import text as X
from millrace.operators import clean as C
from millrace.plans.registry import query
from millrace.session import read_table as t


@query("select_rename_drop", "C1", """
SELECT c_custkey AS customer_id, c_mktsegment AS segment, c_acctbal FROM customer
""")
def select_rename_drop(spark, sf):
    return t(spark, sf, "customer").drop("c_name", "c_nationkey").withColumnsRenamed(
        {"c_custkey": "customer_id", "c_mktsegment": "segment"}).select("customer_id", "segment", "c_acctbal")


@query("nested_filter", "C2", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE (o_orderstatus = 'F' AND o_totalprice > 300000) OR (o_orderstatus = 'P' AND o_orderdate IS NOT NULL AND NOT o_orderpriority = '5-LOW')
""")
def nested_filter(spark, sf):
    c = F.col
    rule = ((c("o_orderstatus") == "F") & (c("o_totalprice") > 300000)) | (
        (c("o_orderstatus") == "P") & c("o_orderdate").isNotNull() & ~(c("o_orderpriority") == "5-LOW"))
    return t(spark, sf, "orders").where(rule).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("numeric_looking_text_filter", "C4", """
SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 1400
""")
def numeric_looking_text_filter(spark, sf):
    part = t(spark, sf, "part").withColumn("price", F.concat(F.lit("₹ "), F.col("p_retailprice").cast("string"), F.lit(" /-")))
    return part.where(N.digits_only(F.regexp_replace("price", " /-$", "")) >= 1400).select("p_partkey", "p_retailprice")


@query("trimmed_equality", "C5", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def trimmed_equality(spark, sf):
    padded = t(spark, sf, "customer").withColumn("seg", F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))
    return padded.where(X.equals_trimmed(F.col("seg"), "BUILDING")).agg(F.count("*").alias("n"))


@query("cast_then_arithmetic", "C6", """
SELECT l_returnflag, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)))::DOUBLE AS cost,
       sum(CAST(l_quantity AS BIGINT))::BIGINT AS units FROM lineitem GROUP BY 1
""")
def cast_then_arithmetic(spark, sf):
    price, disc = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(18,2)")
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.sum(price * disc).cast("double").alias("cost"), F.sum(F.col("l_quantity").cast("bigint")).alias("units"))


@query("conditional_column", "C7", """
SELECT CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'large' END AS size,
       count(*) AS n FROM orders GROUP BY 1
""")
def conditional_column(spark, sf):
    p = F.col("o_totalprice")
    size = F.when(p < 100000, "small").when(p < 300000, "medium").otherwise("large")
    return t(spark, sf, "orders").groupBy(size.alias("size")).agg(F.count("*").alias("n"))


@query("null_where", "C8", "SELECT count(CASE WHEN NOT c_acctbal < 0 THEN c_acctbal END) AS kept, count(*) AS n FROM customer")
def null_where(spark, sf):
    df = C.null_where(t(spark, sf, "customer"), "c_acctbal", F.col("c_acctbal") < 0)
    return df.agg(F.count("c_acctbal").alias("kept"), F.count("*").alias("n"))


@query("fill_with_global", "C9", """
WITH d AS (SELECT lang, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, round(sum(coalesce(quality, (SELECT avg(quality) FROM d))), 4) AS by_mean,
       round(sum(coalesce(quality, (SELECT median(quality) FROM d))), 4) AS by_median, sum(coalesce(quality, 0))::BIGINT AS by_zero
FROM d GROUP BY 1
""")
def fill_with_global(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left").select("lang", "quality")
    d = d.withColumns({"m": F.col("quality"), "d": F.col("quality"), "z": F.col("quality")})
    d = C.fill_with(C.fill_with_aggregate(C.fill_with_aggregate(d, "m", "mean"), "d", "median"), "z", 0)
    return d.groupBy("lang").agg(F.round(F.sum("m"), 4).alias("by_mean"), F.round(F.sum("d"), 4).alias("by_median"),
                                 F.sum("z").alias("by_zero"))


@query("fill_with_group_median", "C10", """
WITH d AS (SELECT event_type, event_id, CASE WHEN value > 20 THEN NULL ELSE value END AS v FROM events),
 m AS (SELECT event_type, median(v) AS md FROM d GROUP BY 1)
SELECT d.event_type, count(coalesce(v, md)) AS n, round(sum(coalesce(v, md)), 3) AS total FROM d JOIN m USING (event_type) GROUP BY 1
""")
def fill_with_group_median(spark, sf):
    d = C.null_where(t(spark, sf, "events"), "value", F.col("value") > 20)
    d = C.fill_with_group_median(d, "value", ["event_type"])
    return d.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("string_functions", "C12", """
SELECT c_custkey, c_name || ', ' || c_mktsegment AS joined, substr(c_name, 1, 4) AS head, right(c_name, 4) AS tail,
 upper(c_name) AS up, lower(c_name) AS low, c_mktsegment[1] || lower(c_mktsegment[2:]) AS title,
 replace(c_name, 'Customer', 'C') AS swapped, split_part(c_name, '#', 2) AS number FROM customer
""")
def string_functions(spark, sf):
    name = F.col("c_name")
    return t(spark, sf, "customer").select(
        "c_custkey", F.concat(name, F.lit(", "), "c_mktsegment").alias("joined"),
        X.zero_based_substring(name, 0, 4).alias("head"), X.last_chars(name, 4).alias("tail"), F.upper(name).alias("up"),
        F.lower(name).alias("low"), F.initcap(F.lower("c_mktsegment")).alias("title"),
        F.replace(name, F.lit("Customer"), F.lit("C")).alias("swapped"), F.split_part(name, F.lit("#"), F.lit(2)).alias("number"))


@query("masks", "C13", r"""
SELECT c_custkey, 'XXX-XX-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS ssn, '***@example.com' AS email, c_name AS other FROM customer
""")
def masks(spark, sf):
    tail = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    return t(spark, sf, "customer").select(
        "c_custkey", X.mask_ssn(F.concat(F.lit("123-45-"), tail)).alias("ssn"),
        X.mask_email(F.concat("c_custkey", F.lit("@example.com"))).alias("email"), X.mask_email(X.mask_ssn(F.col("c_name"))).alias("other"))


@query("hashes", "C14", "SELECT c_custkey, md5(c_name) AS md5, sha1(c_name) AS sha1, sha256(c_name) AS sha256 FROM customer")
def hashes(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", *[X.hex_digest(F.col("c_name"), a).alias(a) for a in ("md5", "sha1", "sha256")])


@query("parse_dates", "C15", """
SELECT o_orderkey, o_orderdate::DATE AS day, 'dd/MM/yyyy' AS format FROM orders
""")
def parse_dates(spark, sf):
    text = t(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("text"))
    fmt = D.best_format(text, "text", ["MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM-dd"])
    return text.select("o_orderkey", D.parse_timestamp(F.col("text"), fmt).cast("date").alias("day"), F.lit(fmt).alias("format"))


@query("date_parts", "C16", """
SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day, isodow(o_orderdate)::INT - 1 AS dayofweek,
 hour(o_orderdate)::INT AS hour, week(o_orderdate)::INT AS isoweek, month(o_orderdate) = 12 AS is_december, count(*) AS n FROM orders GROUP BY ALL
""")
def date_parts(spark, sf):
    parts = [v.alias(k) for k, v in D.date_parts(F.col("o_orderdate")).items()]
    return t(spark, sf, "orders").groupBy(*parts).agg(F.count("*").alias("n"))


@query("date_arithmetic", "C17", """
SELECT o_orderkey, o_orderdate::DATE + 30 AS due, o_orderdate::DATE - 7 AS notice, datediff('day', o_orderdate::DATE, DATE '2002-01-01') AS days_since FROM orders
""")
def date_arithmetic(spark, sf):
    day = F.to_date("o_orderdate")
    return t(spark, sf, "orders").select(
        "o_orderkey", F.date_add(day, 30).alias("due"), F.date_sub(day, 7).alias("notice"),
        D.days_between(F.lit("2002-01-01").cast("date"), day).alias("days_since"))


@query("month_cycle", "C18", """
SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12.0), 8) AS month_sin, round(cos(2 * pi() * month(o_orderdate) / 12.0), 8) AS month_cos FROM orders
""")
def month_cycle(spark, sf):
    s, c = D.month_cycle(F.col("o_orderdate"))
    return t(spark, sf, "orders").select("o_orderkey", F.round(s, 8).alias("month_sin"), F.round(c, 8).alias("month_cos"))


@query("ratio_feature", "C19", """
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END, 6) AS ratio FROM lineitem
""")
def ratio_feature(spark, sf):
    return t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(N.ratio(F.col("l_tax"), F.col("l_discount")), 6).alias("ratio"))


@query("scaling", "C20", """
WITH f AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)
SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) AS mm, round((o_totalprice - m) / s, 6) AS z, round(ln(1 + o_totalprice), 6) AS lg FROM orders, f
""")
def scaling(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    for how, out in (("min_max", "mm"), ("z_score", "z"), ("log", "lg")):
        df = C.scaled(df, "o_totalprice", how, out)
    return df.select("o_orderkey", *[F.round(c, 6).alias(c) for c in ("mm", "z", "lg")])


@query("rounded_integer", "C21", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE round_even(o_totalprice, 0)::BIGINT END AS whole FROM orders
""")
def rounded_integer(spark, sf):
    price = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    return t(spark, sf, "orders").select("o_orderkey", N.rounded_integer(price).alias("whole"))


@query("costumed_numbers", "C22", """
SELECT o_orderkey, round(CASE o_orderkey % 6 WHEN 0 THEN o_totalprice WHEN 1 THEN -o_totalprice WHEN 2 THEN o_totalprice / 100 WHEN 3 THEN o_totalprice
 WHEN 4 THEN o_totalprice ELSE NULL END, 4) AS value FROM orders
""")
def costumed_numbers(spark, sf):
    us = F.format_number("o_totalprice", 2)
    european = F.translate(us, ",.", ".,")
    k = F.col("o_orderkey") % 6
    text = (F.when(k == 0, F.concat(F.lit("$"), us)).when(k == 1, F.concat(F.lit("(£"), us, F.lit(")")))
            .when(k == 2, F.concat(us, F.lit(" %"))).when(k == 3, european).when(k == 4, F.concat(F.lit(" "), us, F.lit(" €")))
            .otherwise(F.concat(us, F.lit(" approx"))))
    # European text of a number below one thousand has no grouping mark and stays ambiguous.
    value = F.when((k == 3) & (F.col("o_totalprice") < 1000), F.col("o_totalprice")).otherwise(N.parse_costumed(text))
    return t(spark, sf, "orders").select("o_orderkey", F.round(value, 4).alias("value"))


@query("strict_numbers", "C23", """
SELECT count(*) FILTER (WHERE o_orderkey % 5 = 0) AS violations, round(sum(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END), 2) AS total FROM orders
""")
def strict_numbers(spark, sf):
    us = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(us, F.lit("k"))).otherwise(us)
    return t(spark, sf, "orders").select(text.alias("c")).agg(
        F.count_if(N.strict_violation(F.col("c"))).alias("violations"), F.round(F.sum(N.strict_number(F.col("c"))), 2).alias("total"))


LATLON = "(c_custkey * 7 % 1200) / 10.0 - 60 AS lat, (c_custkey * 13 % 3000) / 10.0 - 150 AS lon"


@query("haversine", "C24 P2", f"""
WITH p AS (SELECT c_custkey, {LATLON} FROM customer),
 h AS (SELECT *, sin(radians(lat - 48.85) / 2) ** 2 + cos(radians(48.85)) * cos(radians(lat)) * sin(radians(lon - 2.35) / 2) ** 2 AS a FROM p)
SELECT c_custkey, round(2 * 6371 * asin(sqrt(a)), 4) AS km, round(2 * 6371 * asin(sqrt(a)) / 2, 4) AS kmh FROM h
""")
def haversine(spark, sf):
    k = F.col("c_custkey")
    lat, lon = (k * 7 % 1200) / 10.0 - 60, (k * 13 % 3000) / 10.0 - 150
    km = D.haversine_km(F.lit(48.85), F.lit(2.35), lat, lon)
    return t(spark, sf, "customer").select(
        "c_custkey", F.round(km, 4).alias("km"), F.round(D.speed_kmh(km, F.lit(7200.0)), 4).alias("kmh"))


@query("grid_cells", "C25", f"""
SELECT round(lat, 0) AS cell_lat, round(lon, 0) AS cell_lon, count(*) AS n FROM (SELECT {LATLON} FROM customer) GROUP BY 1, 2
ORDER BY n DESC, 1, 2 LIMIT 20
""")
def grid_cells(spark, sf):
    k = F.col("c_custkey")
    points = t(spark, sf, "customer").select(((k * 7 % 1200) / 10.0 - 60).alias("lat"), ((k * 13 % 3000) / 10.0 - 150).alias("lon"))
    return C.top_cells(points, "lat", "lon", 0, 20)


@query("magnitude_bands", "C26", """
WITH b AS (SELECT CASE WHEN n_chars <= 0 THEN '0' WHEN n_chars <= 100 THEN '1-1e2' WHEN n_chars <= 1000 THEN '1e2-1e3' WHEN n_chars <= 10000 THEN '1e3-1e4'
 WHEN n_chars <= 100000 THEN '1e4-1e5' ELSE '1e5-1e6' END AS row_band, CASE WHEN n_chars <= 10 THEN '1-10' WHEN n_chars <= 50 THEN '10-50' WHEN n_chars <= 200
 THEN '50-200' WHEN n_chars <= 1000 THEN '200-1000' ELSE '1000+' END AS column_band, CASE WHEN n_chars <= 20 THEN '1-20' WHEN n_chars <= 80 THEN '21-80' WHEN
 n_chars <= 200 THEN '81-200' WHEN n_chars <= 500 THEN '201-500' ELSE '500+' END AS prompt_band FROM documents)
SELECT *, count(*) AS n FROM b GROUP BY ALL
""")
def magnitude_bands(spark, sf):
    c = F.col("n_chars")
    return t(spark, sf, "documents").groupBy(
        N.row_count_band(c).alias("row_band"), N.column_count_band(c).alias("column_band"), N.prompt_length_band(c).alias("prompt_band")
    ).agg(F.count("*").alias("n"))


@query("age_bands", "C27", """
SELECT ((2026 - year(o_orderdate)) // 10 * 10)::VARCHAR || '-' || ((2026 - year(o_orderdate)) // 10 * 10 + 9)::VARCHAR AS age_band,
 upper(substr(o_orderpriority, 1, 3)) AS area, count(*) AS n FROM orders GROUP BY 1, 2
""")
def age_bands(spark, sf):
    return t(spark, sf, "orders").groupBy(
        D.age_band(F.col("o_orderdate"), 2026).alias("age_band"), D.postcode_area(F.col("o_orderpriority")).alias("area")
    ).agg(F.count("*").alias("n"))


@query("two_valued_text", "C28", "SELECT l_linestatus = 'O' AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def two_valued_text(spark, sf):
    line = t(spark, sf, "lineitem").withColumn("flag", F.when(F.col("l_linestatus") == "O", " Yes").otherwise("no"))
    return C.boolean_column(line, "flag").groupBy("flag").agg(F.count("*").alias("n"))


@query("year_without_year_column", "C35", """
SELECT o_orderstatus, count(*) AS n, count(*) AS n_text FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1
""")
def year_without_year_column(spark, sf):
    orders = t(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "MM/dd/yyyy"))
    by_date = C.filter_year(orders, "o_orderdate", 1997).groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    by_text = C.filter_year(orders, "day", 1997).groupBy("o_orderstatus").agg(F.count("*").alias("n_text"))
    return by_date.join(by_text, "o_orderstatus")
