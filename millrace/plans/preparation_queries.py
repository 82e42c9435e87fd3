"""Cleaning, preparation and privacy on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import privacy as K
from millrace.operators import clean as C
from millrace.operators import prepare as P
from millrace.operators import privacy as V
from millrace.plans.registry import query
from millrace.session import read_table as t

KEY = b"test key for the examples"


def hmac_sql(message_blob: str, key: bytes = KEY) -> str:
    padded = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in padded).hex(), bytes(b ^ 0x5C for b in padded).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message_blob})))"


def salted(column: str, expr: str) -> str:
    return f"encode('{column}') || unhex('00') || encode({expr})"


@query("base_clean", "G1", """
SELECT count(*) AS n, count(DISTINCT text) AS texts FROM (SELECT DISTINCT lang, source, text FROM documents)
""")
def base_clean(spark, sf):
    docs = t(spark, sf, "documents").select(F.concat(F.lit(" "), "lang", F.lit(" ")).alias("lang"), "source", "text",
                                            F.lit("fixed").alias("same"))
    rows, _ = C.base_clean(docs)
    return rows.agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts")).select("n", "texts")


@query("base_clean_report", "G1", """
SELECT count(*) AS rows_in, count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, text FROM documents)) AS rows_removed, 'same' AS columns_dropped FROM documents
""")
def base_clean_report(spark, sf):
    docs = t(spark, sf, "documents").select("lang", "source", "text", F.lit("fixed").alias("same"))
    return C.base_clean(docs)[1]


def _messy(spark, sf):
    """Orders as an export: money as text, dates as text, a yes/no column, gaps and rare labels."""
    k = F.col("o_orderkey")
    return t(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 10 != 0, F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("closed"),
        F.when(k % 300 == 0, F.concat(F.lit("rare"), (k % 7).cast("string"))).when(k % 4 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(k % 3 == 0, F.col("o_custkey").cast("double")).alias("sparse"))


MESSY = """
WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS price, o_orderdate AS day, o_orderstatus = 'F' AS closed,
 CASE WHEN o_orderkey % 300 = 0 THEN 'rare' || (o_orderkey % 7)::VARCHAR WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS priority FROM orders),
 r AS (SELECT priority FROM m WHERE priority IS NOT NULL GROUP BY 1 HAVING count(*) < 0.01 * (SELECT count(*) FROM m)),
 f AS (SELECT CASE WHEN abs(skewness(price)) >= 1 THEN median(price) ELSE avg(price) END AS fill FROM m)
"""


@query("preparation_plan", "G2 G4", """
SELECT * FROM (VALUES ('price', 'coerce_numeric', ''), ('day', 'parse_datetime', ''), ('closed', 'coerce_boolean', 'yes/no'), ('o_orderkey', 'impute', 'mean'),
 ('price', 'impute', 'mean'), ('closed', 'impute', 'mode'), ('priority', 'impute', 'constant'), ('price', 'add_indicator', ''), ('priority', 'add_indicator', ''),
 ('sparse', 'add_indicator', ''), ('day', 'add_date_parts', ''), ('day', 'add_cyclical', ''), ('per_key', 'add_ratio', 'price/o_orderkey')) v("column", action, detail)
UNION ALL SELECT 'sparse', 'flag_unimputable', round(avg((o_orderkey % 3 <> 0)::INT), 4)::VARCHAR FROM orders
UNION ALL SELECT 'priority', 'group_rare', count(*)::VARCHAR FROM (SELECT 1 FROM orders WHERE o_orderkey % 300 = 0 GROUP BY o_orderkey % 7)
""")
def preparation_plan(spark, sf):
    messy = _messy(spark, sf)
    plan = P.fit_preparation(messy).add_ratio("price", "o_orderkey", "per_key")
    return P.plan_rows(messy, plan)


@query("apply_preparation", "G3", MESSY + """
SELECT o_orderkey, round(coalesce(price, fill), 4) AS price, (price IS NULL)::INT AS price__was_missing, closed,
 CASE WHEN priority IN (SELECT * FROM r) THEN '__other__' ELSE coalesce(priority, '__missing__') END AS priority,
 year(day)::INT AS day__year, isodow(day)::INT - 1 AS day__dayofweek, round(sin(2 * pi() * month(day) / 12), 6) AS day__month_sin,
 round(CASE WHEN o_orderkey <> 0 THEN coalesce(price, fill) / o_orderkey END, 4) AS per_key FROM m, f
""")
def apply_preparation(spark, sf):
    messy = _messy(spark, sf)
    plan = P.fit_preparation(messy).add_ratio("price", "o_orderkey", "per_key")
    out = P.apply_preparation(messy, plan)
    return out.select("o_orderkey", F.round("price", 4).alias("price"), "price__was_missing", "closed", "priority",
                      "day__year", "day__dayofweek", F.round("day__month_sin", 6).alias("day__month_sin"),
                      F.round("per_key", 4).alias("per_key"))


@query("fill_choices", "G4", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN abs(skewness({c})) >= 1 THEN 'median' ELSE 'mean' END AS strategy, "
    f"round(CASE WHEN abs(skewness({c})) >= 1 THEN median({c}) ELSE avg({c}) END, 4) AS value FROM {tb}"
    for c, tb in (("n_chars", "documents"),)))
def fill_choices(spark, sf):
    return P.fill_choices(t(spark, sf, "documents"), ["n_chars"]).withColumn("value", F.round("value", 4))


@query("mode_choices", "G4", """
WITH l AS (SELECT 'l_returnflag' AS "column", l_returnflag AS value FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem),
 c AS (SELECT "column", value, count(*) AS n, sum(count(*)) OVER (PARTITION BY "column") AS total FROM l GROUP BY 1, 2),
 b AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS i FROM c)
SELECT "column", CASE WHEN n / total >= 0.5 THEN 'mode' ELSE 'constant' END AS strategy, CASE WHEN n / total >= 0.5 THEN value ELSE '__missing__' END AS value FROM b WHERE i = 1
""")
def mode_choices(spark, sf):
    return P.mode_choices(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


def _people(spark, sf):
    """Customers with contact data derived from their key."""
    k = F.col("c_custkey")
    body = F.concat(F.lit("4"), F.lpad((k * 7919 % 100000000000000).cast("string"), 14, "0"))
    digits = F.transform(F.split(F.reverse(body), ""), lambda d: d.try_cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 1, d).otherwise(
        F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return t(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lower("c_mktsegment"), k.cast("string"), F.lit("@example.org")).alias("contact"),
        F.concat(body, ((10 - total % 10) % 10).cast("string")).alias("card"),
        F.concat(F.lit("+44 20 7946 "), F.lpad((k % 10000).cast("string"), 4, "0")).alias("line"),
        F.concat((k % 200).cast("string"), F.lit(".10.0."), (k % 250).cast("string")).alias("host"),
        F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (k * 17 % 20000).cast("int")), "yyyy-MM-dd").alias("dob"),
        F.lpad((k % 90000 + 10000).cast("string"), 5, "0").alias("postcode"),
        F.when(k % 2 == 0, "F").otherwise("M").alias("gender"), F.col("c_acctbal").alias("balance"),
        F.when(k % 5 != 0, F.col("c_name")).alias("customer_name"))


@query("personal_data_scan", "G12", """
SELECT * FROM (VALUES ('contact', 'email', 'direct', 1.0::DOUBLE, 'pseudonymise'), ('card', 'credit_card', 'direct', 1.0, 'tokenise'),
 ('line', 'phone', 'direct', 1.0, 'pseudonymise'), ('host', 'ip_address', 'quasi', 1.0, 'keep'), ('dob', 'date_of_birth', 'quasi', 0.95, 'generalise'),
 ('postcode', 'postcode', 'quasi', 0.95, 'generalise'), ('gender', 'gender', 'quasi', 0.85, 'keep'),
 ('customer_name', 'person_name', 'quasi', 0.6, 'pseudonymise')) v("column", kind, sensitivity, confidence, strategy) WHERE (SELECT count(*) FROM customer) > 0
""")
def personal_data_scan(spark, sf):
    return V.scan(_people(spark, sf).drop("c_custkey"))


@query("residual_risk", "G12", """
SELECT count(*) AS n_quasi, string_agg(c, ',' ORDER BY c) AS columns FROM (VALUES ('host'), ('dob'), ('postcode'), ('gender'), ('customer_name')) v(c) WHERE (SELECT count(*) FROM customer) > 0
""")
def residual_risk(spark, sf):
    return V.residual_risk(V.scan(_people(spark, sf).drop("c_custkey")))


@query("document_pii_rates", "G12", r"""
SELECT source, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '[^@\s]+@[^@\s]+\.[A-Za-z]{2,}')) AS with_email,
 sum(length(regexp_replace(text, '[^0-9]', '', 'g')))::BIGINT AS digits FROM documents GROUP BY 1
""")
def document_pii_rates(spark, sf):
    return t(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}")).alias("with_email"),
        F.sum(F.length(F.regexp_replace("text", "[^0-9]", ""))).alias("digits"))


@query("pseudonyms", "G13", f"""
SELECT c_custkey, substr({hmac_sql(salted('c_name', 'c_name'))}, 1, 16) AS token FROM customer
""")
def pseudonyms(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", K.pseudonym(F.col("c_name"), KEY, "c_name").alias("token"))


@query("tail_tokens", "G14", f"""
SELECT c_custkey, substr({hmac_sql(salted('card', "substr(c_name, 1, length(c_name) - 4)"))}, 1, length(c_name) - 4) || right(c_name, 4) AS token FROM customer
""")
def tail_tokens(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", K.tail_token(F.col("c_name"), KEY, "card").alias("token"))


@query("deidentified", "G15", f"""
WITH p AS (SELECT *, lower(c_mktsegment) || c_custkey || '@example.org' AS contact, DATE '1950-01-01' + (c_custkey * 17 % 20000)::INT AS dob FROM customer)
SELECT c_custkey, substr({hmac_sql(salted('contact', 'contact'))}, 1, 16) AS contact,
 greatest(2026 - year(dob), 0) // 10 * 10 || '-' || (greatest(2026 - year(dob), 0) // 10 * 10 + 9) AS dob,
 substr((c_custkey % 90000 + 10000)::VARCHAR, 1, 3) AS postcode, '__redacted__' AS customer_name FROM p
""")
def deidentified(spark, sf):
    people = _people(spark, sf)
    rules = V.contract(V.scan(people.drop("c_custkey")))
    out = V.deidentify(people, rules, KEY, overrides={"customer_name": "redact"})
    return out.select("c_custkey", "contact", "dob", "postcode", "customer_name")


@query("allow_listed_export", "G16", f"""
SELECT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type END AS event_type, CASE WHEN value BETWEEN 0 AND 50 THEN value END AS value, 'site-1' AS install_id,
 substr({hmac_sql("encode('export:' || (datediff('day', DATE '1970-01-01', ts::DATE) // 28)::VARCHAR || ':' || user_id::VARCHAR)")}, 1, 32) AS actor_id FROM events
""")
def allow_listed_export(spark, sf):
    allowed = {"event_type": F.col("event_type").isin("click", "view", "purchase"), "value": F.col("value").between(0, 50)}
    return V.export_rows(t(spark, sf, "events"), allowed, "site-1", "user_id", "ts", KEY)


@query("valid_target_rows", "G17", """
SELECT 'classes' AS task, count(quality) AS n FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'numbers', count(*) FROM orders WHERE o_orderkey % 7 <> 0
""")
def valid_target_rows(spark, sf):
    docs = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    text = t(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(
        F.col("o_totalprice").cast("string")).alias("y"))
    a = C.with_valid_target(docs, "quality", "binary_classification").agg(F.lit("classes").alias("task"), F.count("*").alias("n"))
    return a.unionByName(C.with_valid_target(text, "y", "regression").agg(F.lit("numbers").alias("task"), F.count("*").alias("n")))
