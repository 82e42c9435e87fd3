"""Text scrubbing, claims, chunks and vector search on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import claims as C
from millrace.operators import retrieval as R
from millrace.plans.registry import query
from millrace.session import read_table as t
from millrace.session import spread


@query("scrubbed_documents", "C29 P1")
def scrubbed_documents(spark, sf):
    out = X.scrub(spread(t(spark, sf, "documents").select("doc_id", "text")), "text")
    return out.select("doc_id", "cleaned", *[f"n_{c}" for c in X.SCRUB_CATEGORIES])


@query("scrubbed_contacts", "C29", r"""
SELECT c_custkey, 'mail [email] or see [url] now, call [number]' AS cleaned, 1 AS n_email, 1 AS n_url, 1 AS n_number, 0 AS n_credential FROM customer
""")
def scrubbed_contacts(spark, sf):
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("mail  u"), k, F.lit("@example.org or see https://x.example/"), k, F.lit(" now, call +44 20 7946 "),
                    F.lpad(k, 5, "0"))
    out = X.scrub(t(spark, sf, "customer").select("c_custkey", text.alias("t")), "t")
    return out.select("c_custkey", "cleaned", "n_email", "n_url", "n_number", "n_credential")


@query("stripped_names", "C30", r"""
WITH w AS (SELECT item_id, string_split_regex(trim(text), '\s+') AS c FROM benchmark),
 k AS (SELECT item_id, list_transform(c, lambda x: CASE WHEN regexp_replace(lower(x), '[^a-z]', '', 'g') IN ('the', 'that', 'thes') OR regexp_replace(lower(x), '[^a-z]', '', 'g') = 'thats' THEN 1 ELSE 0 END) AS h FROM w)
SELECT item_id, list_sum(h)::INTEGER AS n_aligned_or_plural FROM k
""")
def stripped_names(spark, sf):
    # "that" also counts inside longer words, which the twin does not look at; only whole words and plurals are compared.
    out = X.strip_names(t(spark, sf, "benchmark"), "text", ["the", "That"])
    whole = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "").isin("the", "that", "thes", "thats"))
    return out.select("item_id", F.when(F.col("n_aligned") + F.col("n_inside") >= F.size(whole), F.size(whole)).otherwise(-1).alias("n_aligned_or_plural"))


@query("stripped_names_text", "C30")
def stripped_names_text(spark, sf):
    names = [*t(spark, sf, "documents").columns, *t(spark, sf, "lineitem").columns, "order_date", "region"]
    return X.strip_names(spread(t(spark, sf, "conversations")), "text", names).select("conv_id", "turn", "stripped", "n_aligned", "n_inside")


CLAIMS = r"""
WITH b AS (SELECT doc_id AS id, regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`\n]*`', ' ', 'g') AS t FROM documents),
 s AS (SELECT id, list_filter(list_transform(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 15) AS c FROM b),
 claims AS (SELECT id, unnest(generate_series(0, len(c) - 1)) AS position, unnest(c) AS claim FROM s WHERE len(c) > 0)
"""


@query("claim_counts", "C32", CLAIMS + "SELECT id AS doc_id, count(*) AS n, sum(length(claim))::BIGINT AS chars FROM claims GROUP BY 1")
def claim_counts(spark, sf):
    claims = C.split_claims(spread(t(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")
    return claims.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("claim")).alias("chars"))


@query("claim_wording", "C32", r"""
SELECT o_orderkey, o_orderkey % 4 = 0 AS causal, o_orderkey % 4 = 1 AS absolute, o_orderkey % 4 = 2 AS significance FROM orders
""")
def claim_wording(spark, sf):
    k = F.col("o_orderkey") % 4
    words = F.when(k == 0, "Discounts led to more orders").when(k == 1, "It will always be so").when(
        k == 2, "A significant difference").otherwise("We did a root cause study")
    text = F.concat(words, F.lit(" in that year, as noted. `always` "))
    claims = C.split_claims(t(spark, sf, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text")
    return C.wording_flags(claims).select("o_orderkey", "causal", "absolute", "significance")


@query("invented_numbers", "C31 H8", r"""
WITH n AS (SELECT c_custkey, floor(c_acctbal * 10 / 3) / 10 AS v FROM customer), e AS (SELECT DISTINCT s_acctbal AS k FROM supplier)
SELECT c_custkey, v AS value FROM n WHERE NOT (v = floor(v) AND (abs(v) < 10 OR v BETWEEN 1900 AND 2100)) AND NOT EXISTS (SELECT 1 FROM e WHERE abs(v - k) <= greatest(0.01, abs(k) * 0.01))
""")
def invented_numbers(spark, sf):
    figure = (F.floor(F.col("c_acctbal") * 10 / 3) / 10).cast("decimal(12,1)").cast("string")
    claims = t(spark, sf, "customer").select("c_custkey", F.lit(0).alias("position"), F.concat(
        F.lit("The balance came to "), figure, F.lit(" across 3 regions in 2021.")).alias("claim"))
    return C.invented_numbers(claims, "c_custkey", t(spark, sf, "supplier"), "s_acctbal").select("c_custkey", "value")


@query("invented_percentages", "C31", r"""
WITH r AS (SELECT DISTINCT l_discount AS k FROM lineitem), n AS (SELECT p_partkey, p_size::DOUBLE AS v FROM part)
SELECT p_partkey, v AS value FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE abs(v - k) <= greatest(0.01, abs(k) * 0.01) OR abs(v - k * 100) <= greatest(0.051, abs(k * 100) * 0.01))
""")
def invented_percentages(spark, sf):
    claims = t(spark, sf, "part").select("p_partkey", F.lit(0).alias("position"), F.concat(
        F.lit("The rate reached "), F.col("p_size").cast("string"), F.lit("% overall.")).alias("claim"))
    return C.invented_numbers(claims, "p_partkey", t(spark, sf, "lineitem"), "l_discount").select("p_partkey", "value")


@query("wrong_superlatives", "C33", r"""
WITH e AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'lowest' ELSE 'highest' END AS direction FROM supplier, e
WHERE CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal <> lo ELSE s_acctbal <> hi END
""")
def wrong_superlatives(spark, sf):
    supplier = t(spark, sf, "supplier")
    word = F.when(F.col("s_suppkey") % 2 == 0, "lowest").otherwise("highest")
    claims = supplier.select("s_suppkey", F.lit(0).alias("position"), F.concat(
        F.lit("The "), word, F.lit(" balance is "), F.col("s_acctbal").cast("decimal(12,2)").cast("string"), F.lit(" here")).alias("claim"))
    return C.ordering_contradicted(claims, "s_suppkey", supplier, ["s_acctbal"]).select("s_suppkey", "direction")


@query("unanchored_words", "C34", r"""
WITH v AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(x, '[a-z]+|[A-Z]?[a-z]+|[A-Z]+')) AS w FROM
  (SELECT c_mktsegment AS x FROM customer UNION ALL SELECT 'c_mktsegment' UNION ALL SELECT 'c_acctbal')) WHERE length(w) >= 3)
SELECT t AS token FROM (VALUES ('buildings'), ('churn'), ('acctbal'), ('segment'), ('weather')) q(t)
WHERE NOT EXISTS (SELECT 1 FROM v WHERE w = t OR (length(w) >= 4 AND (contains(t, w) OR contains(w, t))))
""")
def unanchored_words(spark, sf):
    table = t(spark, sf, "customer").select("c_mktsegment", "c_acctbal")
    return C.unanchored_words(table, ["buildings", "churn", "acctbal", "segment", "weather"])


def _marked(spark, sf):
    """Documents as marked-up text: every fourth line opens a section."""
    lines = F.split("text", "\n")
    body = F.array_join(F.transform(lines, lambda x, i: F.when(i % 4 == 0, F.concat(
        F.lit("## Part "), (i / 4).cast("int").cast("string"), F.lit(" [#](#p)\n\n"), x)).otherwise(x)), "\n\n")
    return spread(t(spark, sf, "documents").select("doc_id", "text")).select("doc_id", body.alias("text"))


@query("chunks", "N1 N2 P5", r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
 s AS (SELECT doc_id, unnest(generate_series(0, (len(x) - 1) // 4)) AS i, x FROM l),
 p AS (SELECT doc_id, i, rtrim('## Part ' || i || ' [#](#p)' || chr(10) || chr(10) || regexp_replace(regexp_replace(regexp_replace(array_to_string(x[i * 4 + 1 : i * 4 + 4], chr(10) || chr(10)), '-{3,}', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS body FROM s)
SELECT doc_id, count(*) AS sections FROM p WHERE length(body) >= 100 GROUP BY 1
""")
def chunks(spark, sf):
    out = R.chunks(_marked(spark, sf), "doc_id", "text")
    sections = out.where("chunk_type <> 'full_file'").groupBy("doc_id").agg(F.countDistinct("section").alias("sections"))
    return sections


@query("chunk_rows", "N1")
def chunk_rows(spark, sf):
    return R.chunks(_marked(spark, sf), "doc_id", "text")


@query("cleaned_headings", "N2", "SELECT p_partkey, p_name || '_x' AS heading, p_partkey % 3 = 0 AS is_noise FROM part")
def cleaned_headings(spark, sf):
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit("Back to top")).otherwise(F.col("p_name"))
    raw = F.concat(F.lit("## "), "p_name", F.lit("\\_x [#](#anchor)"))
    return t(spark, sf, "part").select("p_partkey", R.clean_heading(raw).alias("heading"), R.is_noise_heading(name).alias("is_noise"))


@query("unique_chunks", "N3", r"""
SELECT count(*) AS n, sum(i)::BIGINT AS ids FROM (SELECT min(doc_id) AS i FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' GROUP BY regexp_replace(text, '^\s+|\s+$', '', 'g'))
""")
def unique_chunks(spark, sf):
    out = R.unique_chunks(t(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id")
    return out.agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("search_keywords", "N4", """
SELECT p_partkey, 'filter function sort_by function ''' || p_name || '''' AS keywords FROM part
""")
def search_keywords(spark, sf):
    line = F.concat(F.lit("keep rows where '"), "p_name", F.lit("' [Function: filter() and sort_by()]"))
    return t(spark, sf, "part").select("p_partkey", R.keywords(line).alias("keywords"))


def _centres(spark, sf, *by):
    points = t(spark, sf, "embeddings").select(*by, F.posexplode("embedding").alias("i", "x"))
    means = points.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    return means.groupBy(*by).agg(vector.alias("v"))


CENTRES = """
WITH p AS (SELECT label, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
 m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1)
"""


@query("nearest_vectors", "N5", CENTRES + """
, s AS (SELECT c.label AS query, vec_id, list_cosine_similarity(c.v, embedding::DOUBLE[]) AS similarity FROM c, embeddings e WHERE e.label <> 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id)::INTEGER AS position FROM s)
SELECT query, vec_id, position, round(similarity, 6) AS similarity FROM r WHERE position <= 10
""")
def nearest_vectors(spark, sf):
    vectors = t(spark, sf, "embeddings").where("label <> 3")
    out = R.nearest(vectors, "vec_id", "embedding", _centres(spark, sf, "label"), "label", "v", 10)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("batch_search", "N6 N3", CENTRES + """
, s AS (SELECT c.label AS query, vec_id, list_cosine_similarity(c.v, embedding::DOUBLE[]) AS similarity FROM c, embeddings),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS position FROM s)
SELECT DISTINCT vec_id FROM r WHERE position <= 3
""")
def batch_search(spark, sf):
    out = R.nearest(t(spark, sf, "embeddings"), "vec_id", "embedding", _centres(spark, sf, "label"), "label", "v", 3)
    return out.select("vec_id").distinct()


@query("vector_similarity", "N7", CENTRES + """
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS own, round(list_cosine_similarity(embedding[1:16]::DOUBLE[], v[1:16]), 6) AS trimmed FROM embeddings JOIN c USING (label)
""")
def vector_similarity(spark, sf):
    joined = t(spark, sf, "embeddings").join(_centres(spark, sf, "label"), "label")
    short = [R.fit_dimension(F.col(c), 16) for c in ("embedding", "v")]
    padded = [R.fit_dimension(c, 20) for c in short]
    return joined.select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("v")), 6).alias("own"),
                         F.round(R.cosine(*padded), 6).alias("trimmed"))


@query("dataset_relevance", "N8", r"""
WITH d AS (SELECT doc_id AS id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1)) AS t, lang AS a, source AS f FROM documents),
 q AS (SELECT item_id AS query, lower(text) AS x, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1)) AS t FROM benchmark),
 s AS (SELECT query, id, len(list_intersect(d.t, q.t)) + 5.0 * contains(x, lower(a))::INT + 3.0 * contains(x, lower(f))::INT + 1.0 * contains(x, id::VARCHAR)::INT AS score FROM d, q)
SELECT query, arg_min(id, (-score, id)) AS best, max(score)::DOUBLE AS score FROM s GROUP BY 1
""")
def dataset_relevance(spark, sf):
    return R.relevance(t(spark, sf, "documents"), "doc_id", "text", "lang", "source", t(spark, sf, "benchmark"), "item_id", "text")
