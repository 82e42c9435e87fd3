"""Modelling on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import modelling as M
from millrace.operators import sampling as S
from millrace.plans.registry import query
from millrace.session import kept
from millrace.session import read_table as t


@query("inferred_tasks", "O1", """
SELECT 'l_extendedprice' AS target, count(DISTINCT l_extendedprice) AS n_unique, 'regression' AS task FROM lineitem
UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus), 'binary_classification' FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), 'multiclass_classification' FROM lineitem
UNION ALL SELECT 'same', 1, 'exploratory_analysis'
""")
def inferred_tasks(spark, sf):
    line = t(spark, sf, "lineitem").withColumn("same", F.lit(1))
    return M.infer_tasks(line, ["l_extendedprice", "l_linestatus", "l_returnflag", "same"])


@query("data_sufficiency", "O2", """
WITH d AS (SELECT quality, n_chars, lang, source FROM documents JOIN labels USING (doc_id)), c AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM d GROUP BY quality))
SELECT count(*) AS n_rows, 150 AS rows_recommended, m AS min_class_count, count(*) >= 150 AND m >= 20 AS sufficient FROM d, c GROUP BY m
""")
def data_sufficiency(spark, sf):
    return M.sufficiency(_labelled(spark, sf).drop("doc_id"), "quality", "binary_classification")


def _labelled(spark, sf):
    joined = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    return joined.select("doc_id", "quality", F.col("n_chars").cast("double").alias("n_chars"), "lang", "source")


@query("feature_contract", "O4", """
WITH f AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents)
SELECT doc_id, round((n_chars - m) / s, 5) AS n_chars_scaled, (lang = 'en')::INT AS lang_is_en, (lang = 'fr')::INT AS lang_is_fr, 0 AS lang_unknown FROM documents, f
""")
def feature_contract(spark, sf):
    docs = t(spark, sf, "documents")
    contract = M.fit_feature_contract(docs, ["n_chars", "lang"])
    out = M.apply_feature_contract(docs, contract, ["doc_id"])
    return out.select("doc_id", F.round("n_chars_scaled", 5).alias("n_chars_scaled"), "lang_is_en", "lang_is_fr", "lang_unknown")


@query("sparse_feature_contract", "O4", """
WITH f AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem WHERE l_linenumber < 4),
 p AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS level FROM (SELECT DISTINCT l_partkey::VARCHAR AS value FROM lineitem WHERE l_linenumber < 4)),
 r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS level FROM (SELECT DISTINCT l_returnflag AS value FROM lineitem WHERE l_linenumber < 4))
SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / s, 5) AS l_extendedprice_scaled, coalesce(p.level, (SELECT count(*) FROM p))::BIGINT AS part_level,
  coalesce(r.level, (SELECT count(*) FROM r))::BIGINT AS l_returnflag_level
FROM lineitem CROSS JOIN f LEFT JOIN p ON p.value = l_partkey::VARCHAR LEFT JOIN r ON r.value = l_returnflag
""")
def sparse_feature_contract(spark, sf):
    lines = t(spark, sf, "lineitem").withColumn("part", F.col("l_partkey").cast("string"))
    contract = M.fit_sparse_contract(lines.where("l_linenumber < 4"), ["l_extendedprice", "part", "l_returnflag"])
    out = M.apply_sparse_contract(lines, contract, ["l_orderkey", "l_linenumber"]).drop("features")
    return out.withColumn("l_extendedprice_scaled", F.round("l_extendedprice_scaled", 5))


def _split(spark, sf):
    rows = S.group_folds(_labelled(spark, sf), "doc_id", 5).drop("doc_id")
    return rows.where("fold <> 0").drop("fold"), rows.where("fold = 0").drop("fold")


@query("candidate_panel", "O3 O5 O6")
def candidate_panel(spark, sf):
    train, test = _split(spark, sf)
    return M.panel_scores(M.train_panel(train, "quality", "binary_classification"), test, "quality", "binary_classification")


def _priced_orders(spark, sf):
    orders = t(spark, sf, "orders").join(t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines")), "o_orderkey")
    return orders.select("o_orderkey", "o_orderdate", "o_totalprice", "quantity", "lines", "o_orderpriority")


def _priced_split(spark, sf):
    orders = kept(_priced_orders(spark, sf), "priced_orders")
    split = kept(S.temporal_holdout(orders, "o_orderdate", ["o_orderkey"]), "priced_split")
    columns = ["o_totalprice", "quantity", "lines", "o_orderpriority"]
    return split.where("is_train").select(*columns), split.where("not is_train").select(*columns)


@query("regression_panel", "O3 O5 O6 F11")
def regression_panel(spark, sf):
    train, test = _priced_split(spark, sf)
    fitted = M.train_panel(train, "o_totalprice", "regression")
    return M.panel_scores(fitted, test, "o_totalprice", "regression")


@query("idle_regression", "O5 O8 F11", """
WITH r AS (SELECT o_totalprice AS y, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(count(*) OVER () * 0.8) AS is_train FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
 m AS (SELECT avg(y) AS m FROM r WHERE is_train), s AS (SELECT avg(abs(y - m)) AS mae, avg((y - m) ** 2) AS mse, var_pop(y) AS v FROM r, m WHERE NOT is_train)
SELECT unnest(['mae', 'rmse', 'r2']) AS metric, unnest([round(mae, 3), round(sqrt(mse), 3), round(1 - mse / v, 5)]) AS value FROM s
""")
def idle_regression(spark, sf):
    out = M.idle_scores(*_priced_split(spark, sf), "o_totalprice", "regression")
    return out.select("metric", F.when(F.col("metric") == "r2", F.round("value", 5)).otherwise(F.round("value", 3)).alias("value"))


@query("panel_choice", "O5 O9")
def panel_choice(spark, sf):
    train, test = _priced_split(spark, sf)
    fitted = M.train_panel(train, "o_totalprice", "regression")
    scores = M.panel_scores(fitted, test, "o_totalprice", "regression")
    return M.panel_choice(scores, M.idle_scores(train, test, "o_totalprice", "regression"), "regression")


@query("regression_metrics", "O7", """
WITH p AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS x FROM lineitem)
SELECT round(avg(abs(x - y)), 4) AS mae, round(sqrt(avg((x - y) ** 2)), 4) AS rmse, round(1 - sum((x - y) ** 2) / (var_pop(y) * count(*)), 5) AS r2 FROM p
""")
def regression_metrics(spark, sf):
    scored = t(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000).alias("prediction"))
    return M.regression_metrics(scored).select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 5).alias("r2"))


@query("classification_metrics", "O6", """
WITH p AS (SELECT (l_returnflag = 'R')::INT AS y, (l_quantity > 25)::INT AS x FROM lineitem),
 c AS (SELECT sum((x = y)::INT) / count(*) AS accuracy, 2.0 * sum((x = 1 AND y = 1)::INT) / (sum(x) + sum(y)) AS f1a, 2.0 * sum((x = 0 AND y = 0)::INT) / (sum(1 - x) + sum(1 - y)) AS f0 FROM p)
SELECT round(accuracy, 6) AS accuracy, round((f1a + f0) / 2, 6) AS f1_macro, round(f1a, 6) AS f1 FROM c
""")
def classification_metrics(spark, sf):
    scored = t(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("double").alias("label"), (F.col("l_quantity") > 25).cast("double").alias("prediction"))
    out = M.classification_metrics(scored)
    return out.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "f1_macro", "f1")])


@query("roc_auc", "O6", """
WITH p AS (SELECT l_linestatus AS part, (l_returnflag = 'R')::INT AS y, l_quantity AS s FROM lineitem), c AS (SELECT part, s, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY 1, 2),
 u AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY part ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT part, CASE WHEN sum(pos) * sum(neg) > 0 THEN round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) END AS roc_auc FROM u GROUP BY part
""")
def roc_auc(spark, sf):
    scored = t(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("part"), (F.col("l_returnflag") == "R").cast("double").alias("label"), F.col("l_quantity").cast("double").alias("score"))
    return M.roc_auc(scored, "score", ["part"]).withColumn("roc_auc", F.round("roc_auc", 6))


@query("class_baselines", "O8", """
WITH c AS (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)
SELECT round(max(n) / sum(n), 6) AS accuracy, round(2 * (max(n) / sum(n)) / (1 + max(n) / sum(n)) / count(*), 6) AS f1_macro FROM c
""")
def class_baselines(spark, sf):
    out = M.baselines(t(spark, sf, "lineitem"), "l_returnflag", "classification")
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("f1_macro", 6).alias("f1_macro"))


@query("mean_baselines", "O8", """
SELECT round(stddev_pop(o_totalprice), 3) AS rmse, round(avg(abs(o_totalprice - (SELECT avg(o_totalprice) FROM orders))), 3) AS mae, 0.0::DOUBLE AS r2 FROM orders
""")
def mean_baselines(spark, sf):
    out = M.baselines(t(spark, sf, "orders"), "o_totalprice", "regression")
    return out.select(F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), "r2")


@query("beats_baseline", "O9", """
WITH p AS (SELECT (('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT) % 5 AS fold, ((l_quantity > 30)::INT = (l_returnflag = 'R')::INT)::INT AS hit FROM lineitem),
 f AS (SELECT avg(hit) AS v FROM p GROUP BY fold), s AS (SELECT avg(v) AS m, stddev_samp(v) AS sd, count(*) AS k FROM f),
 b AS (SELECT max(n) / sum(n) AS base FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag = 'R'))
SELECT round(m, 6) AS mean, round(m - 1.96 * sd / sqrt(k), 6) AS ci_low, round(m + 1.96 * sd / sqrt(k), 6) AS ci_high, round(base, 6) AS baseline, m - 1.96 * sd / sqrt(k) > base AS beats_baseline FROM s, b
""")
def beats_baseline(spark, sf):
    line = S.group_folds(t(spark, sf, "lineitem"), "l_orderkey", 5).withColumn("y", F.col("l_returnflag") == "R")
    hits = line.groupBy("fold").agg(F.lit("accuracy").alias("metric"), F.avg(
        ((F.col("l_quantity") > 30) == F.col("y")).cast("double")).alias("value"))
    out = M.beats_baseline(hits, M.baselines(line, "y", "classification"), "accuracy")
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high", "baseline")], "beats_baseline")


@query("cross_validation", "O10 F13")
def cross_validation(spark, sf):
    return M.cross_validate(_labelled(spark, sf), "quality", "binary_classification", ["doc_id"])[0]


@query("cross_validation_by_time", "O10 F12 F13")
def cross_validation_by_time(spark, sf):
    return M.cross_validate(_priced_orders(spark, sf), "o_totalprice", "regression", ["o_orderkey"], time="o_orderdate")[0]


@query("held_out_classes", "O10 F13", """
WITH d AS (SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
 r AS (SELECT quality, (row_number() OVER (ORDER BY quality, md5(doc_id::VARCHAR), doc_id) - 1) % 5 AS fold, doc_id FROM d)
SELECT fold::INTEGER AS fold, quality::DOUBLE AS label, count(*) AS n, sum(doc_id)::BIGINT AS keys FROM r GROUP BY 1, 2
""")
def held_out_classes(spark, sf):
    _, scored, _ = M.cross_validate(_labelled(spark, sf), "quality", "binary_classification", ["doc_id"])
    return scored.groupBy("fold", "label").agg(F.count("prediction").alias("n"), F.sum("doc_id").alias("keys"))


@query("class_weights", "O11", """
WITH c AS (SELECT l_returnflag AS "class", count(*) AS n FROM lineitem GROUP BY 1)
SELECT "class", n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c
""")
def class_weights(spark, sf):
    return M.class_weights(t(spark, sf, "lineitem"), "l_returnflag").withColumn("weight", F.round("weight", 6))


@query("label_vocabulary", "O12 I8", "SELECT (row_number() OVER (ORDER BY l) - 1)::INTEGER AS position, l AS label FROM (SELECT DISTINCT o_orderpriority AS l FROM orders)")
def label_vocabulary(spark, sf):
    names = M.label_vocabulary(t(spark, sf, "orders"), "o_orderpriority")
    return spark.createDataFrame(list(enumerate(names)), "position int, label string")


@query("perceptron_scores", "O13")
def perceptron_scores(spark, sf):
    from pyspark.ml.functions import array_to_vector

    vectors = t(spark, sf, "embeddings")
    model, _ = M.perceptron(vectors, "embedding", "label")
    rows, _ = M.with_label(vectors.withColumnRenamed("label", "y"), "y", "multiclass_classification")
    ready = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), "label")
    return M.classification_metrics(model.transform(ready))


@query("batch_inference", "O14")
def batch_inference(spark, sf):
    rows = _labelled(spark, sf)
    fitted = M.train_panel(rows.drop("doc_id"), "quality", "binary_classification", only=["logistic_regression"])
    docs = t(spark, sf, "documents").withColumn("n_chars", F.col("n_chars").cast("double"))
    return M.infer(fitted["logistic_regression"], docs, ["doc_id"])


@query("model_verdicts", "O15", """
WITH m AS (SELECT l_suppkey, count(*) AS n, avg(l_discount) AS cv_mean, stddev_samp(l_discount) / 10 AS cv_std, avg(l_discount) + avg(l_tax) AS holdout FROM lineitem GROUP BY 1),
 c AS (SELECT *, n < 600 OR abs(cv_std / cv_mean) > 0.15 OR holdout - cv_mean > 0.1 OR (l_suppkey % 50 + 50) < 60 AS warned, l_suppkey % 11 = 0 OR cv_mean <= 0.0495 AS failed FROM m)
SELECT l_suppkey, CASE WHEN failed THEN 'fail' WHEN warned THEN 'warn' ELSE 'pass' END AS verdict, CASE WHEN failed THEN 1 WHEN warned THEN 2 ELSE 4 END::INTEGER AS max_level FROM c
""")
def model_verdicts(spark, sf):
    rows = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.avg("l_discount").alias("cv_mean"), (F.stddev_samp("l_discount") / 10).alias("cv_std"),
        (F.avg("l_discount") + F.avg("l_tax")).alias("holdout"))
    rows = rows.withColumns({
        "sufficient": F.col("n") >= 600, "n_leaks": (F.col("l_suppkey") % 11 == 0).cast("int"), "beats_baseline": F.col("cv_mean") > 0.0495,
        "quality": F.col("l_suppkey") % 50 + 50, "lower_is_better": F.lit(False)})
    return M.verdicts(rows).select("l_suppkey", "verdict", "max_level")


@query("population_drift", "O16", """
WITH b AS (SELECT o_totalprice AS x FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), c AS (SELECT o_totalprice * 1.2 AS x FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
 e AS (SELECT unnest(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM b),
 be AS (SELECT (SELECT count(*) FROM e WHERE x >= q) AS bin, count(*) / (SELECT count(*) FROM b) AS e FROM b GROUP BY 1), ce AS (SELECT (SELECT count(*) FROM e WHERE x >= q) AS bin, count(*) / (SELECT count(*) FROM c) AS a FROM c GROUP BY 1),
 s AS (SELECT sum((coalesce(a, 1e-6) - coalesce(e, 1e-6)) * ln(coalesce(a, 1e-6) / coalesce(e, 1e-6))) AS psi FROM be FULL JOIN ce USING (bin))
SELECT 'x' AS "column", round(psi, 6) AS psi, CASE WHEN psi > 0.2 THEN 'alert' WHEN psi > 0.1 THEN 'warn' ELSE 'stable' END AS status FROM s
""")
def population_drift(spark, sf):
    orders = t(spark, sf, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    before = orders.where(early).select(F.col("o_totalprice").alias("x"))
    after = orders.where(~early).select((F.col("o_totalprice") * 1.2).alias("x"))
    return M.population_drift(before, after, "x").withColumn("psi", F.round("psi", 6))


@query("economics", "O17", """
WITH s AS (SELECT sum(l_quantity) AS m, sum(l_tax) AS c, sum(l_discount) AS k FROM lineitem), h AS (SELECT m / 60.0 AS hours, greatest(0.25, round(m / 60.0 * 0.09, 2)) AS review, 10 + c + k AS cost FROM s)
SELECT round(hours, 2) AS manual_hours, review AS review_hours, round(cost, 2) AS mission_cost, round(cost + review * 85, 2) AS total_cost, round(hours * 85, 2) AS labor_value, round(hours * 85 / greatest(cost + review * 85, 0.01), 1) AS multiplier FROM h
""")
def economics(spark, sf):
    ledger = t(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("manual_minutes"), F.col("l_tax").alias("compute_cost"), F.col("l_discount").alias("model_cost"))
    return M.economics(ledger, 85.0, 10.0)
