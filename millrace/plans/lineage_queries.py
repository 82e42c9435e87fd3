"""Lineage queries on a graph derived from the test tables: parts as datasets, customers as models, brands as columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import lineage as L
from millrace.plans.registry import query
from millrace.session import read_table as t

GRAPH = """
WITH RECURSIVE n AS (SELECT 'acme' AS tenant_id, 'd' || p_partkey AS id, 'dataset' AS kind, p_name AS label FROM part
  UNION ALL SELECT 'acme', 'm' || c_custkey, 'model', c_name FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT 'other', 'd' || s_suppkey, 'dataset', s_name FROM supplier),
 e AS (SELECT 'acme' AS tenant_id, 'd' || p_partkey AS src, 'derived_from' AS kind, 'd' || (p_partkey // 2) AS dst FROM part WHERE p_partkey > 0
  UNION ALL SELECT 'acme', 'd' || p_partkey, 'derived_from', 'd' || (p_partkey // 3) FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT 'acme', 'd' || p_partkey, 'has_column', 'col:' || p_brand || '-' || p_size FROM part
  UNION ALL SELECT DISTINCT 'acme', 'col:' || p_brand || '-' || p_size, 'classified_as', CASE WHEN p_size = 7 THEN 'pii:email' ELSE 'pii:phone' END FROM part
    WHERE p_size IN (7, 9) AND p_brand IN ('Brand#3', 'Brand#11')
  UNION ALL SELECT 'acme', 'm' || c_custkey, 'trained_on', 'd' || (c_custkey % 2000) FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT 'acme', 'm' || c_custkey, 'uses_feature', 'col:Brand#3-' || (c_custkey % 50) FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT 'other', 'd' || s_suppkey, 'derived_from', 'd' || (s_suppkey % 10) FROM supplier)
"""


def graph(spark, sf):
    part, customer, supplier = (t(spark, sf, n) for n in ("part", "customer", "supplier"))
    models = customer.where("c_mktsegment = 'BUILDING'")

    def text(prefix, c):
        return F.concat(F.lit(prefix), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))

    def rows(df, tenant, *cols, names):
        return df.select(F.lit(tenant).alias("tenant_id"), *[c.alias(n) for c, n in zip(cols, names, strict=True)])

    node = ("id", "kind", "label")
    nodes = rows(part, "acme", text("d", "p_partkey"), F.lit("dataset"), F.col("p_name"), names=node).unionByName(
        rows(models, "acme", text("m", "c_custkey"), F.lit("model"), F.col("c_name"), names=node)).unionByName(
        rows(supplier, "other", text("d", "s_suppkey"), F.lit("dataset"), F.col("s_name"), names=node))
    edge = ("src", "kind", "dst")
    brand = F.concat(F.lit("col:"), "p_brand", F.lit("-"), F.col("p_size").cast("string"))
    k = F.col("p_partkey")
    personal = part.where("p_size in (7, 9) and p_brand in ('Brand#3', 'Brand#11')")
    parts = [
        rows(part.where("p_partkey > 0"), "acme", text("d", k), F.lit("derived_from"), text("d", F.floor(k / 2)), names=edge),
        rows(part.where("p_partkey % 5 = 0"), "acme", text("d", k), F.lit("derived_from"), text("d", F.floor(k / 3)), names=edge),
        rows(part, "acme", text("d", k), F.lit("has_column"), brand, names=edge),
        rows(personal, "acme", brand, F.lit("classified_as"), F.when(F.col("p_size") == 7, "pii:email").otherwise("pii:phone"), names=edge).distinct(),
        rows(models, "acme", text("m", "c_custkey"), F.lit("trained_on"), text("d", F.col("c_custkey") % 2000), names=edge),
        rows(models, "acme", text("m", "c_custkey"), F.lit("uses_feature"), text("col:Brand#3-", F.col("c_custkey") % 50), names=edge),
        rows(supplier, "other", text("d", "s_suppkey"), F.lit("derived_from"), text("d", F.col("s_suppkey") % 10), names=edge),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return nodes, edges


def walk(start: str, forward: bool) -> str:
    here, there = ("src", "dst") if forward else ("dst", "src")
    return GRAPH + f""", walk AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT e.{there}, walk.depth + 1 FROM e JOIN walk ON e.{here} = walk.id
  WHERE e.tenant_id = 'acme' AND e.kind = 'derived_from' AND walk.depth < 32 AND e.src <> e.dst)
"""


@query("ancestors", "J1", walk("d1990", True) + "SELECT DISTINCT 'd1990' AS root, id FROM walk WHERE id <> 'd1990'")
def ancestors(spark, sf):
    _, edges = graph(spark, sf)
    return L.ancestors(edges, spark.createDataFrame([("d1990",)], "id string"), "acme")


@query("descendants", "J1", walk("d5", False) + "SELECT DISTINCT 'd5' AS root, id FROM walk WHERE id <> 'd5'")
def descendants(spark, sf):
    _, edges = graph(spark, sf)
    return L.descendants(edges, spark.createDataFrame([("d5",)], "id string"), "acme")


@query("all_ancestors", "J1", GRAPH + """
, walk AS (SELECT 'm' || c_custkey AS root, 'd' || (c_custkey % 2000) AS id FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION SELECT walk.root, e.dst FROM e JOIN walk ON e.src = walk.id WHERE e.tenant_id = 'acme' AND e.kind IN ('derived_from', 'trained_on'))
SELECT root, id FROM walk
""")
def all_ancestors(spark, sf):
    nodes, edges = graph(spark, sf)
    models = nodes.where("kind = 'model'").select("id")
    return L.reachable(edges, models, ["derived_from", "trained_on"], True, "acme")


@query("dataset_lineage", "J2", walk("d1985", True) + """
, r AS (SELECT 'dataset' AS relation, 'd1985' AS id UNION SELECT 'parent', dst FROM e WHERE tenant_id = 'acme' AND src = 'd1985' AND kind = 'derived_from'
  UNION SELECT 'ancestor', id FROM walk WHERE id <> 'd1985')
SELECT relation, r.id, label FROM r JOIN n ON n.id = r.id AND n.tenant_id = 'acme'
""")
def dataset_lineage(spark, sf):
    return L.dataset_lineage(*graph(spark, sf), "d1985", "acme")


@query("column_change_impact", "J3", walk("d5", False) + """
, a AS (SELECT DISTINCT id FROM walk)
SELECT 'dataset' AS kind, id FROM a WHERE id <> 'd5' UNION ALL SELECT 'model', src FROM (SELECT src FROM e WHERE tenant_id = 'acme' AND kind = 'uses_feature' AND dst = 'col:Brand#3-4'
  UNION SELECT src FROM e WHERE tenant_id = 'acme' AND kind = 'trained_on' AND dst IN (SELECT id FROM a))
""")
def column_change_impact(spark, sf):
    _, edges = graph(spark, sf)
    return L.column_change_impact(edges, "d5", "col:Brand#3-4", "acme")


@query("models_touching_pii", "J4", GRAPH + """
, h AS (SELECT DISTINCT a.src AS via, split_part(b.dst, ':', 2) AS pii_kind FROM e a JOIN e b ON a.dst = b.src AND b.kind = 'classified_as' AND b.tenant_id = 'acme' WHERE a.kind = 'has_column' AND a.tenant_id = 'acme'),
 down AS (SELECT DISTINCT via, via AS id FROM h UNION SELECT down.via, e.src FROM e JOIN down ON e.dst = down.id WHERE e.tenant_id = 'acme' AND e.kind = 'derived_from')
SELECT DISTINCT e.src AS model, h.pii_kind, h.via FROM e JOIN down ON e.dst = down.id JOIN h ON h.via = down.via WHERE e.tenant_id = 'acme' AND e.kind = 'trained_on'
""")
def models_touching_pii(spark, sf):
    return L.models_touching_pii(graph(spark, sf)[1], "acme")


@query("orphan_datasets", "J5 I10", GRAPH + """
SELECT id FROM n WHERE tenant_id = 'acme' AND kind = 'dataset' AND id NOT IN (SELECT dst FROM e WHERE tenant_id = 'acme' AND kind IN ('derived_from', 'trained_on'))
""")
def orphan_datasets(spark, sf):
    return L.orphans(*graph(spark, sf), "acme")


@query("graph_counts", "J6", GRAPH + """
SELECT 'node' AS what, kind, count(*) AS n FROM n WHERE tenant_id = 'acme' GROUP BY 2 UNION ALL SELECT 'edge', kind, count(*) FROM e WHERE tenant_id = 'acme' GROUP BY 2
""")
def graph_counts(spark, sf):
    return L.graph_counts(*graph(spark, sf), "acme")


@query("node_upsert", "J7", """
SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS label, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS version FROM part
""")
def node_upsert(spark, sf):
    part = t(spark, sf, "part")
    current = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit(1).alias("version"))
    incoming = part.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("label"), F.lit(2).alias("version"))
    once = L.upsert(current, incoming, ["id"], "version")
    return L.upsert(once, incoming, ["id"], "version")
