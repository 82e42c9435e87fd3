"""Lineage graph queries over two tables: nodes(tenant_id, id, kind, label) and edges(tenant_id, src, kind, dst)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.privacy import hmac_sha256
from millrace.session import cut_lineage

#: Steps walked one by one before the graph is shortened: most lineage ends earlier.
PLAIN_STEPS = 16
#: Times the edges of the shortened graph that its longer hops may grow to.
HOPS_GROWTH = 8


def reachable(
    edges: DataFrame, starts: DataFrame, kinds: Sequence[str], forward: bool, tenant: str, max_depth: int | None = None,
    plain_steps: int = PLAIN_STEPS,
) -> DataFrame:
    """(root, id): everything within ``max_depth`` steps of each start id, the start itself left out.

    Frontier joins: each step follows edges from newly found pairs only and drops pairs seen before, so a cycle ends
    the walk. The tenant test is on every step. The step table and every frontier are checkpointed, so a lost
    executor replays one step and what has been seen is a union of finished frontiers. A walk without ``max_depth`` that is
    still open after ``plain_steps`` goes on over the shortened graph (``_shortened``), whose hops double in length each
    round while their number stays within ``HOPS_GROWTH`` times its edges.
    """
    here, there = ("src", "dst") if forward else ("dst", "src")
    steps = edges.where((F.col("tenant_id") == tenant) & F.col("kind").isin(*kinds) & (F.col("src") != F.col("dst"))).select(
        F.col(here).alias("id"), F.col(there).alias("next")).distinct()
    steps = cut_lineage(steps)
    frontier = starts.select(F.col("id").alias("root"), "id").distinct()
    seen = frontier
    depth = 0
    while depth < (plain_steps if max_depth is None else max_depth):
        depth += 1
        frontier = _next_pairs(frontier, steps, seen)
        if frontier.isEmpty():
            return seen.where("root <> id")
        seen = seen.unionByName(frontier)
    if max_depth is not None:
        return seen.where("root <> id")

    hops, inside = _shortened(steps, frontier.select("id").distinct())
    room = HOPS_GROWTH * hops.count()
    ends = frontier
    while True:
        frontier = _next_pairs(frontier, hops, seen.unionByName(ends))
        if frontier.isEmpty():
            break
        ends = ends.unionByName(frontier)
        hops, room = _longer(hops, room)
    # A node inside a chain is reached by whoever reaches the node that the chain hangs on.
    within = _dealt(ends, inside.withColumnRenamed("id", "on"), ends["id"] == F.col("on")).select("root", F.col("next").alias("id"))
    beyond = _dealt(ends.unionByName(within), seen, ["root", "id"], "left_anti")
    return seen.unionByName(beyond).where("root <> id")


def _next_pairs(frontier: DataFrame, steps: DataFrame, seen: DataFrame) -> DataFrame:
    found = _dealt(frontier, steps, "id").select("root", F.col("next").alias("id")).distinct()
    return cut_lineage(_dealt(found, seen, ["root", "id"], "left_anti"))


def _dealt(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that is always shuffled: a walk makes several a step, and each small enough to be broadcast would pass through
    the driver, all of them together many times the graph."""
    return left.hint("shuffle_merge").join(right.hint("shuffle_merge"), on, how)


def _shortened(steps: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The step graph with its chains taken out: (id, next) between the nodes that stay, and (id, next) from each node that
    stays to all nodes inside the chains that hang on it.

    Inside a chain are nodes with one step in and one out that are no start. Each points to its predecessor; a round lets every
    pointer that still ends inside a chain take three times as many steps, so rounds grow with the logarithm of the longest
    chain and each moves one row per open node. Pointers of distinct open nodes differ, so no key is hot. A closed ring
    of such nodes never comes to an end: no start reaches it, and it is left out once a round closes nothing more.
    """
    ins = steps.groupBy(F.col("next").alias("node")).agg(F.count("*").alias("ins"), F.min("id").alias("to"))
    outs = steps.groupBy(F.col("id").alias("node")).agg(F.count("*").alias("outs"))
    single = _dealt(_dealt(ins.where("ins = 1"), outs.where("outs = 1"), "node"), starts.select(F.col("id").alias("node")), "node", "left_anti")
    single = cut_lineage(single.select("node", "to"))
    names = single.select(F.col("node").alias("_to"), F.lit(True).alias("open"))
    pointers = cut_lineage(_dealt(single, names, F.col("to") == F.col("_to"), "left").select("node", "to", F.coalesce("open", F.lit(False)).alias("open")))
    closed, pending, left = pointers.where("not open"), pointers.where("open"), pointers.where("open").count()
    while left:
        one, two = (closed.unionByName(pending).select(F.col("node").alias(f"_n{i}"), F.col("to").alias(f"_t{i}"), F.col("open").alias(f"_o{i}")) for i in (1, 2))
        jumped = _dealt(_dealt(pending, one, F.col("to") == F.col("_n1")), two, F.col("_o1") & (F.col("_t1") == F.col("_n2")), "left")
        moved = cut_lineage(jumped.select("node", F.coalesce("_t2", "_t1").alias("to"), F.coalesce("_o2", "_o1").alias("open")))
        closed, pending, before = closed.unionByName(moved.where("not open")), moved.where("open"), left
        left = pending.count()
        if left == before:
            break
    anchors = closed.select("to", "node")
    stays = _dealt(steps, single.select(F.col("node").alias("next")), "next", "left_anti")
    between = _dealt(stays, anchors, F.col("id") == F.col("node"), "left").select(F.coalesce("to", "id").alias("id"), "next").where("id <> next").distinct()
    return cut_lineage(between), anchors.select(F.col("to").alias("id"), F.col("node").alias("next"))


def _longer(hops: DataFrame, room: int) -> tuple[DataFrame, int]:
    """Hops of up to twice the length, or the same and no room where the joined rows would be more than ``room``."""
    if not room:
        return hops, 0
    into = hops.groupBy(F.col("next").alias("node")).agg(F.count("*").alias("ins"))
    out = hops.groupBy(F.col("id").alias("node")).agg(F.count("*").alias("outs"))
    if (_dealt(into, out, "node").agg(F.sum(F.col("ins") * F.col("outs"))).first()[0] or 0) > room:
        return hops, 0
    second = hops.select(F.col("id").alias("next"), F.col("next").alias("_far"))
    twice = _dealt(hops, second, "next").select("id", F.col("_far").alias("next")).where("id <> next")
    return cut_lineage(hops.unionByName(twice).distinct()), room


def ancestors(edges: DataFrame, starts: DataFrame, tenant: str, **kw) -> DataFrame:
    return reachable(edges, starts, ["derived_from"], True, tenant, **kw)


def descendants(edges: DataFrame, starts: DataFrame, tenant: str, **kw) -> DataFrame:
    return reachable(edges, starts, ["derived_from"], False, tenant, **kw)


def column_id(key: bytes, dataset: str, column: str):
    """Keyed id of a column, so the graph holds no plain names."""
    return F.concat(F.lit("column:"), F.substring(hmac_sha256(key, F.lit(f"{dataset}\0{column}")), 1, 32))


def dataset_lineage(nodes: DataFrame, edges: DataFrame, dataset: str, tenant: str) -> DataFrame:
    """(relation, id, label): the dataset, its direct parents and all ancestors."""
    spark = nodes.sparkSession
    start = spark.createDataFrame([(dataset,)], "id string")
    parents = edges.where((F.col("tenant_id") == tenant) & (F.col("src") == dataset) & (F.col("kind") == "derived_from"))
    rows = start.select(F.lit("dataset").alias("relation"), "id").unionByName(
        parents.select(F.lit("parent").alias("relation"), F.col("dst").alias("id")).distinct()).unionByName(
        ancestors(edges, start, tenant).select(F.lit("ancestor").alias("relation"), "id"))
    labels = nodes.where(F.col("tenant_id") == tenant).select("id", "label")
    return _dealt(rows, labels, "id").select("relation", "id", "label")


def column_change_impact(edges: DataFrame, dataset: str, column: str, tenant: str) -> DataFrame:
    """(kind, id): downstream datasets, and models that use the column or were trained on an affected dataset."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(dataset,)], "id string")
    down = descendants(edges, start, tenant).select("id")
    mine = edges.where(F.col("tenant_id") == tenant)
    users = mine.where((F.col("kind") == "uses_feature") & (F.col("dst") == column)).select(F.col("src").alias("id"))
    affected = down.unionByName(start)
    trained = _dealt(mine.where("kind = 'trained_on'"), affected.withColumnRenamed("id", "dst"), "dst", "left_semi").select(
        F.col("src").alias("id"))
    models = users.union(trained).distinct()
    return down.select(F.lit("dataset").alias("kind"), "id").unionByName(models.select(F.lit("model").alias("kind"), "id"))


def models_touching_pii(edges: DataFrame, tenant: str) -> DataFrame:
    """(model, pii_kind, via): personal data anywhere in the ancestry of what a model was trained on.

    The walk starts at the datasets that hold classified columns and goes down, so clean parts of the graph are never
    visited and no model needs a walk of its own.
    """
    mine = edges.where(F.col("tenant_id") == tenant)
    has = mine.where("kind = 'has_column'").select(F.col("src").alias("via"), F.col("dst").alias("column"))
    classified = mine.where("kind = 'classified_as'").select(
        F.col("src").alias("column"), F.element_at(F.split("dst", ":", 2), -1).alias("pii_kind"))
    holders = _dealt(has, classified, "column").select("via", "pii_kind").distinct()
    starts = holders.select(F.col("via").alias("id")).distinct()
    reach = descendants(edges, starts, tenant).select(F.col("root").alias("via"), "id").unionByName(
        starts.select(F.col("id").alias("via"), "id"))
    trained = mine.where("kind = 'trained_on'").select(F.col("src").alias("model"), F.col("dst").alias("id"))
    return _dealt(_dealt(trained, reach, "id"), holders, "via").select("model", "pii_kind", "via").distinct()


def orphans(nodes: DataFrame, edges: DataFrame, tenant: str) -> DataFrame:
    """Datasets nothing was derived from or trained on."""
    used = edges.where((F.col("tenant_id") == tenant) & F.col("kind").isin("derived_from", "trained_on")).select(
        F.col("dst").alias("id"))
    mine = nodes.where((F.col("tenant_id") == tenant) & (F.col("kind") == "dataset"))
    return mine.join(used, "id", "left_anti").select("id")


def graph_counts(nodes: DataFrame, edges: DataFrame, tenant: str) -> DataFrame:
    """(what, kind, n) for nodes and edges."""
    parts = [f.where(F.col("tenant_id") == tenant).groupBy("kind").agg(F.count("*").alias("n")).select(
        F.lit(w).alias("what"), "kind", "n") for w, f in (("node", nodes), ("edge", edges))]
    return parts[0].unionByName(parts[1])


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Latest row per key by ``version``; running it again with the same rows changes nothing."""
    both = current.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    order = F.struct(F.col(version), F.xxhash64(*both.columns))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
