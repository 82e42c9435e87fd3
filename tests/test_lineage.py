"""Walks over lineage graphs against a plain search: shapes that need many steps, rings, and the number of rounds."""

import random

import pytest

from millrace.operators import lineage as L

EDGES = "tenant_id string, src string, kind string, dst string"


def plain_search(pairs, starts):
    follow = {}
    for a, b in pairs:
        follow.setdefault(a, []).append(b)
    out = set()
    for root in starts:
        seen, todo = {root}, [root]
        while todo:
            for b in follow.get(todo.pop(), []):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(root, x) for x in seen - {root}}
    return out


def walked(spark, pairs, starts, **kw):
    rows = [("t", a, "derived_from", b) for a, b in pairs] + [("u", pairs[0][0], "derived_from", "elsewhere"), ("t", pairs[0][0], "other", "elsewhere")]
    edges, roots = spark.createDataFrame(rows, EDGES), spark.createDataFrame([(s,) for s in starts], "id string")
    found = [tuple(r) for r in L.ancestors(edges, roots, "t", **kw).collect()]
    assert len(found) == len(set(found))
    return set(found)


def chain(prefix, n):
    return [(f"{prefix}{i}", f"{prefix}{i + 1}") for i in range(n)]


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    cut = L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    pairs = chain("a", 1000)
    assert walked(spark, pairs, ["a0", "a990"], plain_steps=2) == plain_search(pairs, ["a0", "a990"])
    # One for the steps, two walked, three to shorten, seven of three-fold jumps, the rest over the two hops that are left.
    assert len(rounds) <= 20


@pytest.mark.parametrize("plain_steps", [1, 3])
def test_random_graphs_with_rings_and_chains(spark, plain_steps):
    r = random.Random(plain_steps)
    pairs = {(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(45)}  # self-steps and rings among them
    pairs |= set(chain("n3_", 25)) | {("n3", "n3_0"), ("n3_25", "n7")} | set(chain("ring", 6)) | {("ring6", "ring0")}
    pairs |= {("n5", "in0"), ("in4", "in0")} | set(chain("in", 4))
    starts = [f"n{i}" for i in range(0, 40, 3)] + ["n3_4", "absent"]
    assert walked(spark, sorted(pairs), starts, plain_steps=plain_steps) == plain_search(pairs, starts)
    assert walked(spark, sorted(pairs), ["ring2"], plain_steps=plain_steps) == plain_search(pairs, ["ring2"])


def test_ladders_are_walked_by_longer_hops(spark):
    """Two nodes a level, each leading to both of the next: nothing is a chain, so hops are doubled as far as there is room."""
    pairs = [(f"{i}{a}", f"{i + 1}{b}") for i in range(40) for a in "xy" for b in "xy"]
    assert walked(spark, pairs, ["0x", "7y"], plain_steps=2) == plain_search(pairs, ["0x", "7y"])


def test_depth_is_kept(spark):
    assert walked(spark, chain("a", 30), ["a0"], max_depth=20, plain_steps=2) == {("a0", f"a{i}") for i in range(1, 21)}


def test_a_walk_broadcasts_nothing(spark, monkeypatch):
    """A step's joins are small one by one, but each broadcast passes through the driver."""
    plans = []

    def cut_and_note(df, cut=L.cut_lineage):
        done = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return done

    monkeypatch.setattr(L, "cut_lineage", cut_and_note)
    pairs = [*chain("a", 12), *chain("b", 5), ("a3", "b0"), ("b5", "a7")]
    assert walked(spark, pairs, ["a0", "b2"], plain_steps=2) == plain_search(pairs, ["a0", "b2"])
    edges = spark.createDataFrame([("t", "d", "has_column", "c"), ("t", "c", "classified_as", "pii:x"), ("t", "e", "derived_from", "d"), ("t", "m", "trained_on", "e")], EDGES)
    found = L.models_touching_pii(edges, "t")
    assert [tuple(r) for r in found.collect()] == [("m", "x", "d")]
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)
