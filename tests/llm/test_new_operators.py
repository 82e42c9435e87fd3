"""Leaks, infilling and whitening against plain Python: nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from millrace.llm import decontaminate, infill, whitening

SCHEMA = "doc_id long, text string, _id string, n long, output string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def phrase(n, seed, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


ITEMS = [
    (1, phrase(25, 1)), (2, "Ñandú, ¿qué?"), (3, phrase(10, 3).upper()), (3, "second text of three"), (4, None), (5, " .!? "), (None, "no id here"),
    (6, phrase(25, 1)), (7, "a a a a a a a a a a a a"), (10, "second text of three")]
TEXTS = [
    None, "", "  ", "…", ITEMS[0][1], f"x {ITEMS[0][1]} y", phrase(5000, 9) + " " + " ".join(ITEMS[0][1].split()[5:17]), phrase(9, 1),
    ITEMS[2][1].lower().replace(" ", "\n--"), "the ÑANDú qué ñandú; Ñandú-qué", "a " * 40, "Second  TEXT of three", "no id here", "aa a a", "<P> marks",
    "\v a b   c ", "é" * 5000 + " ende", "漢字 かな  \t", phrase(300, 5), "tail   "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 0, "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, TEXTS[5], "x", 0, "y")], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected_leaks(text):
    words = WORD.findall(lowered(text))
    hit, found = set(), set()
    for key, item in ITEMS:
        own = WORD.findall(lowered(item))
        for i in range(max(1, len(own) - 9) if own else 0):
            w = own[i : i + 10]
            for at in range(len(words) - len(w) + 1):
                if words[at : at + len(w)] == w:
                    hit.update(range(at, at + len(w)))
                    found.add("" if key is None else str(key))
    places = [m.span() for m in WORD.finditer(lowered(text))]
    runs = []
    for k in sorted(hit):
        if k - 1 in hit:
            runs[-1] = (runs[-1][0], places[k][1])
        else:
            runs.append(places[k])
    return len(words), len(hit), sorted(found), runs


@pytest.mark.parametrize("size", [decontaminate.AUTOMATON_BYTES, 60])
def test_leaks_are_those_of_all_windows(docs, items, size):
    rows = decontaminate.leaked(docs, items, automaton_bytes=size).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[5 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) == expected_leaks(text), r.doc_id


def test_leaks_as_the_query_and_its_sql_give_them(docs, items):
    out = decontaminate.decontaminated_documents(docs.where("doc_id IS NOT NULL"), items)
    con = duckdb.connect()
    con.register("documents", docs.where("doc_id IS NOT NULL").toPandas())
    con.register("benchmark", items.toPandas().astype({"item_id": "Int64"}))
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(decontaminate.SQL).fetchall())


def test_leaks_of_empty_tables(docs, items):
    assert decontaminate.leaked(docs.limit(0), items).collect() == []
    none = decontaminate.leaked(docs, items.limit(0)).collect()
    assert len(none) == len(TEXTS) + 2 and not any(r.n_hit or r["items"] or r.spans for r in none)


def test_long_items_keep_every_window():
    text = phrase(400, 2).encode()
    whole = set(decontaminate.windows(decontaminate.folded(text).split()))
    parts = [set(decontaminate.windows(decontaminate.folded(p).split())) for p in decontaminate._pieces(text, 200)]
    assert len(parts) > 3 and set().union(*parts) == whole


def expected_infill(key, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_infill_cuts_where_units_end_and_restores(spark):
    rows = [(100 * k + i, t, "x", 0, "y") for i, t in enumerate(TEXTS) for k in range(6)] + [(None, TEXTS[18], "x", 0, "y"), (100, TEXTS[0], "x", 0, "y")]
    table = spark.createDataFrame(rows, SCHEMA)
    out = infill.fill_in_middle(table)
    both = out.withColumn("back", infill.restored(out["output"], out["form"])).collect()
    assert sorted((r.doc_id or -1, *expected_infill(r.doc_id, r.text)) for r in both if r.form) == sorted(
        (r.doc_id or -1, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in both)
    assert sorted((r[0] or -1, r[1] or "") for r in rows) == sorted((r.doc_id or -1, r.text) for r in both)
    assert all(r.back == r.text for r in both) and {r.form for r in both} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(table.limit(0)).collect() == []
    con = duckdb.connect()
    con.register("documents", table.where("doc_id IS NOT NULL").toPandas())
    query = infill.infill_documents(table.where("doc_id IS NOT NULL"))
    assert sorted(map(str, map(tuple, query.collect()))) == sorted(map(str, con.execute(infill.SQL).fetchall()))


def test_fenwick_tree_finds_every_unit():
    r = random.Random(4)
    text = "".join(r.choice([" ", "  ", "\n", "é", "a", "bc", "漢"]) for _ in range(3000))
    ends = [m.end() for m in UNIT.finditer(text)]
    for block in (1, 3, 64, 1 << 20):
        units = infill.Units(text.encode(), block)
        assert units.count == len(ends)
        for k in [0, 1, 2, 3, len(ends) // 2, len(ends) - 1, len(ends)]:
            points = ends[k - 1] if k else 0
            assert units.cut(k) == (len(text[:points].encode()), points)


def check_whitening(rows, x, components=32):
    """Rows of the query against a full eigendecomposition of the whole-number vectors ``x`` by id."""
    ids = sorted(x)
    m = np.array([x[i] for i in ids], object)
    n, s = len(m), m.sum(axis=0)
    c = ((m * n - s) / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    k = min(components, c.shape[1])
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    whole = c @ vectors / np.sqrt(values)
    got = np.zeros_like(whole)
    for r in rows:
        got[ids.index(r.vec_id), r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int(((m[ids.index(r.vec_id)] * n - s) ** 2).sum())
        assert abs(r.explained / (values[r.component - 1] / (c * c).sum() * n) - 1) < 1e-9 and r.identity_error < 1e-9
    assert len(rows) == n * k
    assert np.abs(got * np.sign((got * whole).sum(axis=0)) - whole).max() < 1e-7


def scaled(v):
    return [int(np.floor(64 * float(np.float32(e)))) + 1_000_000 for e in v]


def test_whitening_equals_a_full_decomposition(spark):
    rng = np.random.default_rng(3)
    good = {i: (rng.standard_normal(40) * np.linspace(2, 1, 40)).astype(np.float32).tolist() for i in range(300)}
    bad = [(900, None), (901, [None] + [0.0] * 39), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (904, []), (905, [1.0] * 3)]
    table = spark.createDataFrame([(i, v, 1.0) for i, v in [*good.items(), *bad]], "vec_id long, embedding array<float>, whitened double").repartition(5)
    rows = whitening.whitened_embeddings(table).collect()
    check_whitening(rows, {i: scaled(v) for i, v in good.items()})


def test_whitening_with_few_dimensions_ties_and_one_large_component(spark):
    rng = np.random.default_rng(5)
    few = {i: v.tolist() for i, v in enumerate((rng.standard_normal((200, 5)) * 3).astype(np.float32))}
    rows = whitening.whitened_embeddings(spark.createDataFrame(list(few.items()), "vec_id long, embedding array<float>")).collect()
    check_whitening(rows, {i: scaled(v) for i, v in few.items()})
    wide = (rng.standard_normal((400, 80)) * np.concatenate([[30000], np.linspace(3, 1, 79)])).astype(np.float32)
    wide = {i: v.tolist() for i, v in enumerate(wide)}
    rows = whitening.whitened_embeddings(spark.createDataFrame(list(wide.items()), "vec_id long, embedding array<float>")).collect()
    check_whitening(rows, {i: scaled(v) for i, v in wide.items()})


def test_whitening_of_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened_embeddings(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened_embeddings(spark.createDataFrame([(1, None)], schema)).collect() == []
    assert whitening.whitened_embeddings(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)).collect() == []
    line = whitening.whitened_embeddings(spark.createDataFrame([(i // 2, [float(i), 2.0 * i, 5.0]) for i in range(6)] + [(None, [0.0, 0.0, 5.0])], schema)).collect()
    assert len(line) == 7 and {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    huge, model = whitening.whiten(spark.createDataFrame([(i, [3e38 * (-1) ** i, float(i)]) for i in range(4)], schema))
    assert huge.count() == 4 and len(model.values) >= 1


def test_partial_sums_of_many_tasks_are_added_up_by_tasks(spark):
    rng = np.random.default_rng(6)
    rows = {i: v.tolist() for i, v in enumerate(rng.standard_normal((700, 6)).astype(np.float32))}
    table = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>").repartition(70, "vec_id")
    blocks = whitening.scaled_blocks(table)
    data = whitening.counted(blocks)
    data.parts = whitening.PARTIALS + 1  # as with so many tasks
    q = np.eye(6)
    x = np.array([[e - 1_000_000 for e in scaled(v)] for v in rows.values()], float)
    assert np.allclose(data.product(q), np.cov(x.T, bias=True), atol=1e-9)
