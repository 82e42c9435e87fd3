"""The ways taken for large or skewed groups give the rows the plain ways give."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import grid as G
from millrace.operators import joins as J
from millrace.operators import profile as P
from millrace.operators import sampling as S
from millrace.operators import windows as W


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows; values repeat heavily."""
    rnd = random.Random(7)
    rows = [(i, "hot" if i % 3 else f"k{i % 11}", rnd.choice([1.0, 2.0, 2.0, 5.5, None, float(i)]), i % 50) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, k string, v double, o int")


def both(make, order):
    plain = [tuple(r) for r in make(None).orderBy(order).collect()]
    split = [tuple(r) for r in make(0).select(make(None).columns).orderBy(order).collect()]
    return plain, split


@pytest.mark.parametrize("make", [
    lambda d, s: W.running_total(d, F.coalesce("v", F.lit(0.0)).cast("decimal(12,2)"), "t", ["o", "id"], ["k"], split_above=s),
    lambda d, s: W.running_total(d, F.lit(1), "t", ["o", "id"], split_above=s),
    lambda d, s: W.running_min(d, "v", "t", ["o", "id"], ["k"], split_above=s),
    lambda d, s: W.fill_along(d, "v", ["o", "id"], ["k"], split_above=s),
    lambda d, s: W.fill_along(d, "v", ["o", "id"], ["k"], backward=True, split_above=s),
    lambda d, s: W.shifted(d, "v", "t", ["o", "id"], ["k"], 2, split_above=s),
    lambda d, s: W.shifted(d, "v", "t", ["o", "id"], ["k"], -1, split_above=s),
])
def test_sliced_windows(skewed, make):
    plain, split = both(lambda s: make(skewed, s), "id")
    assert plain == split


def test_percentiles(skewed):
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    plain = {r["k"]: r.asDict() for r in W.percentiles(skewed, "v", probs, ["k"]).collect()}
    split = {r["k"]: r.asDict() for r in W.percentiles(skewed, "v", probs, ["k"], split_above=0).collect()}
    assert plain.keys() == split.keys()
    for k in plain:
        assert plain[k] == {n: pytest.approx(x) for n, x in split[k].items() if n != "k"} | {"k": k}


def test_quantiles_of_whole_columns(spark, skewed):
    wide = skewed.withColumn("w", F.when(F.col("id") % 500 == 0, F.lit(1e12)).otherwise(F.col("id") * 1e-6))
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = W.quantiles(wide, ["v", "w", "o"], probs)
    for c in ("v", "w", "o"):
        want = wide.agg(F.percentile(c, F.array(*map(F.lit, probs))).alias("p")).first()["p"]
        assert got[c] == pytest.approx(want, rel=1e-12)


def test_quotas_are_met_exactly(skewed):
    kept = S.capped_strata(skewed, "k", 100, ["id"])
    sizes = {r["k"]: r["count"] for r in skewed.groupBy("k").count().collect()}
    got = {r["k"]: (r["n"], r["w"]) for r in kept.groupBy("k").agg(F.count("*").alias("n"), F.sum("_weight").alias("w")).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: min(100, n) for k, n in sizes.items()}
    assert all(w == pytest.approx(sizes[k]) for k, (_, w) in got.items())


def test_rank_buckets_split(skewed):
    plain, split = both(lambda s: S.rank_buckets(skewed.select("id", "o"), ["o", "id"], 7, "b", split_above=s), "id")
    assert plain == split


def test_duplicates_tell_nulls_apart(spark):
    rows = spark.createDataFrame([(None, "a"), ("a", None), (None, "a"), ("", "a")], "x string, y string")
    assert P.duplicate_rows(rows).first()["duplicates"] == 1


def test_cosine_parts_do_not_change_pairs(spark, skewed):
    rows = skewed.select("k", (F.col("id") % 40).alias("i"))
    one = {tuple(r) for r in J.cosine_pairs(rows, "k", "i").collect()}
    many = {tuple(r) for r in J.cosine_pairs(rows, "k", "i", parts=5).collect()}
    assert one == many and one


@pytest.mark.parametrize("at_least", [2, 3, 6])
def test_pairs_from_the_smallest_baskets_are_all_pairs(spark, at_least):
    r = random.Random(at_least)
    rows = [(f"k{r.randrange(60)}", f"i{r.randrange(80)}") for _ in range(1500)] + [("all", f"i{j}") for j in range(80)] + [(None, "i1"), ("k1", None)]
    table = spark.createDataFrame(rows, "k string, i string")
    plain = sorted(tuple(x) for x in J.cosine_pairs(table, "k", "i", at_least, by_prefix=False).collect())
    assert plain and plain == sorted(tuple(x) for x in J.cosine_pairs(table, "k", "i", at_least, parts=3, by_prefix=True).collect())


def test_a_basket_of_everything_forms_no_pairs(spark):
    """10,000 items in one basket would be 50 million pairs; each has one other basket, so only those form pairs."""
    rows = [("all", i) for i in range(10_000)] + [(f"k{i // 3}", i) for i in range(10_000)]
    table = spark.createDataFrame(rows, "k string, i long")
    counted = table.join(table.groupBy("i").agg(F.count("*").alias("n")), "i")
    assert J._cheaper(J._smallest_baskets(counted, 2), counted)
    found = {(x["a"], x["b"]): (x["together"], x["similarity"]) for x in J.cosine_pairs(table, "k", "i", 2).collect()}
    assert found == {(i, j): (2, 1.0) for i in range(10_000) for j in range(i + 1, min(10_000, i - i % 3 + 3))}


def test_cut_prefixes_are_refined(spark, skewed):
    """Cells of at most three rows need several prefixes; repeated keys share a digest."""
    twice = skewed.unionByName(skewed.where("id < 40"))
    quotas = skewed.groupBy("k").agg((F.count("*") / 3).cast("bigint").alias("_quota"))
    columns = twice.columns
    plain, fine = (sorted(S.take_by_digest(twice, ["k"], quotas, ["id"], n).select("id", "k").collect()) for n in (10**9, 1))
    assert plain == fine and S.take_by_digest(twice, ["k"], quotas, ["id"], 1).columns == columns
    assert {r["k"]: r["_quota"] for r in quotas.collect()} == {k: sum(x["k"] == k for x in fine) for k in {x["k"] for x in fine}}


def test_tolerance_against_brute_force(spark):
    rnd = random.Random(3)
    xs = [rnd.uniform(-300, 300) for _ in range(400)] + [0.0, 0.004, -0.004, 1.0, 1.005]
    ks = [rnd.uniform(-300, 300) for _ in range(60)] + [0.0, 1.0]
    got = {r["x"] for r in J.within_tolerance(spark.createDataFrame([(x,) for x in xs], "x double"), "x",
                                              spark.createDataFrame([(k,) for k in ks], "k double"), "k").collect()}
    assert got == {x for x in xs if any(abs(x - k) <= max(0.01, abs(k) * 0.01) for k in ks)}


def test_pairs_are_refused_when_too_many(spark):
    with pytest.raises(ValueError):
        J.every_pair(spark.range(2000), spark.range(2000).withColumnRenamed("id", "j"))


def sheet(spark, rows):
    cells = [("f", "s", r, c, str(v)) for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None]
    return spark.createDataFrame(cells, "file string, sheet string, row int, col int, text string")


def test_subtotals_need_a_grand_total(spark):
    good = sheet(spark, [["a", 1], ["b", 2], ["North total", 3], ["c", 4], ["d", 5], ["South total", 9], ["Grand total", 12]])
    assert {(r["row"], r["kind"]) for r in G.total_rows(good).collect()} == {(2, "subtotal"), (5, "subtotal"), (6, "total")}
    bad = sheet(spark, [["a", 1], ["b", 2], ["North total", 3], ["c", 4], ["d", 5], ["South total", 9], ["Grand total", 99]])
    assert G.total_rows(bad).count() == 0


def test_key_value_sheets_have_no_header(spark):
    assert G.header_rows(sheet(spark, [["Rate", 0.5], ["Years", 12], ["Cap", 900]])).count() == 0
    assert G.header_rows(sheet(spark, [["Region", 2021, 2022], ["Aberdeen", 310000, 331500]])).count() == 1
    assert G.header_rows(sheet(spark, [["Acme", 1999, 2004], ["Bolt", 2001, 2010]])).count() == 0


def test_quantiles_by_sketch_and_one_count_are_exact(spark):
    import random
    import statistics

    from millrace.operators import windows as W
    from millrace.operators.profile import profile

    r = random.Random(2)
    special = [float("nan"), float("inf"), float("-inf"), None]
    rows = [(r.gauss(0, 1), int(r.expovariate(0.01)), r.choice([1.5, 2.5, 2.5]), r.choice(special) if i % 7 == 0 else r.random(), 1e300 * r.random(), float(i % 3 * 0.1)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e double, f float")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    passes = []
    counting = W.counting
    W.counting = lambda *x: (lambda count: lambda keys: passes.append(len(keys)) or count(keys))(counting(*x))
    try:
        found = W.quantiles(df, df.columns, probs)
    finally:
        W.counting = counting
    assert len(passes) <= 3
    f32 = [x[0] for x in df.select(df.f.cast("double")).collect()]
    for i, c in enumerate(df.columns):
        values = sorted(f32 if c == "f" else [x[i] for x in rows if x[i] is not None and x[i] == x[i]])
        for p, got in zip(probs, found[c], strict=True):
            at = (len(values) - 1) * p
            lo, hi = values[int(at)], values[min(int(at) + (at > int(at)), len(values) - 1)]
            assert got == lo + (hi - lo) * (at - int(at)) or (got != got) == (lo + (hi - lo) * (at - int(at)) != lo + (hi - lo) * (at - int(at)))
    facts = {x["name"]: x for x in profile(df).collect()}
    for c in "abcf":  # e has whole and different values only: an id
        q1, q3 = found[c][2], found[c][4]
        v = f32 if c == "f" else [x["abcdef".index(c)] for x in rows]
        assert (facts[c]["p25"], facts[c]["p75"]) == (q1, q3) and facts[c]["n_unique"] == len(set(v))
        assert facts[c]["n_outliers"] == sum(x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1) for x in v)
    assert abs(facts["a"]["mean"] - statistics.mean(x[0] for x in rows)) < 1e-5


GROUPED = [["North", "Leeds", 100], ["North", "York", 200], ["North subtotal", None, 300], ["South", "Bath", 300], ["South", "Hull", 400], ["South subtotal", None, 700]]


@pytest.mark.parametrize("rows,found,kept", [
    (GROUPED + [["Grand Total", None, 1234]], [], [2, 5, 6]),
    (GROUPED, [], [2, 5]),
    ([["North", "Sales", 100], ["North", "Total Quality Management", 200], ["North subtotal", None, 300], ["South", "Sales", 300], ["South", "Ops", 400],
      ["South subtotal", None, 700], ["Grand Total", None, 1000]], [(2, "subtotal"), (5, "subtotal"), (6, "total")], [1]),
    (GROUPED[:5] + [["Grand Total", None, 1000]], [(2, "subtotal"), (5, "total")], []),
    ([["Sales", 100, 90], ["Services", 50, 40], ["Total revenue", 150, 130], ["Rent", 40, 35], ["Wages", 60, 55], ["Total costs", 100, 90], ["Net income", 50, 40]], [], [2, 5]),
    ([["a", "x", 5], ["a total", None, 5], ["a total", None, 5], ["Total", None, 10]], [(1, "subtotal"), (3, "total")], [2]),
    ([[f"Total sales {i}", None, i * 3 + 1] for i in range(40)], [], []),
])
def test_totals_over_groups(spark, rows, found, kept):
    body = sheet(spark, rows)
    totals = G.total_rows(body)
    assert sorted((r["row"], r["kind"]) for r in totals.collect()) == found
    assert sorted(r["row"] for r in G.labelled_rows_kept(body, totals).collect()) == kept


def test_pairs_are_counted_in_as_many_tasks_as_they_need(spark, monkeypatch):
    rnd = random.Random(3)
    rows = {(k, rnd.randrange(12)) for k in range(60) for _ in range(3)}
    baskets = {}
    for k, i in rows:
        baskets.setdefault(k, set()).add(i)
    want = {}
    for items in baskets.values():
        for a in items:
            for b in items:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    monkeypatch.setattr(J, "PAIRS_PER_TASK", sum(want.values()) // 7)
    found = J.cosine_pairs(spark.createDataFrame(sorted(rows), "k int, i int"), "k", "i", at_least=2)
    assert {(r["a"], r["b"]): r["together"] for r in found.collect()} == {k: n for k, n in want.items() if n > 1}
    assert found.rdd.getNumPartitions() in (7, 8)


def test_many_files_grow_with_the_table(spark, tmp_path, monkeypatch):
    from millrace.plans import source_queries as Q

    spark.range(1000).selectExpr("id div 4 AS l_orderkey", "1.5D AS l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = []
    monkeypatch.setattr(Q, "_written", lambda s, df, *a, written=Q._written: parts.append(df.rdd.getNumPartitions()) or written(s, df, *a))
    monkeypatch.setattr(Q, "ROWS_PER_FILE", 90)
    assert [tuple(r) for r in Q.read_parquet_folder(spark, str(tmp_path)).collect()] == [(1000, 250, 1500.0)] and parts == [12]


def test_figures_of_one_file_are_read_by_all_cores(spark, tmp_path, monkeypatch):
    from millrace.operators import claims as C

    texts = ["Up 1,234.5 to −$3.25 million or 12 %.", "Of 7 in 2021, 5 percent; 2.50bn and 40 percent.", None, "Ünlü: 3 000,5 £12k x9 8.125", ""]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id int, position int, claim string").coalesce(1).write.parquet(str(tmp_path / "c"))
    claims = spark.read.parquet(str(tmp_path / "c"))
    found = {(r["id"], r["raw"].strip(), r["value"], r["is_percent"], r["decimals"], r["is_scaled"]) for r in C.stated_numbers(claims, "id").collect()}
    assert found == {
        (0, "1,234.5", 1234.5, False, 1, False), (0, "-3.25 million", -3.25e6, False, 2, True), (0, "12 %", 12.0, True, 0, False),
        (1, "7", 7.0, False, 0, False), (1, "2021", 2021.0, False, 0, False), (1, "5 percent", 5.0, True, 0, False),
        (1, "2.50bn", 2.5e9, False, 2, True), (1, "40 percent", 40.0, True, 0, False),
        (3, "3", 3.0, False, 0, False), (3, "000", 0.0, False, 0, False), (3, "5", 5.0, False, 0, False), (3, "12k", 12e3, False, 0, True), (3, "8.125", 8.125, False, 3, False)}
    parts = []
    monkeypatch.setattr(C, "cut_lineage", lambda df, cut=C.cut_lineage: parts.append(df.rdd.getNumPartitions()) or cut(df))
    left = C.invented_numbers(claims, "id", spark.createDataFrame([(12.0,), (0.05,), (40.0,)], "k double"), "k")
    assert sorted((r["id"], r["value"]) for r in left.collect())[:2] == [(0, -3.25e6), (0, 1234.5)]
    assert parts == [spark.sparkContext.defaultParallelism]
