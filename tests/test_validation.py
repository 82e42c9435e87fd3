"""Folds, held-out scores and the choice of a model, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import modelling as M
from millrace.operators import sampling as S


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    data = [(i, "a" if r.random() < 0.7 else r.choice(["b", None]), i % 13, None if i == 5 else 1000 - i, r.random()) for i in range(203)]
    return spark.createDataFrame(data, "id int, label string, who int, day int, x double")


def test_the_splitter_follows_from_the_rows(rows):
    assert S.choose_splitter("regression", 5, True) == "TimeSeriesSplit" and S.choose_splitter("binary_classification", 1) == "StratifiedKFold"
    named = {S.assign_folds(rows, *a, **k)[1] for a, k in (
        (("regression", 4, ["id"], "x"), {}), (("multiclass_classification", 4, ["id"], "label"), {}),
        (("regression", 4, ["id"], "x"), {"entity": "who"}), (("regression", 4, ["id"], "x"), {"entity": "who", "time": "day"}))}
    assert named == {"KFold", "StratifiedKFold", "GroupKFold", "TimeSeriesSplit"}


def test_fold_sizes(rows):
    plain = [r["count"] for r in S.plain_folds(rows, ["id"], 4).groupBy("fold").count().orderBy("fold").collect()]
    assert plain == [51, 51, 51, 50]
    per = S.stratified_folds(rows, "label", ["id"], 4).groupBy("label", "fold").count().collect()
    for label in ("a", "b", None):
        counts = [r["count"] for r in per if r["label"] == label]
        assert len(counts) == 4 and max(counts) - min(counts) <= 1
    sizes = [sum(r["count"] for r in per if r["fold"] == f) for f in range(4)]
    assert sum(sizes) == 203 and max(sizes) - min(sizes) <= 1
    whole = S.group_folds(rows, "who", 4).groupBy("who").agg(F.countDistinct("fold").alias("n"))
    assert {r["n"] for r in whole.collect()} == {1}


def test_expanding_folds_train_on_the_past_only(spark, rows):
    placed = [(r.day, r.fold) for r in S.expanding_folds(rows, "day", ["id"], 5).collect()]
    in_time = [f for _, f in sorted(placed, key=lambda p: (p[0] is None, p[0] or 0))]
    assert in_time == sorted(in_time) and in_time.count(-1) == 203 - 5 * (203 // 6) and {in_time.count(f) for f in range(5)} == {203 // 6}
    two = S.expanding_folds(rows.limit(2), "day", ["id"])
    assert {r.fold for r in two.collect()} == {-1}
    small = spark.range(1, 9).select(S.expanding_sizes(F.col("id"), 5).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in small[:2]] == [(None,) * 4] * 2 and tuple(small[2]) == (2, 1, 2, 1) and tuple(small[7]) == (5, 1, 7, 1)


def test_area_under_the_curve_and_f1(spark):
    r = random.Random(9)
    data = [(g, float(r.random() < 0.4), round(r.random(), 1)) for g in "xy" for _ in range(150)] + [("z", 1.0, 0.5)]
    table = spark.createDataFrame(data, "g string, label double, score double")
    got = {row.g: row.roc_auc for row in M.roc_auc(table, "score", ["g"]).collect()}
    for g in "xy":
        pos, neg = ([s for k, y, s in data if k == g and y == want] for want in (1.0, 0.0))
        expected = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        assert abs(got[g] - expected) < 1e-12
    assert got["z"] is None
    said = table.withColumn("prediction", (table.score > 0.5).cast("double"))
    out = {row.g: row for row in M.classification_metrics(said, ["g"]).collect()}
    for g in "xy":
        hit = sum(y == (s > 0.5) for k, y, s in data if k == g) / 150
        tp = sum(y == 1 and s > 0.5 for k, y, s in data if k == g)
        f1 = 2 * tp / (sum(y for k, y, _ in data if k == g) + sum(s > 0.5 for k, _, s in data if k == g))
        assert abs(out[g].accuracy - hit) < 1e-12 and abs(out[g].f1 - f1) < 1e-12


def test_every_row_is_scored_once_by_a_model_that_did_not_see_it(spark):
    r = random.Random(1)
    # A level that occurs in one row only: a model that had seen it would know its label.
    data = [(i, f"v{i}" if i % 2 else "common", r.gauss(0, 1) + (i % 3 == 0) * 3, float(i % 3 == 0), i) for i in range(150)]
    table = spark.createDataFrame(data, "id int, level string, x double, y double, day int")
    scores, scored, splitter = M.cross_validate(table, "y", "binary_classification", ["id"], 3)
    assert splitter == "StratifiedKFold" and sorted(row.id for row in scored.collect()) == list(range(150))
    auc = [row.value for row in scores.where("metric = 'roc_auc'").collect()]
    assert len(auc) == 3 and all(0.8 < v <= 1 for v in auc)
    _, timed, splitter = M.cross_validate(table, "y", "binary_classification", ["id"], 3, time="day")
    assert splitter == "TimeSeriesSplit" and min(row.id for row in timed.collect()) == 150 - 3 * (150 // 4)


def test_the_winner_and_the_model_that_does_no_work(spark):
    train = spark.createDataFrame([("a", 1.0)] * 3 + [("b", 2.0)] * 3, "c string, v double")
    test = spark.createDataFrame([("a", 1.0), ("b", 4.0), ("b", 4.0)], "c string, v double")
    idle = {row.metric: row.value for row in M.idle_scores(train, test, "c", "binary_classification").collect()}
    assert abs(idle["accuracy"] - 1 / 3) < 1e-12 and idle["f1"] == 0.0 and idle["roc_auc"] == 0.5
    flat = {row.metric: row.value for row in M.idle_scores(train, test, "v", "regression").collect()}
    assert flat["mae"] == round((0.5 + 2.5 + 2.5) / 3, 6) and flat["r2"] < 0
    scores = spark.createDataFrame([("m2", "r2", 0.5), ("m1", "r2", 0.5), ("m3", "r2", -3.0), ("m1", "rmse", 1.0)], "model string, metric string, value double")
    base = spark.createDataFrame([("r2", 0.0)], "metric string, value double")
    out = M.panel_choice(scores, base, "regression").collect()
    assert [(o.model, o.winner, o.beats_baseline) for o in out] == [("m1", True, True), ("m2", False, True), ("m3", False, False)]


def test_leaks_are_found_at_any_number_of_levels(spark):
    from millrace.operators.integrity import integrity_report, target_leakage

    r = random.Random(7)
    rows = []
    for i in range(2400):
        k = i % 600
        rows.append((k, f"{k:05d}", f"z{k * 7919 % 1009}", f"id{i}", f"n{r.randrange(300)}", f"label {k:04d}", f"label {k:04d}" if i % 3 else None))
    df = spark.createDataFrame(rows, "y int, ordered string, mixed string, own string, noise string, name string, part string")
    got = {x["column"]: (x.method, x.correlation) for x in target_leakage(df, "y", df.columns[1:]).collect()}
    assert got == {"ordered": ("near_perfect_correlation", 1.0), "mixed": ("near_perfect_association", 1.0),
                   "name": ("near_perfect_correlation", 1.0), "part": ("near_perfect_correlation", 0.999999)}  # a third of its levels are missing
    of_text = {x["column"]: x.method for x in target_leakage(df, "name", ["y", "ordered", "mixed", "own", "noise", "part"]).collect()}
    assert of_text["ordered"] == "near_perfect_correlation" and of_text["mixed"] == "near_perfect_association" and of_text["part"] == "exact_copy"
    assert not {"own", "noise"} & set(of_text)
    blockers = {x["column"] for x in integrity_report(df, "y").where("severity = 'blocker'").collect()}
    assert {"ordered", "mixed", "name"} <= blockers and "noise" not in blockers


def test_association_against_brute_force(spark):
    import math
    from collections import Counter

    from millrace.operators.aggregates import value_counts
    from millrace.operators.integrity import wide_associations

    r = random.Random(11)
    rows = [(r.choice("abc"), f"v{r.randrange(70)}" if i % 9 else None, f"w{r.randrange(900)}") for i in range(1500)]
    rows = [(y if r.random() < 0.4 else "abc"[hash(v or "") % 3] if v is None else "abc"[int(v[1:]) % 3], v, w) for y, v, w in rows]
    df = spark.createDataFrame(rows, "y string, v string, w string")
    got = {x["column"]: (x.r, x.told) for x in wide_associations(df, "y", ["v", "w"], value_counts(df, ["v", "w", "y"])).collect()}
    for at, c in ((1, "v"), (2, "w")):
        known = [(x[at], x[0]) for x in rows if x[at] is not None]
        place = {v: i for i, v in enumerate(sorted({v for v, _ in known}))}
        xs, ys = [place[v] for v, _ in known], ["abc".index(y) for _, y in known]
        mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
        cov = sum((a - mx) * (b - my) for a, b in zip(xs, ys, strict=True))
        corr = abs(cov) / math.sqrt(sum((a - mx) ** 2 for a in xs) * sum((b - my) ** 2 for b in ys))
        sizes = Counter(v for v, _ in known)
        often = [(v, y) for v, y in known if sizes[v] > 1]
        entropy = lambda counts: -sum(n * math.log2(n / sum(counts.values())) for n in counts.values())
        whole = entropy(Counter(y for _, y in often))
        left = sum(entropy(Counter(y for u, y in often if u == v)) for v in {v for v, _ in often})
        assert abs(got[c][0] - corr) < 1e-9 and abs(got[c][1] - (1 - left / whole)) < 1e-9


def test_sparse_contract_takes_any_number_of_levels(spark):
    train = spark.range(120_000).select(
        "id", (F.col("id") % 100_000).cast("string").alias("wide"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("l"), F.col("id") % 3)).alias("few"),
        F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("x"))
    contract = M.fit_sparse_contract(train, ["x", "wide", "few"])
    assert contract.sizes == {"wide": 100_000, "few": 2} and contract.fills == {"wide": "0", "few": "l1"}
    place = {v: i for i, v in enumerate(sorted(str(i) for i in range(100_000)))}
    new = spark.createDataFrame([(1, "99999", "l2", 5.0), (2, "unseen", None, None), (3, None, "odd", 0.0)], "id long, wide string, few string, x double")
    out = {r["id"]: r for r in M.apply_sparse_contract(new, contract, ["id"]).collect()}
    for i, wide, few in ((1, place["99999"], 1), (2, 100_000, 0), (3, place["0"], 2)):
        v = out[i]["features"]
        assert v.size == 1 + 100_001 + 3 and (out[i]["wide_level"], out[i]["few_level"]) == (wide, few)
        hot = [int(k) for k, y in zip(v.indices, v.values, strict=True) if k > 0 and y == 1.0]
        assert hot == [1 + wide, 1 + 100_001 + few] and v[0] == pytest.approx(out[i]["x_scaled"])
    empty = M.apply_sparse_contract(new.where("id < 0"), contract, ["id"])
    assert empty.collect() == [] and empty.columns == ["id", "x_scaled", "wide_level", "few_level", "features"]
    with pytest.raises(ValueError, match="missing"):
        M.apply_sparse_contract(new.drop("few"), contract)


def test_trees_are_fitted_on_cells_where_many_rows_share_them(spark, monkeypatch):
    from functools import partial

    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    r = random.Random(3)
    rows = []
    for _ in range(3000):
        a, b, g = r.randrange(6), r.randrange(5), r.choice("uvw")
        rows.append((float(a), b, g, 3.0 * a - b * (g == "u") + r.random(), "yes" if a + b + 3 * r.random() > 5 else "no"))
    df = spark.createDataFrame(rows, "a double, b int, g string, y double, c string").repartition(2).cache()
    monkeypatch.setattr(M, "candidates", partial(M.candidates, rounds=3))
    given = []
    for kind in (GBTRegressor, GBTClassifier):
        monkeypatch.setattr(kind, "fit", lambda self, data, *rest, fit=kind.fit: (given.append(data.count()), fit(self, data, *rest))[1])
    for target, other, task, most in (("y", "c", "regression", 90), ("c", "y", "binary_classification", 180)):
        part, columns = df.drop(other), ["a", "b", "g"]
        whole = M.train_panel(part, target, task, trees=10)
        monkeypatch.setattr(M, "ROWS_PER_TASK", 500)
        few = M.train_panel(part, target, task, trees=10)
        monkeypatch.undo() if target == "c" else monkeypatch.setattr(M, "ROWS_PER_TASK", 50_000)
        assert given[0] == 3000 and given[1] <= most
        given.clear()
        said = {}
        for name, panel in (("whole", whole), ("few", few)):
            for model in ("gradient_boosting", "random_forest"):
                out = M.score(panel[model], part, target, task).groupBy(*columns).agg(F.max("prediction").alias("p"), F.count("*").alias("n")).collect()
                said[name, model] = {tuple(x[c] for c in columns): x.p for x in out}
                assert sum(x.n for x in out) == 3000
        one, two = said["whole", "gradient_boosting"], said["few", "gradient_boosting"]
        assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-6 for k in one)
        scores = [{x.metric: x.value for x in M.metrics_of(M.score(p["random_forest"], part, target, task), task).collect()} for p in (whole, few)]
        assert all(abs(scores[0][m] - scores[1][m]) < 0.05 for m in (["r2"] if task == "regression" else ["accuracy", "roc_auc"])), scores
        assert len(few["random_forest"][0].stages[-1].trees) == 10


def test_bags_hold_every_row_and_bins_follow_the_values(spark, monkeypatch):
    df = spark.range(0, 4000, numPartitions=2).select(
        (F.col("id") % 7).cast("double").alias("k"), F.col("id").cast("double").alias("label"), F.lit(1.0).alias("weight"))
    bags = {x.k: x.bag for x in M.bag_sums(df, ["k"], 20, 1).collect()}
    assert set(bags) == set(range(7)) and all([b.tree for b in bag] == list(range(20)) for bag in bags.values())
    drawn = [sum(bag[t].weight for bag in bags.values()) for t in range(20)]
    assert all(abs(n - 4000) < 400 for n in drawn) and len(set(drawn)) > 10
    assert all(0 < b.total / b.weight < 4000 for bag in bags.values() for b in bag)
    monkeypatch.setattr(M, "HELD_CELLS", 1)
    assert {x.k: x.bag for x in M.bag_sums(df, ["k"], 20, 1).collect()} == bags
    edges = dict(zip(("k", "label", "weight"), M.bin_edges(df, ["k", "label", "weight"]), strict=True))
    assert edges["k"][1:-1] == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5] and edges["weight"][1:-1] == [1.0]
    inner = edges["label"][1:-1]
    assert len(inner) == 31 and all(abs(x - (i + 1) * 125) < 20 for i, x in enumerate(inner))
