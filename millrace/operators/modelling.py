"""Modelling on Spark ML: task and data checks, features, candidate panels, metrics, baselines, drift, verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import batched, pairwise
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Bucketizer, Imputer, IndexToString, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.aggregates import top_values, value_counts
from millrace.operators.integrity import distinct_counts
from millrace.operators.profile import kind_of
from millrace.operators.sampling import assign_folds
from millrace.operators.windows import row_numbers, running_total
from millrace.session import cut_lineage, kept, settled

# Task limits, sufficiency, drift and verdict thresholds, review share and floor.
MANY_VALUES = 20
ROWS_PER_FEATURE, SMALLEST_CLASS, ENOUGH_FOR_LOOKING = 50, 20, 30
MAX_LEVELS = 30
PSI_WARN, PSI_ALERT = 0.1, 0.2
UNSTABLE, OPTIMISTIC, LOW_QUALITY = 0.15, 0.1, 60
REVIEW_SHARE, REVIEW_FLOOR = 0.09, 0.25
INTERVAL_Z = 1.96
# Trees: bins per number (Spark's own default), rows that one task fits as they are, rows per cell that make cells worth while.
BINS, ROWS_PER_TASK, ROWS_PER_CELL = 32, 50_000, 10
# Cells that a task sums up before it hands them on, and trees that score in one plan.
HELD_CELLS, TREES_AT_ONCE = 10_000, 20


def infer_tasks(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(target, n_unique, task) from the targets' types and distinct values."""
    numeric = [c for c in targets if kind_of(df.schema[c]) == "numeric"]
    n, is_number = F.col("n_unique"), F.col("column").isin(*numeric) if numeric else F.lit(False)
    task = (F.when(n <= 1, "exploratory_analysis").when(is_number & (n > MANY_VALUES), "regression")
            .when(n == 2, "binary_classification").when(n <= MANY_VALUES, "multiclass_classification").otherwise("regression"))
    return distinct_counts(df, targets).select(F.col("column").alias("target"), "n_unique", task.alias("task"))


def sufficiency(df: DataFrame, target: str, task: str) -> DataFrame:
    """(n_rows, rows_recommended, min_class_count, sufficient)."""
    n = df.agg(F.count("*")).scalar()
    if task == "exploratory_analysis":
        return df.agg(F.count("*").alias("n_rows")).withColumn("sufficient", F.col("n_rows") >= ENOUGH_FOR_LOOKING)
    needed = ROWS_PER_FEATURE * max(1, len(df.columns) - 1)
    classes = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("c"))
    smallest = F.min("c") if "classification" in task else F.lit(None).cast("bigint")
    out = classes.agg(n.alias("n_rows"), F.lit(needed).alias("rows_recommended"), smallest.alias("min_class_count"))
    enough = (F.col("n_rows") >= needed) & (F.col("min_class_count").isNull() | (F.col("min_class_count") >= SMALLEST_CLASS))
    return out.withColumn("sufficient", enough)


def usable_features(df: DataFrame, target: str) -> list[str]:
    """Columns but the target and row keys (all distinct and not floating point)."""
    columns = [c for c in df.columns if c != target]
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    keys = {r["column"] for r in distinct_counts(df, columns).where("n_unique = n_rows").collect()} - floats
    return [c for c in columns if c not in keys]


def preprocessor(df: DataFrame, features: Sequence[str]) -> Pipeline:
    """Median-imputed, standardised numbers; mode-imputed, one-hot labels with unknown levels tolerated."""
    numbers = [c for c in features if kind_of(df.schema[c]) == "numeric"]
    labels = [c for c in features if c not in numbers]
    stages, parts = [], []
    if numbers:
        stages += [Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c}__i" for c in numbers]),
                   VectorAssembler(inputCols=[f"{c}__i" for c in numbers], outputCol="_numbers"),
                   StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)]
        parts.append("_scaled")
    if labels:
        stages += [StringIndexer(inputCols=labels, outputCols=[f"{c}__x" for c in labels], handleInvalid="keep"),
                   OneHotEncoder(inputCols=[f"{c}__x" for c in labels], outputCols=[f"{c}__h" for c in labels])]
        parts += [f"{c}__h" for c in labels]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages)


def ready_for_model(df: DataFrame, features: Sequence[str], levels: dict[str, list[str]]) -> DataFrame:
    """Numbers as doubles, gaps in labels filled with the mode, levels beyond the most frequent ones merged."""
    out = df
    for c in features:
        if kind_of(df.schema[c]) == "numeric":
            out = out.withColumn(c, F.col(c).cast("double"))
        else:
            kept = levels.get(c, [])
            value = F.coalesce(F.col(c).cast("string"), F.lit(kept[0] if kept else "missing"))
            out = out.withColumn(c, F.when(value.isin(*kept), value).otherwise("infrequent"))
    return out


def frequent_levels(df: DataFrame, features: Sequence[str], most: int = MAX_LEVELS - 1) -> dict[str, list[str]]:
    """Most frequent levels per label column; at most ``most`` of each come back."""
    labels = [c for c in features if kind_of(df.schema[c]) != "numeric"]
    levels: dict[str, list[str]] = {c: [] for c in labels}
    if labels:
        for r in top_values(df, labels, most).orderBy("column", "position").collect():
            levels[r["column"]].append(r["value"])
    return levels


class FrequentLevels(Estimator):
    """``frequent_levels`` and ``ready_for_model`` as the first stage of a pipeline, so that folds learn their own levels."""

    def __init__(self, features: Sequence[str]):
        super().__init__()
        self.features = list(features)

    def _fit(self, dataset: DataFrame) -> FrequentLevelsModel:
        return FrequentLevelsModel(self.features, frequent_levels(dataset, self.features))


class FrequentLevelsModel(Model):
    def __init__(self, features: Sequence[str], levels: dict[str, list[str]]):
        super().__init__()
        self.features, self.levels = list(features), levels

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return ready_for_model(dataset, self.features, self.levels)


def candidates(task: str, classes: int = 2, trees: int = 200, seed: int = 42, rounds: int = 100) -> dict[str, object]:
    """The panel for a task: a linear model, a random forest and gradient boosting."""
    if task == "regression":
        return {"linear_regression": LinearRegression(labelCol="label"),
                "random_forest": RandomForestRegressor(labelCol="label", numTrees=trees, seed=seed),
                "gradient_boosting": GBTRegressor(labelCol="label", seed=seed, maxIter=rounds, maxDepth=3, stepSize=0.1)}
    boosting = GBTClassifier(labelCol="label", seed=seed, maxIter=rounds, maxDepth=3, stepSize=0.1)
    if classes > 2:
        boosting = OneVsRest(classifier=boosting, labelCol="label")
    return {"logistic_regression": LogisticRegression(labelCol="label", maxIter=1000),
            "random_forest": RandomForestClassifier(labelCol="label", numTrees=trees, seed=seed),
            "gradient_boosting": boosting}


def with_label(df: DataFrame, target: str, task: str) -> tuple[DataFrame, list[str]]:
    """Adds ``label``: the number itself, or the class's place in the sorted vocabulary."""
    rows = df.where(F.col(target).isNotNull())
    if task == "regression":
        return rows.withColumn("label", F.col(target).cast("double")), []
    names = label_vocabulary(rows, target)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(target).cast("string")) - 1
    return rows.withColumn("label", place.cast("double")), names


def label_vocabulary(df: DataFrame, target: str, most: int = 10_000) -> list[str]:
    names = [r[0] for r in df.select(F.col(target).cast("string")).dropna().distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"{target} has more than {most} classes; it is not a class label")
    return sorted(names)


def bin_edges(df: DataFrame, columns: Sequence[str]) -> list[list[float]]:
    """Edges of at most ``BINS`` bins per column: one per value where the values are that few, else quantiles of all rows."""
    found = []
    for c, cuts in zip(columns, df.approxQuantile(list(columns), [i / BINS for i in range(1, BINS)], 0.001), strict=True):
        values = sorted(r[0] for r in df.select(c).distinct().limit(BINS + 1).collect())
        if len(values) <= BINS:
            cuts = [(a + b) / 2 for a, b in pairwise(values)] or values
        found.append([-np.inf, *sorted({x for x in cuts if np.isfinite(x)} or {0.0}), np.inf])
    return found


def binner(df: DataFrame, features: Sequence[str]) -> tuple[PipelineModel, list[str]]:
    """(stages that add ``binned`` to prepared rows, the columns it is made of). Trees see numbers by their bins only."""
    numbers = [c for c in features if kind_of(df.schema[c]) == "numeric"]
    labels = [c for c in features if c not in numbers]
    stages = []
    if numbers:
        filled = [f"{c}__i" for c in numbers]
        places = [f"{c}__k" for c in numbers]
        # A bucketizer marks its bins as unordered levels; plain numbers lose that mark.
        plain = ", ".join(f"`{k}` + 0D AS `{c}__b`" for k, c in zip(places, numbers, strict=True))
        stages += [Bucketizer(splitsArray=bin_edges(df, filled), inputCols=filled, outputCols=places, handleInvalid="keep"),
                   SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__")]
    parts = [f"{c}__b" for c in numbers] + [f"{c}__h" for c in labels]
    stages.append(VectorAssembler(inputCols=parts, outputCol="binned"))
    return PipelineModel(stages), [f"{c}__b" for c in numbers] + [f"{c}__x" for c in labels]


def bag_sums(points: DataFrame, cell: Sequence[str], trees: int, seed: int) -> DataFrame:
    """(``cell``, bag): per tree the weight and the sum of ``label`` that a bootstrap of ``points`` puts into the cell.

    Every point is drawn a Poisson number of times for every tree, as Spark's forest does it; the tasks sum up as they draw.
    """
    cell = list(cell)

    def sums(parts):
        draw = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held: dict[bytes, np.ndarray] = {}

        def handed_on():
            keys = np.array([np.frombuffer(k) for k in held])
            out = pd.DataFrame(dict(zip(cell, keys.T, strict=True)))
            out["_w"], out["_s"] = [v[0] for v in held.values()], [v[1] for v in held.values()]
            held.clear()
            return out

        for part in parts:
            if part.empty:
                continue
            keys, at = np.unique(part[cell].to_numpy("float64"), axis=0, return_inverse=True)
            order = np.argsort(at.ravel(), kind="stable")
            starts = np.searchsorted(at.ravel()[order], np.arange(len(keys)))
            times = draw.poisson(part["weight"].to_numpy()[order, None], (len(part), trees)).astype("float64")
            w = np.add.reduceat(times, starts)
            s = np.add.reduceat(times * part["label"].to_numpy()[order, None], starts)
            for i, key in enumerate(keys):
                k = key.tobytes()
                if k in held:
                    held[k] += (w[i], s[i])
                else:
                    held[k] = np.array((w[i], s[i]))
            if len(held) >= HELD_CELLS:
                yield handed_on()
        if held:
            yield handed_on()

    schema = ", ".join([*[f"`{c}` double" for c in cell], "_w array<double>", "_s array<double>"])
    columns = [*dict.fromkeys([*cell, "label", "weight"])]
    each = points.select(*columns).mapInPandas(sums, schema).select(*cell, F.posexplode(F.arrays_zip("_w", "_s")).alias("tree", "_"))
    total = each.groupBy(*cell, "tree").agg(F.sum("_._w").alias("weight"), F.sum("_._s").alias("total"))
    return total.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("tree", "weight", "total"))).alias("bag"))


class BaggedTrees(Model):
    """Trees that were fitted one by one on their bags; a cell is scored once and its rows take the mean from there."""

    def __init__(self, trees: Sequence[Model], keys: Sequence[str], classes: int):
        super().__init__()
        self.trees, self.keys, self.classes = list(trees), list(keys), classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        seen = cut_lineage(dataset.select(*self.keys, "binned").distinct())
        parts = []
        for some in batched(self.trees, TREES_AT_ONCE):
            wide, said = seen, []
            for i, tree in enumerate(some):
                shown = {tree.predictionCol: f"_y{i}"}
                if self.classes:
                    shown |= {tree.probabilityCol: f"_p{i}", tree.rawPredictionCol: ""}
                wide = tree.transform(wide, shown)
                said.append(vector_to_array(F.col(f"_p{i}")) if self.classes else F.array(f"_y{i}"))
            parts.append(wide.select(*self.keys, F.explode(F.array(*said)).alias("_v")))
        width = max(self.classes, 1)
        mean = reduce(DataFrame.unionByName, parts).groupBy(*self.keys).agg(F.array(*[F.avg(F.col("_v")[k]) for k in range(width)]).alias("_v"))
        if self.classes:
            best = F.array_position("_v", F.array_max("_v")) - 1
            mean = mean.select(*self.keys, array_to_vector("_v").alias("probability"), best.cast("double").alias("prediction"))
        else:
            mean = mean.select(*self.keys, F.col("_v")[0].alias("prediction"))
        return dataset.join(cut_lineage(mean), self.keys)


def bagged_forest(points: DataFrame, cells: DataFrame, keys: Sequence[str], forest: Estimator, classes: int) -> BaggedTrees:
    """The forest's trees, each fitted by Spark on the sums that its own bootstrap of all ``points`` leaves in the cells."""
    cell = [*keys, "label"] if classes else list(keys)
    trees, seed = forest.getNumTrees(), forest.getSeed()
    kind = "sqrt" if classes else "onethird"  # what Spark takes for more than one tree
    one = forest.copy({forest.numTrees: 1, forest.bootstrap: False, forest.featuresCol: "binned", forest.weightCol: "weight"})
    if trees > 1:
        one = one.copy({one.featureSubsetStrategy: kind})
    vectors = cells.select(*keys, "binned").distinct()
    bags = bag_sums(points, cell, trees, seed).join(vectors, list(keys)).select("binned", "bag").persist()

    def fitted(i: int) -> Model:
        drawn = bags.coalesce(bags_in).select("binned", F.col("bag")[i].alias("_b")).where("_b.weight > 0")
        rows = drawn.select("binned", F.col("_b.weight").alias("weight"), _class_label(F.col("_b.total") / F.col("_b.weight"), classes))
        return one.copy({one.seed: seed + i}).fit(rows)

    try:
        bags_in = -(-bags.count() // ROWS_PER_TASK)
        with ThreadPool(8) as pool:  # as the cross validator does: fits on a few cells each
            return BaggedTrees(pool.map(inheritable_thread_target(points.sparkSession)(fitted), range(trees)), keys, classes)
    finally:
        bags.unpersist()


def _class_label(value: Column, classes: int) -> Column:
    """``label``; the number of classes goes with it, as a bag may miss one."""
    return value.alias("label", metadata={"ml_attr": {"type": "nominal", "name": "label", "num_vals": classes}}) if classes else value.alias("label")


def train_panel(train: DataFrame, target: str, task: str, trees: int = 200, only: Sequence[str] = ()) -> dict[str, PipelineModel]:
    """Fitted pipelines by candidate name; the features are prepared once and shared.

    Many rows are dealt to as many tasks as they need. Trees tell rows apart by bins and levels only, so where rows share
    their cells, boosting is fitted on one weighted row per cell (and class), which gives the same sums in every node, and the
    forest on what its bootstraps of all rows sum up to in each cell.
    """
    features = usable_features(train, target)
    levels = frequent_levels(train, features)
    rows, names = with_label(train, target, task)
    prepared = preprocessor(train, features).fit(ready_for_model(rows, features, levels))
    full = prepared.transform(ready_for_model(rows, features, levels))
    classes = len(names)
    wanted = {name: e for name, e in candidates(task, classes, trees).items() if not only or name in only}
    ready = full.select("features", "label").persist()
    held = [ready]
    fitted = {}
    try:
        n, cells, points = ready.count(), None, None
        if n > ROWS_PER_TASK:
            tasks = max(-(-n // ROWS_PER_TASK), train.sparkSession.sparkContext.defaultParallelism)
            if set(wanted) - {"linear_regression", "logistic_regression"}:
                stages, keys = binner(full, features)
                points = stages.transform(full).select(*keys, "binned", "label", F.lit(1.0).alias("weight"))
                by = [*keys, "binned", "label"] if classes else [*keys, "binned"]
                value = F.first("label") if classes else F.avg("label")
                cells = points.groupBy(*by).agg(F.count("*").cast("double").alias("weight"), value.alias("_label"))
                cells = cells.select(*keys, "binned", "weight", _class_label(F.col("_label"), classes)).persist()
                held.append(cells)
                points = cells if classes else points.repartition(tasks)
                n_cells = cells.count()
                cells = cells.coalesce(-(-n_cells // ROWS_PER_TASK)) if n_cells * ROWS_PER_CELL <= n else None
            if cells is None:
                ready = ready.repartition(tasks).persist()
                held.append(ready)
        for name, estimator in wanted.items():
            if cells is None or name in ("linear_regression", "logistic_regression"):
                model = [estimator.fit(ready)]
            elif name == "random_forest":
                model = [*stages.stages, bagged_forest(points, cells, keys, estimator, classes)]
            else:
                model = [*stages.stages, _on_cells(estimator).fit(cells)]
            fitted[name] = (PipelineModel([prepared, *model]), features, levels, names)
    finally:
        for df in held:
            df.unpersist()
    return fitted


def _on_cells(boosting: Estimator) -> Estimator:
    """The same boosting on weighted cells."""
    if isinstance(boosting, OneVsRest):
        each = boosting.getClassifier()
        return OneVsRest(classifier=_on_cells(each), labelCol="label", featuresCol="binned", weightCol="weight")
    return boosting.copy({boosting.featuresCol: "binned", boosting.weightCol: "weight"})


def score(fitted: tuple, rows: DataFrame, target: str, task: str) -> DataFrame:
    """Rows with ``label`` and ``prediction`` (and ``probability`` where the model gives one)."""
    model, features, levels, _ = fitted
    return model.transform(ready_for_model(with_label(rows, target, task)[0], features, levels))


def infer(fitted: tuple, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Batch scoring with the stored preparation: class name and confidence, or the predicted number."""
    model, features, levels, names = fitted
    out = model.transform(ready_for_model(rows, features, levels))
    if not names:
        return out.select(*keep, "prediction")
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=names).transform(out)
    confidence = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(None).cast("double")
    return named.select(*keep, "predicted", confidence.alias("confidence"))


def classification_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, macro F1 and the F1 of class 1 from the confusion counts (Spark's own F1 is weighted), per group of ``by``."""
    by = list(by)
    cells = scored.groupBy(*by, "label", "prediction").agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    # A cell counts for its true class and for the class it was given.
    sides = F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), hit.alias("hit")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("hit"))))
    per = cells.select(*by, sides.alias("s")).groupBy(*by, "s.class").agg(*[F.sum(f"s.{c}").alias(c) for c in ("t", "p", "hit")])
    f1 = F.when(F.col("t") + F.col("p") > 0, 2.0 * F.col("hit") / (F.col("t") + F.col("p"))).otherwise(0.0)
    return per.groupBy(*by).agg(
        (F.sum("hit") / F.sum("t")).alias("accuracy"), F.avg(f1).alias("f1_macro"), F.coalesce(F.max(F.when(F.col("class") == 1, f1)), F.lit(0.0)).alias("f1"))


def roc_auc(scored: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """(``by``, roc_auc): the exact area under the curve; ties count half, null without both classes.

    Equal scores are one row before any order is made: each positive beats the negatives with a lower score.
    """
    by = list(by)
    counts = scored.groupBy(*by, F.col(score).alias("_s")).agg(
        F.sum("label").cast("bigint").alias("_pos"), F.sum(1 - F.col("label")).cast("bigint").alias("_neg"))
    below = running_total(counts, "_neg", "_upto", ["_s"], by)
    won = F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return below.groupBy(*by).agg(F.try_divide(won, pairs).alias("roc_auc"))


def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """mae, rmse and r2 from sums that add up over partitions, per group of ``by``; a constant target gives 1 or 0."""
    y, e = F.col(label).cast("double"), F.col(prediction) - F.col(label)
    s = scored.groupBy(*by).agg(F.count(y).alias("n"), F.sum(F.abs(e)).alias("ae"), F.sum(e * e).alias("se"),
                   (F.var_pop(y) * F.count(y)).alias("ss"))
    tiny = 2.220446049250313e-16
    r2 = F.when(F.col("ss") <= tiny, F.when(F.col("se") <= tiny, 1.0).otherwise(0.0)).otherwise(1 - F.col("se") / F.col("ss"))
    return s.select(*by, F.round(F.col("ae") / F.col("n"), 6).alias("mae"), F.round(F.sqrt(F.col("se") / F.col("n")), 6).alias("rmse"),
                    F.round(r2, 6).alias("r2"))


def metrics_of(scored: DataFrame, task: str, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, metric, value): all metrics of a task. A binary task has F1 of class 1 and the area under the curve."""
    by = list(by)
    if task == "regression":
        wide = regression_metrics(scored, by=by)
    else:
        wide = classification_metrics(scored, by)
        if task == "binary_classification":
            scores = scored.withColumn("score", vector_to_array("probability")[1])
            auc = roc_auc(scores, "score", by)
            wide = wide.drop("f1_macro").join(auc, by) if by else wide.drop("f1_macro").crossJoin(auc)  # one row each
        else:
            wide = wide.drop("f1")
    names = [c for c in wide.columns if c not in by]
    return wide.unpivot(by, names, "metric", "value")


def panel_scores(fitted: dict[str, tuple], test: DataFrame, target: str, task: str) -> DataFrame:
    """(model, metric, value) on held-out rows."""
    out = None
    for name, one in fitted.items():
        rows = settled(metrics_of(score(one, test, target, task), task)).select(F.lit(name).alias("model"), "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def default_metric(task: str) -> str:
    return {"binary_classification": "roc_auc", "multiclass_classification": "f1_macro"}.get(task, "r2")


def idle_scores(train: DataFrame, test: DataFrame, target: str, task: str) -> DataFrame:
    """(metric, value) of the model that does no work, learned from ``train``: its commonest class (the first of equal ones) or its mean."""
    if task == "regression":
        mean = train.agg(F.avg(F.col(target).cast("double"))).scalar()
        return metrics_of(with_label(test, target, task)[0].withColumn("prediction", mean), task)
    counts = train.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("_c")).agg(F.count("*").alias("_n"))
    top = counts.orderBy(F.desc("_n"), "_c").limit(1).select("_c").first()[0]
    names = label_vocabulary(train.select(target).unionByName(test.select(target)), target)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(target).cast("string")) - 1
    rows = test.where(F.col(target).isNotNull()).select(place.cast("double").alias("label"), F.lit(float(names.index(str(top)))).alias("prediction"))
    shown = ["accuracy", "f1", "roc_auc"] if task == "binary_classification" else ["accuracy", "f1_macro"]
    return classification_metrics(rows).withColumn("roc_auc", F.lit(0.5)).select(*shown).unpivot([], shown, "metric", "value")


def panel_choice(scores: DataFrame, idle: DataFrame, task: str, metric: str | None = None) -> DataFrame:
    """(model, metric, score, baseline, beats_baseline, winner), best first; of equal models the first by name wins."""
    metric = metric or default_metric(task)
    lower = metric in ("rmse", "mae")
    base = idle.where(F.col("metric") == metric).agg(F.max("value")).scalar()
    rows = scores.where(F.col("metric") == metric).select("model", "metric", F.col("value").alias("score"), base.alias("baseline"))
    rows = rows.withColumn("beats_baseline", F.col("score") < F.col("baseline") if lower else F.col("score") > F.col("baseline"))
    best = (F.asc_nulls_last if lower else F.desc_nulls_last)("score")
    # A panel has a handful of models.
    return rows.withColumn("winner", F.row_number().over(Window.orderBy(best, "model")) == 1).orderBy(best, "model")


def held_out_scores(
    df: DataFrame, target: str, task: str, fold: str, folds: int, model: str, expanding: bool = False, keep: Sequence[str] = (),
    trees: int = 200, rounds: int = 100,
) -> DataFrame:
    """(``fold``, label, prediction, probability where given, ``keep``): every row scored by the model that did not see its fold.

    Preparation, levels and model are one pipeline, fitted anew in each fold. Folds that hold out one part of the rows each
    go through Spark's cross validator by their number; with ``expanding``, a fold trains on the smaller numbers only.
    """
    used = [c for c in df.columns if c not in (fold, *keep)]
    features = usable_features(df.select(*used), target)
    rows, names = with_label(df, target, task)
    rows = rows.select(*features, "label", fold, *keep).persist()
    pipe = Pipeline(stages=[FrequentLevels(features), *preprocessor(df, features).getStages(), candidates(task, len(names), trees, rounds=rounds)[model]])
    try:
        if expanding:
            models = [pipe.fit(rows.where(F.col(fold) < i)) for i in range(folds)]
        else:
            judge = {"regression": RegressionEvaluator(labelCol="label"), "binary_classification": BinaryClassificationEvaluator(labelCol="label")}.get(
                task, MulticlassClassificationEvaluator(labelCol="label"))
            cross = CrossValidator(
                estimator=pipe, estimatorParamMaps=[{}], evaluator=judge, numFolds=folds, foldCol=fold, collectSubModels=True, parallelism=min(folds, 4))
            models = [found[0] for found in cross.fit(rows).subModels]
        parts = [m.transform(rows.where(F.col(fold) == i)) for i, m in enumerate(models)]
        shown = [c for c in (fold, "label", "prediction", "probability", *keep) if c in parts[0].columns]
        return cut_lineage(reduce(DataFrame.unionByName, [p.select(*shown) for p in parts]))
    finally:
        rows.unpersist()


def cross_validate(
    df: DataFrame, target: str, task: str, key: Sequence[str], folds: int = 5, model: str | None = None, entity: str | None = None,
    time: str | None = None, trees: int = 200, rounds: int = 100,
) -> tuple[DataFrame, DataFrame, str]:
    """((fold, metric, value), the held-out rows, splitter): the splitter is chosen by the task, the entities and the time column.

    Key, entity and time column split the rows and are no features.
    """
    name = model or ("linear_regression" if task == "regression" else "logistic_regression")
    placed, splitter = assign_folds(df, task, folds, key, target, entity, time)
    placed = cut_lineage(placed.drop(*{c for c in (entity, time) if c and c not in key}))
    numbers = [r[0] for r in placed.select("fold").distinct().where("fold >= 0").collect()]
    scored = held_out_scores(placed, target, task, "fold", max(numbers) + 1, name, splitter == "TimeSeriesSplit", key, trees, rounds)
    return metrics_of(scored, task, ["fold"]), scored, splitter


def baselines(df: DataFrame, target: str, task: str) -> DataFrame:
    """Scores of the model that does no work: the majority class, or the mean."""
    rows = df.where(F.col(target).isNotNull())
    if "classification" in task:
        counts = rows.groupBy(target).agg(F.count("*").alias("c"))
        share = F.max("c") / F.sum("c")
        return counts.agg(share.alias("accuracy"), (2 * share / (share + 1) / F.count("*")).alias("f1_macro"))
    mean = rows.agg(F.avg(target)).scalar()
    return rows.agg(F.stddev_pop(target).alias("rmse"), F.avg(F.abs(F.col(target) - mean)).alias("mae"), F.lit(0.0).alias("r2"))


def beats_baseline(fold_scores: DataFrame, baseline: DataFrame, metric: str) -> DataFrame:
    """Whether the baseline lies outside mean ± 1.96·sd/√k of the fold scores, on the worse side."""
    lower_better = metric in ("rmse", "mae")
    base = baseline.agg(F.max(metric)).scalar()
    out = fold_scores.where(F.col("metric") == metric).agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("*").alias("k"))
    half = F.when(F.col("k") >= 2, INTERVAL_Z * F.col("std") / F.sqrt("k")).otherwise(0.0)
    out = out.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half, "baseline": base})
    return out.withColumn("beats_baseline", F.col("ci_high") < F.col("baseline") if lower_better else F.col("ci_low") > F.col("baseline"))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(class, n, weight) with weight = rows / (classes · class rows)."""
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    return counts.withColumn("weight", F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n")))


def with_class_weight(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    weights = class_weights(df, target).select(F.col("class").alias(target), F.col("weight").alias(out))
    return df.join(weights, target)


def perceptron(train: DataFrame, vector: str, target: str, hidden: Sequence[int] = (32,), seed: int = 42) -> tuple:
    """A multilayer perceptron on an array column; (model, class names)."""
    from pyspark.ml.functions import array_to_vector

    rows, names = with_label(train, target, "multiclass_classification")
    ready = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), "label")
    size = len(train.select(vector).first()[0])
    layers = [size, *hidden, len(names)]
    return MultilayerPerceptronClassifier(labelCol="label", layers=layers, seed=seed, maxIter=60).fit(ready), names


def fit_feature_contract(train: DataFrame, features: Sequence[str]) -> dict[str, dict]:
    """Fill, scale and vocabulary per feature, from training rows only: one pass for numbers, one for labels."""
    numbers = [c for c in features if kind_of(train.schema[c]) == "numeric"]
    labels = [c for c in features if c not in numbers]
    out: dict[str, dict] = {}
    if numbers:
        facts = train.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(None))).alias("s"),
                                     F.count(c).alias("k"), F.count("*").alias("n")).alias(c) for c in numbers]).first()
        for c in numbers:
            f = facts[c]
            # Filled gaps sit on the mean: they keep it and shrink the spread by the share of known values.
            spread = (f["s"] or 0.0) * (f["k"] / max(f["n"], 1)) ** 0.5
            out[c] = {"kind": "numeric", "fill": f["m"] or 0.0, "mean": f["m"] or 0.0, "scale": spread or 1.0}
    if labels:
        counts = value_counts(train, labels)
        wide = [r["column"] for r in counts.groupBy("column").count().where("count > 10000").collect()]
        if wide:
            raise ValueError(f"{wide} have more than 10000 levels; use fit_sparse_contract, or hash or group them before one-hot encoding")
        for c in labels:
            rows = counts.where(F.col("column") == c).orderBy(F.desc("n"), "value").collect()
            out[c] = {"kind": "label", "fill": rows[0]["value"] if rows else "__MISSING__",
                      "levels": sorted(r["value"] for r in rows)}
    return {c: out[c] for c in features}


def apply_feature_contract(df: DataFrame, contract: dict[str, dict], keep: Sequence[str] = ()) -> DataFrame:
    """Model columns from a stored contract in one projection; a level not seen at fit time sets ``<feature>_unknown``."""
    cells: list[Column] = []
    for c, rule in contract.items():
        if c not in df.columns:
            raise ValueError(f"required feature {c!r} is missing")
        if rule["kind"] == "numeric":
            x = F.coalesce(F.col(c).cast("double"), F.lit(rule["fill"]))
            cells.append(((x - rule["mean"]) / rule["scale"]).alias(f"{c}_scaled"))
            continue
        v = F.coalesce(F.col(c).cast("string"), F.lit(rule["fill"]))
        cells += [(v == level).cast("int").alias(f"{c}_is_{level}") for level in rule["levels"]]
        cells.append((~v.isin(*rule["levels"])).cast("int").alias(f"{c}_unknown"))
    return df.select(*keep, *cells)


@dataclass
class SparseContract:
    """What ``fit_sparse_contract`` learned: per number its fill, mean and scale; per label its fill and number of levels, and
    one table (column, value, level) of all levels in the shared folder."""

    numbers: dict[str, dict]
    fills: dict[str, str]
    sizes: dict[str, int]
    levels: DataFrame


def fit_sparse_contract(train: DataFrame, features: Sequence[str]) -> SparseContract:
    """A feature contract for labels with any number of levels, from training rows only.

    Levels are numbered by value in a table, by positions that do not need a column's levels in one task. The driver keeps
    one row per feature. A gap is filled with the most frequent level, the first by value among equals.
    """
    numbers = [c for c in features if kind_of(train.schema[c]) == "numeric"]
    labels = [c for c in features if c not in numbers]
    counts = kept(value_counts(train, labels), "levels") if labels else train.sparkSession.createDataFrame([], "column string, value string, n long")
    facts = counts.groupBy("column").agg(F.count("*").alias("size"), F.min(F.struct(-F.col("n"), "value"))["value"].alias("fill")).collect()
    levels = kept(row_numbers(counts.drop("n"), "_at", ["value"], ["column"]).select("column", "value", (F.col("_at") - 1).alias("level")), "level-numbers")
    return SparseContract(
        fit_feature_contract(train, numbers) if numbers else {}, {c: None for c in labels} | {r["column"]: r["fill"] for r in facts},
        {c: 0 for c in labels} | {r["column"]: r["size"] for r in facts}, levels)


def apply_sparse_contract(df: DataFrame, contract: SparseContract, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, ``<number>_scaled``, ``<label>_level`` and ``features``: a sparse vector of the scaled numbers and, per label, one
    place for each level and a last one for levels not seen at fit time, whose ``_level`` is the number of levels.

    Each label column is joined with its levels: Spark sends them whole where they are few and splits frequent values where they
    are not. No level is part of the plan.
    """
    missing = [c for c in [*contract.numbers, *contract.sizes] if c not in df.columns]
    if missing:
        raise ValueError(f"required features {missing} are missing")
    scaled = [((F.coalesce(F.col(c).cast("double"), F.lit(r["fill"])) - r["mean"]) / r["scale"]).alias(f"{c}_scaled") for c, r in contract.numbers.items()]
    labels = list(contract.sizes)
    rows = df.select(*keep, *scaled, *[F.coalesce(_as_counted(df, c), F.lit(contract.fills[c])).alias(f"_v{i}") for i, c in enumerate(labels)])
    for i, c in enumerate(labels):
        numbered = contract.levels.where(F.col("column") == c).select(F.col("value").alias(f"_k{i}"), F.col("level").alias(f"_l{i}"))
        rows = rows.join(numbered, F.col(f"_v{i}") == F.col(f"_k{i}"), "left")
        rows = rows.withColumn(f"{c}_level", F.coalesce(f"_l{i}", F.lit(contract.sizes[c]))).drop(f"_v{i}", f"_k{i}", f"_l{i}")
    # The encoder learns the number of levels from one row that holds the last of each.
    inputs, outputs = [f"{c}_level" for c in labels], [f"_places{i}" for i in range(len(labels))]
    if labels:
        last = df.sparkSession.range(1).select(*[F.lit(float(max(contract.sizes[c] - 1, 0))).alias(f"{c}_level") for c in labels])
        rows = OneHotEncoder(inputCols=inputs, outputCols=outputs, dropLast=False, handleInvalid="keep").fit(last).transform(rows)
    return VectorAssembler(inputCols=[*[f"{c}_scaled" for c in contract.numbers], *outputs], outputCol="features").transform(rows).drop(*outputs)


def _as_counted(df: DataFrame, c: str) -> Column:
    """A label's text as ``value_counts`` gives it."""
    kind = df.schema[c].dataType
    return F.col(c).cast("bigint").cast("string") if isinstance(kind, T.IntegralType) else F.col(c).cast("string")


def verdicts(models: DataFrame) -> DataFrame:
    """Checks → pass / warn / fail and the highest safe level, from one metric row per model.

    Columns: sufficient, n_leaks, beats_baseline, cv_mean, cv_std, holdout, quality, lower_is_better.
    """
    unstable = F.abs(F.try_divide(F.col("cv_std"), F.col("cv_mean"))) > UNSTABLE
    overfit = ~F.col("lower_is_better") & (F.col("holdout") - F.col("cv_mean") > OPTIMISTIC)
    fails = [F.col("n_leaks") > 0, ~F.col("beats_baseline")]
    warns = [~F.col("sufficient"), F.col("beats_baseline").isNull(), unstable, overfit, F.col("quality") < LOW_QUALITY]

    def any_of(tests):
        hit = F.lit(False)
        for t in tests:
            hit = hit | F.coalesce(t, F.lit(False))
        return hit

    failed, warned = any_of(fails), any_of(warns)
    return models.withColumns({
        "verdict": F.when(failed, "fail").when(warned, "warn").otherwise("pass"),
        "max_level": F.when(failed, 1).when(warned, 2).otherwise(4)})


def population_drift(baseline: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(column, psi, status) over bins whose edges are the baseline's quantiles."""
    from millrace.operators.windows import percentiles

    edges = percentiles(baseline, column, {f"q{i}": i / bins for i in range(1, bins)}).first()
    cuts = sorted({edges[f"q{i}"] for i in range(1, bins)})
    place = F.lit(0)
    for e in cuts:
        place = place + (F.col(column) >= e).cast("int")

    def shares(df: DataFrame, name: str) -> DataFrame:
        known = df.where(F.col(column).isNotNull())
        n = known.agg(F.count("*")).scalar()
        return known.groupBy(place.alias("bin")).agg((F.count("*") / F.max(n)).alias(name))

    both = shares(baseline, "e").join(shares(current, "a"), "bin", "full_outer")
    e, a = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-6)) for c in ("e", "a"))
    out = both.agg(F.lit(column).alias("column"), F.sum((a - e) * F.log(a / e)).alias("psi"))
    return out.withColumn("status", F.when(F.col("psi") > PSI_ALERT, "alert").when(F.col("psi") > PSI_WARN, "warn").otherwise("stable"))


def economics(ledger: DataFrame, hourly_rate: float, mission_charge: float = 0.0) -> DataFrame:
    """Roll-up of a work ledger (manual_minutes, compute_cost, model_cost): effort avoided against what was paid."""
    s = ledger.agg(F.sum("manual_minutes").alias("m"), F.sum("compute_cost").alias("c"), F.sum("model_cost").alias("k"))
    hours = F.col("m") / 60.0
    review = F.greatest(F.lit(REVIEW_FLOOR), F.round(hours * REVIEW_SHARE, 2))
    cost = F.lit(mission_charge) + F.col("c") + F.col("k")
    value, paid = hours * hourly_rate, cost + review * hourly_rate
    return s.select(F.round(hours, 2).alias("manual_hours"), review.alias("review_hours"), F.round(cost, 2).alias("mission_cost"),
                    F.round(paid, 2).alias("total_cost"), F.round(value, 2).alias("labor_value"),
                    F.round(value / F.greatest(paid, F.lit(0.01)), 1).alias("multiplier"))
