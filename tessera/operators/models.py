"""Classifiers of Spark ML in cross-validation, and one-vs-rest calibrators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import argmax, clipped
from tessera.operators import forest

#: The deepest that Spark ML grows a tree; unlimited depth is not to be had.
CLASSIFIERS: dict[str, Callable] = {
    "random_forest": lambda seed, trees=300, depth=30: RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", weightCol="weight", seed=seed, labelCol="y"),
    "logistic_regression": lambda seed, **_: LogisticRegression(elasticNetParam=0.0, regParam=0.01, weightCol="weight", labelCol="y"),
    "gradient_boosting": lambda seed, **_: OneVsRest(classifier=GBTClassifier(seed=seed, maxIter=20), labelCol="y", weightCol="weight"),
    "linear_svm": lambda seed, **_: OneVsRest(classifier=LinearSVC(), labelCol="y", weightCol="weight"),
}


def classifier(name: str, seed: int, **more):
    if name not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {name!r}; known: {sorted(CLASSIFIERS)}")
    return CLASSIFIERS[name](seed, **more)


def weighted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``weight`` N / (C max(1, N_c)) over the classes present."""
    counts = rows.groupBy("y").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_c"))
    weights = counts.crossJoin(total).select("y", (F.col("_all") / (F.col("_c") * F.greatest(F.lit(1), "_n"))).alias("weight"))
    return rows.join(F.broadcast(weights), "y")  # one row a class


def cross_validate(rows: DataFrame, name: str, n_folds: int, seed: int, **more) -> DataFrame:
    """Pooled out-of-fold predictions. ``rows``: id, fold, y (double), vec. Fold f is seeded with seed + f.

    A random forest is grown by ``forest``, whole trees in a task, where the vectors can be broadcast, and by Spark ML beyond.
    """
    if name == "random_forest" and forest.fits(rows):
        return forest.out_of_fold(rows, n_folds, seed, **more)
    data = rows.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))
    parts = []
    for f in range(n_folds):
        model = classifier(name, seed + f, **more).fit(weighted(data.filter(F.col("fold") != f)))
        out = model.transform(data.filter(F.col("fold") == f))
        p = vector_to_array("probability") if "probability" in out.columns else F.lit(None).cast("array<double>")
        parts.append(out.select("id", "fold", F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"), p.alias("p")))
    return reduce(DataFrame.unionByName, parts)


def majority(train: DataFrame, rows: DataFrame) -> DataFrame:
    """The trivial baseline: the most frequent training class (ties: the smaller) for every row."""
    best = train.groupBy("y").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "y"))["y"].cast("int").alias("pred"))
    return rows.join(F.broadcast(best))


def realigned(p, labels: list[str], order: list[str]):
    """Probabilities in ``order`` from a model whose columns are ``labels``; other sets of names raise."""
    if set(labels) != set(order):
        raise ValueError(f"classes differ: {sorted(set(labels) ^ set(order))}")
    return F.array(*[F.get(p, F.lit(labels.index(c))) for c in order])


def fold_safe_pca(rows: DataFrame, vec: str, most: int, dim: int) -> DataFrame:
    """``rows`` with ``reduced``: principal components fitted on training rows (fold <> 0) only."""
    data = rows.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    train = data.filter("fold <> 0")
    k = min(most, train.count(), dim)
    model = PCA(k=k, inputCol="_v", outputCol="_r").fit(train)
    return model.transform(data).withColumn("reduced", vector_to_array("_r")).drop("_v", "_r")


def platt(calib: DataFrame, rows: DataFrame, n_classes: int) -> DataFrame:
    """``rows`` with p by one-vs-rest sigmoid fits, renormalised. A class that is all or never true passes through.

    Spark averages the loss, so the penalty of one half w squared on the summed loss is 1 / n.
    """
    n = calib.count()
    out = rows
    for k in range(n_classes):
        data = calib.select((F.col("y") == k).cast("double").alias("label"), array_to_vector(F.array(F.get("p", F.lit(k)))).alias("features"))
        if n == 0 or data.select("label").distinct().limit(2).count() < 2:
            out = out.withColumn(f"_c{k}", F.get("p", F.lit(k)))
            continue
        m = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False).fit(data)
        out = out.withColumn(f"_c{k}", 1 / (1 + F.exp(-(F.lit(float(m.coefficients[0])) * F.get("p", F.lit(k)) + F.lit(float(m.intercept))))))
    return _renormalised(out, n_classes)


def isotonic(calib: DataFrame, rows: DataFrame, n_classes: int) -> DataFrame:
    """``rows`` with p by one-vs-rest isotonic fits, clipped outside their range, renormalised."""
    out = rows
    for k in range(n_classes):
        data = calib.select((F.col("y") == k).cast("double").alias("label"), F.get("p", F.lit(k)).alias("features"))
        model = IsotonicRegression(predictionCol=f"_c{k}", featuresCol="features").fit(data)
        out = model.transform(out.withColumn("features", F.get("p", F.lit(k)))).drop("features")
    return _renormalised(out, n_classes)


def _renormalised(rows: DataFrame, n_classes: int) -> DataFrame:
    columns = [f"_c{k}" for k in range(n_classes)]
    done = rows.withColumn("p", clipped(F.array(*columns))).drop(*columns)
    return done.withColumn("pred", argmax(F.col("p")))


def calibrate(calib: DataFrame, rows: DataFrame, n_classes: int, method: str, least: int = 10) -> DataFrame:
    """By name; fewer than ``least`` calibration rows leave probabilities as they are."""
    if calib.limit(least).count() < least or method == "none":
        return rows
    return {"platt": platt, "isotonic": isotonic}[method](calib, rows, n_classes)
