"""Split-conformal prediction sets: marginal and by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import at, review_status

MIN_CLASS = 15


def check_alpha(alpha: float) -> None:
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie strictly between 0 and 1")


def scores(preds: DataFrame) -> DataFrame:
    """y, score = 1 - p of the true class."""
    return preds.select("y", (1 - at(F.col("p"), F.col("y"))).alias("score"))


def kth(n: Column, alpha: float) -> Column:
    """ceil((n + 1)(1 - alpha)) kept within [1, n]; the product is rounded against float noise."""
    return F.greatest(F.lit(1), F.least(n, F.ceil(F.round((n + 1) * (1 - alpha), 9)).cast("long")))


def quantiles(preds: DataFrame, alpha: float, *by: str) -> DataFrame:
    """by, n, k, q: the k-th smallest score (an order statistic, not interpolated).

    Equal scores are counted first, so ranks are sums over distinct scores.
    """
    check_alpha(alpha)
    counts = scores(preds).groupBy(*by, "score").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("k", kth(F.col("n"), alpha)).filter(F.col("upto") >= F.col("k"))
    return ranked.groupBy(*by, "n", "k").agg(F.min("score").alias("q"))


def by_class(preds: DataFrame, alpha: float, n_classes: int) -> DataFrame:
    """y, n, k, q, small (fewer than 15 scores) of every class; an empty class has q = 1."""
    grid = preds.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("y"))
    out = grid.join(quantiles(preds, alpha, "y"), "y", "left")
    return out.select("y", F.coalesce("n", F.lit(0)).alias("n"), "k", F.coalesce("q", F.lit(1.0)).alias("q"), (F.coalesce("n", F.lit(0)) < MIN_CLASS).alias("small"))


def marginal_sets(preds: DataFrame, fitted: DataFrame) -> DataFrame:
    """``preds`` with ``set``: class indexes with 1 - p <= q (never p >= 1 - q: that loses a row by one ulp)."""
    q = fitted.select(F.col("q").alias("_q"))
    inside = F.filter(F.transform("p", lambda x, i: F.when((1 - x) <= F.col("_q"), i)), lambda i: i.isNotNull())
    return preds.join(F.broadcast(q)).withColumn("set", inside).drop("_q")


def mondrian_sets(preds: DataFrame, fitted: DataFrame) -> DataFrame:
    """``preds`` with ``set`` by each class's own q (one row a class)."""
    q = fitted.agg(F.array_sort(F.collect_list(F.struct("y", "q"))).alias("_q"))
    inside = F.filter(F.transform("p", lambda x, i: F.when((1 - x) <= F.get(F.col("_q"), i)["q"], i)), lambda i: i.isNotNull())
    return preds.join(F.broadcast(q)).withColumn("set", inside).drop("_q")


def evaluation(sets: DataFrame, *by: str) -> DataFrame:
    """by, n, coverage, mean and median size, shares of singleton, empty and ambiguous sets."""
    size = F.size("set")
    return sets.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.array_contains("set", F.col("y")).cast("double")).alias("coverage"), F.avg(size).alias("mean_size"), F.percentile(size, F.lit(0.5)).alias("median_size"), F.avg((size == 1).cast("double")).alias("singleton"), F.avg((size == 0).cast("double")).alias("empty"), F.avg((size > 1).cast("double")).alias("ambiguous"))


def size_histogram(sets: DataFrame, n_classes: int) -> DataFrame:
    """size, n for 0 to the number of classes."""
    counts = sets.groupBy(F.size("set").alias("size")).agg(F.count("*").alias("n"))
    grid = sets.sparkSession.range(n_classes + 1).select(F.col("id").cast("int").alias("size"))
    return grid.join(counts, "size", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def inclusion_rates(sets: DataFrame, n_classes: int) -> DataFrame:
    """k, rate: share of sets that hold the class."""
    total = sets.agg(F.count("*").alias("total"))
    hits = sets.select(F.explode("set").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    grid = sets.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("k"))
    return grid.join(hits, "k", "left").join(F.broadcast(total)).select("k", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("rate"))


def triage(sets: DataFrame, valid: Column, classes: list[str]) -> DataFrame:
    """id, label (of calibrated p), confidence, set (joined by ;), size, status: the batch form of single-item inference."""
    names = F.array(*[F.lit(c) for c in classes])
    size = F.size("set")
    joined = F.array_join(F.transform("set", lambda i: F.get(names, i)), ";")
    return sets.select("id", F.when(valid, F.get(names, F.col("pred"))).alias("label"), F.when(valid, F.array_max("p")).alias("confidence"), F.when(valid, joined).alias("prediction_set"), F.when(valid, size).alias("size"), review_status(valid, size).alias("status"))
