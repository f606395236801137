"""A nearest-centroid scorer with out-of-fold predictions, and its letter-frequency features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import argmax, softmax

#: Letters counted, and the sharpness of the softmax.
LETTERS = ("e", "n", "a", "s", "t", "h", "o", "c", "ü", "ñ", "é", "è")
SHARPNESS = 100.0


def letter_features(text: Column, letters: tuple[str, ...] = LETTERS) -> list[Column]:
    n = F.length(text)
    return [F.coalesce((n - F.length(F.replace(text, F.lit(c)))) / n, F.lit(0.0)) for c in letters]


def centroids(train: DataFrame, n_folds: int, dim: int) -> DataFrame:
    """fold, cls, c (array): class means of the training rows of each fold; fold -1 is trained on all.

    One aggregation by (fold, class); a fold's training sums are all sums less its own.
    """
    sums = [F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(dim)]
    by = train.groupBy("fold", "cls").agg(F.count("*").alias("n"), *sums)
    total = by.groupBy("cls").agg(F.sum("n").alias("tn"), *[F.sum(f"s{i}").alias(f"t{i}") for i in range(dim)])
    ids = train.sparkSession.range(-1, n_folds).select(F.col("id").cast("int").alias("fold"))
    grid = ids.join(total).join(by, ["fold", "cls"], "left")
    n = F.col("tn") - F.coalesce("n", F.lit(0))
    return grid.filter(n > 0).select("fold", "cls", F.array(*[(F.col(f"t{i}") - F.coalesce(f"s{i}", F.lit(0.0))) / n for i in range(dim)]).alias("c"))


def predictions(rows: DataFrame, centres: DataFrame, classes: list[str]) -> DataFrame:
    """id, cls, fold, y (class index), p (array in class order), pred (index): squared distances to a fold's centroids.

    Centroids are one small row a fold, broadcast. Distances are rounded to nine places before the nearest is taken.
    """
    packed = centres.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("cls", "c"))).alias("_m"))
    order = F.array(*[F.lit(c) for c in classes])

    def score(c: Column) -> Column:
        centre = F.element_at(F.col("_m"), c)
        d = F.aggregate(F.zip_with("x", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
        return F.coalesce(-SHARPNESS * F.round(d, 9), F.lit(-1e9))

    out = rows.join(F.broadcast(packed), "fold").withColumn("p", softmax(F.transform(order, score)))
    keep = [c for c in rows.columns if c not in ("x", "text")]
    return out.select(*keep, (F.array_position(order, F.col("cls")) - 1).cast("int").alias("y"), "p", argmax(F.col("p")).alias("pred"))
