"""Classification metrics, closed-form over confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(preds: DataFrame, n_classes: int, *by: str) -> DataFrame:
    """by, y, pred, n over the whole class grid. Everything below reads this: one pass over the predictions."""
    counts = preds.groupBy(*by, "y", "pred").agg(F.count("*").alias("n"))
    k = preds.sparkSession.range(n_classes).select(F.col("id").cast("int"))
    grid = k.withColumnRenamed("id", "y").join(k.withColumnRenamed("id", "pred"))
    if by:
        grid = counts.select(*by).distinct().join(grid)
    return grid.join(counts, [*by, "y", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_metrics(conf: DataFrame, *by: str) -> DataFrame:
    """by, k, support, predicted, tp, precision, recall, f1; 0 where a denominator is 0."""
    rows = conf.select(*by, F.explode(F.array(F.struct(F.col("y").alias("k"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("pred").alias("k"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")))).alias("r")).select(*by, "r.*")
    out = rows.groupBy(*by, "k").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support")), "f1": ratio(2.0 * F.col("tp"), F.col("support") + F.col("predicted"))})


def summary(per_class: DataFrame, *by: str) -> DataFrame:
    """Macro F1 (all classes), weighted F1, accuracy, balanced accuracy (classes present) and MCC (null for one true class)."""
    t, p, c = F.col("support").cast("double"), F.col("predicted").cast("double"), F.col("tp").cast("double")
    g = per_class.groupBy(*by).agg(F.sum(t).alias("s"), F.sum(c).alias("c"), F.sum(t * p).alias("tp_"), F.sum(t * t).alias("tt"), F.sum(p * p).alias("pp"), F.avg("f1").alias("macro_f1"), F.sum(t * F.col("f1")).alias("wf"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.count_if(F.col("support") > 0).alias("present"))
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    mcc = F.when(F.col("present") > 1, F.when(den > 0, (F.col("c") * F.col("s") - F.col("tp_")) / den).otherwise(0.0))
    return g.select(*by, "macro_f1", (F.col("wf") / F.col("s")).alias("weighted_f1"), (F.col("c") / F.col("s")).alias("accuracy"), "balanced_accuracy", mcc.alias("mcc"))


METRICS = ("macro_f1", "weighted_f1", "accuracy", "balanced_accuracy", "mcc")


def over_folds(folds: DataFrame, *by: str) -> DataFrame:
    """Mean and population std of each metric over folds; null MCCs are left out."""
    return folds.groupBy(*by).agg(*[f(m).alias(f"{m}_{n}") for m in METRICS for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def dominance(conf: DataFrame) -> DataFrame:
    """k, true and predicted counts, per cents (2 places) and ratio (4 places, over at least one true row)."""
    rows = class_metrics(conf).select("k", "support", "predicted")
    w = Window.partitionBy()  # over one row a class
    pct = lambda c: F.round(100.0 * F.col(c) / F.sum(c).over(w), 2)
    return rows.withColumns({"true_percent": pct("support"), "predicted_percent": pct("predicted"), "ratio": F.round(F.col("predicted") / F.greatest(F.lit(1), F.col("support")), 4)})


def select_arm(results: DataFrame, margin: float) -> DataFrame:
    """The arm within ``margin`` of the best macro F1 with the fewest features, then the best balanced accuracy, then its name."""
    w = Window.partitionBy()  # over one row an arm
    near = results.withColumn("best", F.max("macro_f1").over(w)).filter(F.col("macro_f1") >= F.col("best") - F.lit(margin) - 1e-9)
    return near.orderBy("dim", F.col("balanced_accuracy").desc(), "arm").limit(1).drop("best")


def beats_baseline(results: DataFrame, baseline: str, margin: float) -> DataFrame:
    """winner: the best other arm if it is more than ``margin`` above the baseline, else the baseline."""
    r = results.agg(F.max(F.when(F.col("arm") == baseline, F.col("macro_f1"))).alias("b"), F.max_by("arm", F.when(F.col("arm") != baseline, F.col("macro_f1"))).alias("top"), F.max(F.when(F.col("arm") != baseline, F.col("macro_f1"))).alias("m"))
    return r.select(F.when(F.col("m") - F.col("b") > margin, F.col("top")).otherwise(F.lit(baseline)).alias("winner"))


def best_checkpoint(history: DataFrame) -> DataFrame:
    """The stage and epoch of least validation loss; stage 2 wins ties, then the earlier epoch."""
    return history.agg(F.min(F.struct("val_loss", (-F.col("stage")).alias("_s"), "epoch")).alias("m")).select((-F.col("m._s")).alias("stage"), "m.epoch", "m.val_loss")
