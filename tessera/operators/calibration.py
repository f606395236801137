"""Proper scores, reliability and temperature scaling. Predictions have y (class index) and p (array in class order)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import argmax, at, clipped, tempered


def proper_scores(preds: DataFrame, *by: str) -> DataFrame:
    """by, n, nll (of clipped probabilities), brier (of clipped ones too)."""
    c = preds.withColumn("_p", clipped(F.col("p")))
    brier = F.aggregate(F.transform("_p", lambda x, i: F.pow(x - F.when(i == F.col("y"), 1.0).otherwise(0.0), F.lit(2))), F.lit(0.0), lambda a, x: a + x)
    return c.groupBy(*by).agg(F.count("*").alias("n"), F.avg(-F.log(at(F.col("_p"), F.col("y")))).alias("nll"), F.avg(brier).alias("brier"))


def bin_of(confidence: Column, bins: int) -> Column:
    """Index of the bin [lo, hi) with edges i / bins as i * (1 / bins) in double arithmetic; the last bin is closed."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda e: e <= confidence)).cast("int")


def reliability(preds: DataFrame, bins: int, confidence: Column | None = None, correct: Column | None = None, *by: str) -> DataFrame:
    """by, bin, lo, hi, n, confidence, accuracy: every bin, empty ones with zeros."""
    conf = F.array_max("p") if confidence is None else confidence
    ok = (argmax(F.col("p")) == F.col("y")) if correct is None else correct
    by_bin = preds.select(*by, bin_of(conf, bins).alias("bin"), conf.alias("c"), ok.cast("double").alias("ok")).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("c").alias("confidence"), F.avg("ok").alias("accuracy"))
    grid = preds.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        grid = by_bin.select(*by).distinct().join(grid)
    out = grid.join(by_bin, [*by, "bin"], "left")
    return out.select(*by, "bin", (F.col("bin") * F.lit(1.0 / bins)).alias("lo"), ((F.col("bin") + 1) * F.lit(1.0 / bins)).alias("hi"), *[F.coalesce(x, F.lit(0)).alias(x) if x == "n" else F.coalesce(x, F.lit(0.0)).alias(x) for x in ("n", "confidence", "accuracy")])


def ece(bins: DataFrame, *by: str) -> DataFrame:
    """Expected calibration error from reliability bins."""
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def per_class_ece(preds: DataFrame, bins: int) -> DataFrame:
    """k, ece of each class against the rest."""
    flat = preds.select("y", F.posexplode("p").alias("k", "pk"))
    return ece(reliability(flat, bins, F.col("pk"), F.col("y") == F.col("k"), "k"), "k")


def temperature_grid(preds: DataFrame, points: int = 60, lo: float = 0.05, hi: float = 20.0) -> DataFrame:
    """t, nll on a logarithmic grid: one pass, each row meeting a broadcast grid of ``points`` temperatures."""
    step = math.log(hi / lo) / (points - 1)
    # Rounded, so that any engine has the same temperatures.
    grid = preds.sparkSession.createDataFrame([(i, round(lo * math.exp(step * i), 6)) for i in range(points)], "i int, t double")
    each = preds.select("y", "p").join(F.broadcast(grid))
    q = clipped(tempered(F.col("p"), F.col("t")))
    return each.groupBy("i", "t").agg(F.avg(-F.log(at(q, F.col("y")))).alias("nll"))


def fit_temperature(preds: DataFrame, lo: float = 0.05, hi: float = 20.0, rounds: int = 3, points: int = 24) -> float:
    """The temperature of least NLL: grids refined around the best point; 1 for no rows. One job a round."""
    for _ in range(rounds):
        best = temperature_grid(preds, points, lo, hi).agg(F.min(F.struct(F.round("nll", 12), "t"))["t"].alias("t")).first()["t"]
        if best is None:
            return 1.0
        ratio = (hi / lo) ** (1.0 / (points - 1))
        lo, hi = max(0.05, best / ratio), min(20.0, best * ratio)
    return best


def apply_temperature(preds: DataFrame, t: float) -> DataFrame:
    """``preds`` with calibrated p; argmax never moves (see ``moved``)."""
    return preds.withColumn("p", clipped(tempered(F.col("p"), F.lit(t))))


def moved(before: DataFrame, after: DataFrame, id_: str = "id") -> DataFrame:
    """Rows whose argmax calibration changed; expected empty."""
    a = before.select(id_, argmax(F.col("p")).alias("was"))
    return a.join(after.select(id_, argmax(F.col("p")).alias("now")), id_).filter("was <> now")
