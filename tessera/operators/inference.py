"""Batch inference: every input row comes out with the stage it reached and a status; nothing is dropped.

Stages: validate, preprocess, features, normalise, select, predict, calibrate, set, status.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import argmax, clipped, review_status

STAGES = ("validate", "preprocess", "features", "normalise", "select", "predict", "calibrate", "set", "status")
#: Least side of an input, and least deviation of its values.
LEAST_SIZE, LEAST_SPREAD = 32, 1e-4


def invalid_reason(present: Column, size: Column, spread: Column) -> Column:
    """Why an input cannot be used, or null: nothing there, too small, or all alike."""
    return F.when(~F.coalesce(present, F.lit(False)), "MISSING").when(size < LEAST_SIZE, "TOO_SMALL").when(spread < LEAST_SPREAD, "UNIFORM")


@dataclass(frozen=True)
class Frozen:
    """A fitted model: expressions and small arrays, nothing that grows with the data."""

    features: Callable[[Column], Column]  # preprocessed input to an array of numbers
    mean: list[float]
    std: list[float]
    mask: list[bool]
    centres: list[list[float]]  # by class, on selected places
    temperature: float
    q: float
    classes: list[str]
    preprocess: Callable[[Column], Column] = lambda x: x


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def infer(rows: DataFrame, value: str, reason: Column, model: Frozen) -> DataFrame:
    """id, reason, stage, label, confidence, prediction_set, size, status of (id, ``value``) rows.

    A row with a reason stops at validation; one whose features are not finite stops there. Probabilities are the softmax of
    minus the squared distances over the temperature; a class is in the set if 1 - p <= q.
    """
    x = rows.select("id", reason.alias("reason"), F.when(reason.isNull(), model.preprocess(F.col(value))).alias("x"))
    x = x.withColumn("f", F.when(F.col("reason").isNull(), model.features(F.col("x")).cast("array<double>"))).drop("x")
    sound = F.col("f").isNotNull() & ~F.exists("f", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = x.withColumn("f", F.when(sound, F.col("f")))
    z = F.zip_with(F.zip_with("f", _numbers(model.mean), lambda v, m: v - m), _numbers(model.std), lambda v, s: v / s)
    mask = F.array(*[F.lit(bool(b)) for b in model.mask])
    x = x.withColumn("z", F.filter(z, lambda v, i: F.get(mask, i)))
    logits = F.array(*[-F.aggregate(F.zip_with("z", _numbers(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / F.lit(float(model.temperature)) for c in model.centres])
    x = x.withColumn("logits", F.when(F.col("z").isNotNull(), logits))
    powers = F.transform("logits", lambda v: F.exp(v - F.array_max("logits")))
    x = x.withColumn("powers", powers).withColumn("p", clipped(F.transform("powers", lambda v: v / F.aggregate("powers", F.lit(0.0), lambda s, u: s + u))))
    chosen = F.filter(F.transform("p", lambda v, i: F.when((1 - v) <= F.lit(float(model.q)), i)), lambda i: i.isNotNull())
    names, valid = F.array(*[F.lit(c) for c in model.classes]), F.col("p").isNotNull()
    x = x.withColumn("set", F.when(valid, chosen))
    stage = F.when(F.col("reason").isNotNull(), "validate").when(~valid, "features").otherwise("status")
    return x.select(
        "id", "reason", stage.alias("stage"), F.when(valid, F.get(names, argmax(F.col("p")))).alias("label"), F.array_max("p").alias("confidence"),
        F.array_join(F.transform("set", lambda i: F.get(names, i)), ";").alias("prediction_set"), F.size("set").alias("size"), review_status(valid, F.coalesce(F.size("set"), F.lit(0))).alias("status"),
    )


def infer_or_raise(rows: DataFrame, value: str, reason: Column, model: Frozen) -> DataFrame:
    """As ``infer``, for callers that want an error instead of a status row: the first unusable row raises when it is read."""
    out = infer(rows, value, reason, model)
    message = F.concat(F.lit("input "), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(": "), F.coalesce("reason", F.lit("features not finite")))
    return out.withColumn("label", F.when(F.col("stage") == "status", F.col("label")).otherwise(F.raise_error(message).cast("string")))
