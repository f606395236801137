"""Paired tests of arms and their correction for multiplicity."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MIN_DISCORDANT = 25


def discordant(preds: DataFrame) -> DataFrame:
    """arm_a, arm_b, n01 (only b right), n10 (only a right), statistic.

    A row an item with all its arms' outcomes, then pairs of arms within it: one shuffle by item, no join of arms.
    """
    items = preds.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("arm", (F.col("pred") == F.col("y")).alias("ok")))).alias("r"))
    pairs = F.flatten(F.transform("r", lambda x, i: F.transform(F.slice(F.col("r"), i + 2, F.size("r")), lambda z: F.struct(x["arm"].alias("arm_a"), z["arm"].alias("arm_b"), x["ok"].alias("oa"), z["ok"].alias("ob")))))
    flat = items.select(F.explode(pairs).alias("p")).select("p.*")
    out = flat.groupBy("arm_a", "arm_b").agg(F.count_if(~F.col("oa") & F.col("ob")).alias("n01"), F.count_if(F.col("oa") & ~F.col("ob")).alias("n10"))
    return with_statistic(out)


def evidence(winner: DataFrame, arms: DataFrame, pairs: DataFrame) -> DataFrame:
    """winner, other, n01, n10: the winner's row met with each pair that it is in, whichever way round; null where no pair was tested."""
    faced = winner.select(F.col("arm").alias("winner")).join(F.broadcast(arms.select(F.col("arm").alias("other"))), F.col("winner") != F.col("other"))
    keyed = faced.withColumn("key", F.array_sort(F.array("winner", "other")))
    tested = pairs.select(F.array_sort(F.array("arm_a", "arm_b")).alias("key"), "n01", "n10")
    return keyed.join(tested, "key", "left").select("winner", "other", "n01", "n10")


def with_statistic(counts: DataFrame) -> DataFrame:
    """McNemar's continuity-corrected statistic, unclamped; null under 25 discordant pairs."""
    d = F.col("n01") + F.col("n10")
    return counts.withColumn("statistic", F.when(d >= MIN_DISCORDANT, F.pow(F.abs(F.col("n01") - F.col("n10")) - 1, F.lit(2)) / d))


@F.pandas_udf(DoubleType())
def chi2_tail(statistic: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return statistic.map(lambda s: None if pd.isna(s) else math.erfc(math.sqrt(s / 2)))


def holm(tests: DataFrame, p: str, order: str) -> DataFrame:
    """``tests`` with ``holm``: step-down p; null p stays null and does not count. ``tests`` is one row a pair of arms."""
    known = Window.partitionBy(F.col(p).isNull()).orderBy(p, order)
    m = F.count(p).over(Window.partitionBy())
    step = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(known) + 1))
    stepped = tests.withColumn("_step", F.when(F.col(p).isNotNull(), step))
    return stepped.withColumn("holm", F.when(F.col(p).isNotNull(), F.max("_step").over(known.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")


def mcnemar_holm(preds: DataFrame) -> DataFrame:
    tests = discordant(preds).withColumn("p", chi2_tail("statistic")).withColumn("pair", F.concat_ws("~", "arm_a", "arm_b"))
    return holm(tests, "p", "pair").drop("pair")
