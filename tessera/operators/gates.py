"""Contracts between stages, as violation tables expected to be empty: check, detail."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, checks: dict[str, Column], detail: Column) -> DataFrame:
    """One row for every (row, failed check); the checks are conditions that must hold (null fails)."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return rows.select(F.explode(failed).alias("check"), detail.cast("string").alias("detail"))


def first_failure(checks: dict[str, Column]) -> Column:
    """The first failed check's name, else null."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])


def probability_validity(preds: DataFrame, n_classes: int, tolerance: float = 1e-5) -> DataFrame:
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    checks = {
        "width": F.size("p") == n_classes,
        "no nan": ~F.exists("p", lambda x: x.isNull() | F.isnan(x)),
        "finite and not negative": ~F.exists("p", lambda x: (x < 0) | (x == float("inf"))),
        "sums to one": F.abs(total - 1) <= tolerance,
    }
    return violations(preds, checks, F.col("id"))


def winner_contract(stored: DataFrame, folds: DataFrame, n_folds: int, tolerance: float = 1e-4) -> DataFrame:
    """Arms whose fold rows are missing, or whose stored mean is not their folds' mean."""
    fresh = folds.groupBy("arm").agg(F.count("*").alias("n"), F.avg("macro_f1").alias("m"))
    joined = stored.join(fresh, "arm", "left")
    return violations(joined, {"all folds": F.col("n") == n_folds, "mean": F.abs(F.col("m") - F.col("macro_f1")) <= tolerance}, F.col("arm"))


def missing_cache(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """check, detail: ids without a cached vector, and ids cached twice."""
    lost = wanted.join(cached, key, "left_anti").select(F.lit("missing").alias("check"), F.col(key).cast("string").alias("detail"))
    twice = cached.groupBy(key).count().filter("count > 1").select(F.lit("twice").alias("check"), F.col(key).cast("string").alias("detail"))
    return lost.unionByName(twice)


def same_run(manifests: DataFrame, *fields: str) -> DataFrame:
    """check, detail: fields in which the phases' manifests differ."""
    parts = [manifests.agg(F.count_distinct(f).alias("n"), F.array_join(F.array_sort(F.collect_set(f)), ",").alias("detail")).filter("n > 1").select(F.lit(f).alias("check"), "detail") for f in fields]
    return reduce(DataFrame.unionByName, parts)


def composed(parts: dict[str, DataFrame]) -> DataFrame:
    """gate, n_violations, status (PASS or FAIL) of violation tables by gate, and a last row ``all``."""
    counts = [v.agg(F.count("*").alias("n_violations")).select(F.lit(g).alias("gate"), "n_violations") for g, v in parts.items()]
    rows = reduce(DataFrame.unionByName, counts)
    both = rows.unionByName(rows.agg(F.sum("n_violations").alias("n_violations")).select(F.lit("all").alias("gate"), "n_violations"))
    return both.withColumn("status", F.when(F.col("n_violations") == 0, "PASS").otherwise("FAIL"))


def run_gates(per_class: DataFrame, summary: DataFrame, dominance: DataFrame, calibrated: DataFrame, min_macro: float = 0.70, min_class: float = 0.50, max_ratio: float = 1.15, min_calibrated: float = 0.65) -> DataFrame:
    """status: CERTIFIED_WINNER if every threshold holds, else FALLBACK."""
    facts = summary.select(F.col("macro_f1").alias("m")).crossJoin(per_class.agg(F.min("f1").alias("least"))).crossJoin(dominance.agg(F.max("ratio").alias("r"))).crossJoin(calibrated.select(F.col("macro_f1").alias("c")))
    ok = (F.col("m") >= min_macro) & (F.col("least") >= min_class) & (F.col("r") <= max_ratio) & (F.col("c") >= min_calibrated)
    return facts.select(F.when(ok, "CERTIFIED_WINNER").otherwise("FALLBACK").alias("status"), "m", "least", "r", "c")


def contract(actual: dict, expected: dict) -> list[str]:
    """Fields of a manifest that differ from what is expected (floats to a relative 1e-7)."""
    def same(a, b) -> bool:
        if isinstance(b, float) and isinstance(a, (int, float)):
            return abs(a - b) <= 1e-7 * max(abs(a), abs(b))
        return a == b

    return [k for k, v in expected.items() if not same(actual.get(k), v)]


def check_mask(mask: list, dim: int) -> None:
    """A production mask must be booleans, of the fused width, and keep something."""
    if not all(isinstance(x, bool) for x in mask):
        raise TypeError("a mask holds booleans")
    if len(mask) != dim:
        raise ValueError(f"the mask has {len(mask)} places, the vectors {dim}")
    if not any(mask):
        raise ValueError("the mask keeps nothing")


def manifest(config: dict, **facts) -> str:
    """Sorted JSON with a digest of the configuration."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()
    return json.dumps({"config": config, "config_sha256": digest, **facts}, sort_keys=True, default=str)


def locked_test(confirm: bool, rows: DataFrame, expected: int) -> DataFrame:
    """The held-out test rows, once the caller confirms and their number is right."""
    if not confirm:
        raise PermissionError("the locked test set opens only with confirm=True")
    n = rows.count()
    if n != expected:
        raise ValueError(f"the locked test set has {n} rows, not {expected}")
    return rows
