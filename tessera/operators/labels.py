"""Label harmonisation: key normalisation, mapping, prefix classification, inventories and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import normalize_key
from tessera.schema import AMBIGUOUS, EXCLUDE, UNKNOWN


def map_labels(counts: DataFrame, mapping: DataFrame, dataset: str, label: str) -> DataFrame:
    """``counts`` (one row a label) with ``target``: the mapped class, an outcome, or UNKNOWN. The mapping is a small dictionary."""
    keyed = mapping.select(normalize_key(F.col("dataset")).alias("_d"), normalize_key(F.col("raw_label")).alias("_l"), F.col("target")).dropDuplicates(["_d", "_l"])
    on = (normalize_key(F.col(dataset)) == F.col("_d")) & (normalize_key(F.col(label)) == F.col("_l"))
    return counts.join(keyed, on, "left").drop("_d", "_l").withColumn("target", F.coalesce("target", F.lit(UNKNOWN)))


def bad_targets(mapping: DataFrame, classes: list[str]) -> DataFrame:
    """Mapping rows outside the domain; expected empty."""
    return mapping.filter(~F.col("target").isin(*classes, EXCLUDE, AMBIGUOUS))


def key_mismatch(configured: DataFrame, mapped: DataFrame) -> DataFrame:
    """key, side: keys known to one side only."""
    left = configured.join(mapped, "key", "left_anti").select("key", F.lit("only_configured").alias("side"))
    return left.unionByName(mapped.join(configured, "key", "left_anti").select("key", F.lit("only_mapped").alias("side")))


def prefix_class(names: DataFrame, name: str, classes: list[str]) -> DataFrame:
    """``names`` with ``prefix_class``: the longest class that the normalised name starts with, else null."""
    norm = F.lower(F.regexp_replace(F.trim(F.col(name)), r"[\s_\-]+", "-"))
    branches = [F.when(F.startswith(norm, F.lit(normalised)), F.lit(c)) for normalised, c in sorted(((c.lower().replace("_", "-").replace(" ", "-"), c) for c in classes), key=lambda x: (-len(x[0]), x[0]))]
    return names.withColumn("prefix_class", F.coalesce(*branches))


def outcome_rollup(resolved: DataFrame, images: str) -> DataFrame:
    """Folders and images by outcome."""
    return resolved.groupBy("target").agg(F.count("*").alias("n_labels"), F.sum(images).cast("long").alias("n_items"))


def inventory(items: DataFrame) -> DataFrame:
    """Count and distinct source types of every (source, class)."""
    return items.groupBy("source", "cls").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source_type")), ", ").alias("source_types"))


def coverage(items: DataFrame, classes: DataFrame, critical: int = 50) -> DataFrame:
    """Class by source counts, zero-filled, with each class's total, contributing sources and status."""
    counts = items.groupBy("cls", "source").agg(F.count("*").alias("n"))
    sources = counts.select("source").distinct()
    grid = classes.join(sources)  # two small domains
    filled = grid.join(counts, ["cls", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("cls")
    out = filled.withColumn("total", F.sum("n").over(w)).withColumn("contributing", F.sum((F.col("n") > 0).cast("long")).over(w))
    return out.withColumn("status", F.when(F.col("total") == 0, "ZERO").when(F.col("total") < critical, "CRITICAL").otherwise("OK"))


def augmentation_policy(items: DataFrame, policy: str, threshold: int) -> DataFrame:
    """source type counts of every class, and whether augmented items go in: always, never, or while originals are few."""
    out = items.groupBy("cls").agg(F.count_if(F.col("source_type") == "original").alias("n_original"), F.count_if(F.col("source_type") == "augmented").alias("n_augmented"))
    rule = {"true": F.lit(True), "auto": F.col("n_original") < threshold}.get(policy, F.lit(False))
    return out.withColumn("include_augmented", rule)


def contribution_rollup(items: DataFrame) -> DataFrame:
    """Counts by class and source, with a TOTAL row a class and one over all."""
    return items.rollup("cls", "source").agg(F.count("*").alias("n")).select(F.coalesce("cls", F.lit("TOTAL")).alias("cls"), F.coalesce("source", F.lit("TOTAL")).alias("source"), "n")


def imbalance(counts: DataFrame) -> DataFrame:
    """One row: largest and smallest class over non-empty ones (ties: the first class), their ratio, and whether it warns."""
    seen = counts.filter("n > 0")
    row = seen.agg(F.min(F.struct((-F.col("n")).alias("k"), "cls"))["cls"].alias("largest"), F.min(F.struct("n", "cls"))["cls"].alias("smallest"), F.max("n").alias("n_max"), F.min("n").alias("n_min"))
    return row.withColumn("ratio", F.round(F.col("n_max") / F.col("n_min"), 2)).withColumn("warns", F.col("n_max") / F.col("n_min") >= 3.0)
