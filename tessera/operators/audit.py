"""Metadata joins, leakage findings, distributions and content freezes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import UNKNOWN


def with_metadata(items: DataFrame, meta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join; missing metadata reads UNKNOWN."""
    joined = items.join(meta.select(key, *columns), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in columns})


def orphans(items: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """side, key: ids without the other side."""
    a = items.join(meta, key, "left_anti").select(F.lit("missing_metadata").alias("side"), key)
    return a.unionByName(meta.join(items, key, "left_anti").select(F.lit("orphan_metadata").alias("side"), key))


def distributions(items: DataFrame) -> DataFrame:
    """Counts by split, class, source, split and class, source and class: one pass of grouping sets."""
    sets = [["split"], ["cls"], ["source"], ["split", "cls"], ["source", "cls"]]
    return items.groupingSets([[F.col(c) for c in s] for s in sets], "split", "cls", "source").agg(F.count("*").alias("n"))


def capped(issues: DataFrame, key: str, most: int = 50) -> DataFrame:
    """place, detail, n: the first ``most`` issues in order of ``key``, and a last row with the number of the others."""
    first = issues.orderBy(key).limit(most)
    w = Window.orderBy("detail_")  # over at most ``most`` rows
    rows = first.select(F.col(key).alias("detail_")).withColumn("place", F.row_number().over(w)).select("place", F.col("detail_").cast("string").alias("detail"), F.lit(1).cast("long").alias("n"))
    rest = issues.agg(F.greatest(F.lit(0), F.count("*") - most).alias("n")).select(F.lit(most + 1).alias("place"), F.lit("more").alias("detail"), "n")
    return rows.unionByName(rest)


def split_grid(items: DataFrame, splits: DataFrame, classes: DataFrame) -> DataFrame:
    """Split by class counts, zero-filled."""
    counts = items.groupBy("split", "cls").agg(F.count("*").alias("n"))
    return splits.join(classes).join(counts, ["split", "cls"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def leaks(items: DataFrame, content: str) -> DataFrame:
    """kind, n: contents that lie in several splits, and (source, class) groups of augmented items that do."""
    def several(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count_distinct("split").alias("k")).agg(F.count("*").alias("n_groups"), F.count_if(F.col("k") > 1).alias("n_leaks")).select(F.lit(kind).alias("kind"), "n_groups", "n_leaks")

    out = several(items, [content], "content_in_several_splits")
    out = out.unionByName(several(items, ["id"], "id_in_several_splits"))
    return out.unionByName(several(items.filter("source_type = 'augmented'"), ["source", "cls"], "augmented_spread"))


def freeze(files: DataFrame) -> DataFrame:
    """rel_path, sha256 of (rel_path, content)."""
    return files.select("rel_path", F.sha2(F.coalesce(F.col("content"), F.lit("")), 256).alias("sha256"))


def freeze_manifest(frozen: DataFrame, buckets: int = 256) -> DataFrame:
    """One row: files, and one hash over all. Files are hashed in order within buckets of their hash, then bucket hashes
    in order: no group holds all paths."""
    line = F.concat_ws(":", "rel_path", "sha256")
    parts = frozen.groupBy(F.substring(F.md5("rel_path"), 1, 2).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("h"), F.count("*").alias("n"))
    return parts.agg(F.sum("n").cast("long").alias("n_files"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), ""), 256).alias("aggregate_hash"))


def freeze_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """rel_path, change: ADDED, REMOVED or CHANGED."""
    a, b = old.withColumnRenamed("sha256", "was"), new.withColumnRenamed("sha256", "now")
    change = F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").when(F.col("was") != F.col("now"), "CHANGED")
    return a.join(b, "rel_path", "full_outer").withColumn("change", change).filter("change IS NOT NULL").select("rel_path", "change")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
