"""Item identity, statuses and the conservation of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def surrogate_ids(items: DataFrame, by: list[str], id_: str, prefix: str = "ITEM", slices: int = 256) -> DataFrame:
    """``items`` with ``item_no`` and ``item_id`` in the order of ``by`` and an integer ``id_``.

    The order is total, so a lost task gives the same ids again. Rows are numbered within slices of each group (bounds
    of ``id_`` by approximate quantiles, at most ``slices`` numbers), which start from counts of what lies before.
    """
    bounds = sorted(set(items.stat.approxQuantile(id_, [i / slices for i in range(1, slices)], 0.5 / slices))) if slices > 1 else []
    edges = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>")
    sliced = items.withColumn("_slice", F.size(F.filter(edges, lambda b: b < F.col(id_))))
    keys = [*by, "_slice"]
    counts = sliced.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = sliced.withColumn("_in", F.row_number().over(Window.partitionBy(*keys).orderBy(id_)))
    out = numbered.join(before, [numbered[k].eqNullSafe(before[k]) for k in keys], "left")
    no = (F.col("_before") + F.col("_in")).cast("long")
    return out.select(*[numbered[c] for c in items.columns], no.alias("item_no"), F.format_string(f"{prefix}_%08d", no).alias("item_id"))


def quality_reasons(width: Column, height: Column, sharpness: Column, min_side: int, min_sharpness: float) -> Column:
    """Reasons joined by "; "; empty if the item passes."""
    return F.concat_ws("; ", F.when((width < min_side) | (height < min_side), F.lit("too small")), F.when(sharpness < min_sharpness, F.lit("blurry")))


def duplicate_status(kept: Column) -> Column:
    """UNIQUE, or DUPLICATE_OF the kept item."""
    return F.when(kept.isNull(), "UNIQUE").otherwise(F.concat(F.lit("DUPLICATE_OF:"), kept.cast("string")))


def quality_status(reason: Column) -> Column:
    return F.when(reason == "", "PASS").otherwise(F.concat(F.lit("FAIL: "), reason))


def conservation(items: DataFrame) -> DataFrame:
    """One row: every item must be exactly one of final, rejected, duplicate, review (boolean columns)."""
    n = F.col("final").cast("int") + F.col("rejected").cast("int") + F.col("duplicate").cast("int") + F.col("review").cast("int")
    out = items.agg(F.count("*").alias("n_items"), *[F.count_if(c).alias(f"n_{c}") for c in ("final", "rejected", "duplicate", "review")], F.count_if(n == 0).alias("n_unaccounted"), F.count_if(n > 1).alias("n_conflicting"))
    return out.withColumn("passed", (F.col("n_unaccounted") == 0) & (F.col("n_conflicting") == 0))


def balance_report(items: DataFrame) -> DataFrame:
    """Extracted, duplicates removed, quality rejected and final items of each class, in one pass."""
    return items.groupBy("cls").agg(F.count("*").alias("n_extracted"), F.count_if("duplicate").alias("n_duplicates"), F.count_if("rejected").alias("n_rejected"), F.count_if("final").alias("n_final"))


def parent_leaks(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Held-out parents with descendants in training: split, parents, descendants. Both sides have ``key``; parents have ``split``."""
    counts = children.groupBy("key").agg(F.count("*").alias("n"))
    hit = parents.join(counts, "key")
    return hit.groupBy("split").agg(F.count("*").alias("n_parents"), F.sum("n").cast("long").alias("n_descendants"))
