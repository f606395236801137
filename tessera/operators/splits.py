"""Deterministic stratified splits, folds, weights, samples and their invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import half_even, ranked, seeded


def stratified_split(items: DataFrame, train: float, val: float, seed: int) -> DataFrame:
    """``items`` with ``split``: per class, half-even shares of originals to train and val, the rest to test; augmented to train."""
    originals = items.filter("source_type = 'original'").withColumn("_key", seeded(F.col("id"), seed))
    sizes = originals.groupBy("cls").agg(F.count("*").alias("_n"))
    placed = ranked(originals, ["cls"], "_key", "id").drop("_key").join(F.broadcast(sizes), "cls")  # one row a class
    n_train, n_val = half_even(F.col("_n") * F.lit(train)), half_even(F.col("_n") * F.lit(val))
    split = F.when(F.col("rn") <= n_train, "train").when(F.col("rn") <= n_train + n_val, "val").otherwise("test")
    out = placed.withColumn("split", split).select(*items.columns, "split")
    return out.unionByName(items.filter("source_type <> 'original'").withColumn("split", F.lit("train")))


def halves(items: DataFrame, seed: int, names: tuple[str, str] = ("calib", "conf")) -> DataFrame:
    """``items`` with ``part``: a stratified half-and-half partition."""
    keyed = items.withColumn("_key", seeded(F.col("id"), seed))
    sizes = items.groupBy("cls").agg(F.count("*").alias("_n"))
    out = ranked(keyed, ["cls"], "_key", "id").join(F.broadcast(sizes), "cls")
    return out.withColumn("part", F.when(F.col("rn") <= half_even(F.col("_n") * 0.5), names[0]).otherwise(names[1])).select(*items.columns, "part")


def nested_split(train: DataFrame, seed: int, share: float = 0.2) -> DataFrame:
    """``train`` with ``inner``: "val" for a half-even ``share`` of each class, else "train" (the split inside a training part)."""
    keyed = train.withColumn("_key", seeded(F.col("id"), seed))
    sizes = train.groupBy("cls").agg(F.count("*").alias("_n"))
    out = ranked(keyed, ["cls"], "_key", "id").join(F.broadcast(sizes), "cls")  # one row a class
    return out.withColumn("inner", F.when(F.col("rn") <= half_even(F.col("_n") * F.lit(share)), "val").otherwise("train")).select(*train.columns, "inner")


def development_union(plan: DataFrame, development: DataFrame) -> DataFrame:
    """n_rows, n_distinct, n_development: whether one fold's training and validation rows are the whole development cohort, each once."""
    union = plan.filter("fold_id = 0").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_distinct"))
    return union.join(F.broadcast(development.agg(F.count("*").alias("n_development"))))


def fold_summary(plan: DataFrame) -> DataFrame:
    """fold_id, n_train, n_val, train_counts (JSON of training rows by class, classes in order)."""
    by = plan.groupBy("fold_id", "split_role", "cls").agg(F.count("*").alias("n"))
    train = F.when(F.col("split_role") == "train", F.struct("cls", "n"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(train)))
    total = lambda role: F.sum(F.when(F.col("split_role") == role, F.col("n")))
    return by.groupBy("fold_id").agg(total("train").alias("n_train"), total("val").alias("n_val"), F.to_json(counts).alias("train_counts"))


def expected_test_rows(items: DataFrame, train: float, val: float) -> int:
    """How many originals the stratified split leaves for the test set, from the classes' sizes alone."""
    sizes = items.filter("source_type = 'original'").groupBy("cls").agg(F.count("*").alias("n"))
    left = F.col("n") - half_even(F.col("n") * F.lit(train)) - half_even(F.col("n") * F.lit(val))
    return int(sizes.filter("cls IS NOT NULL").agg(F.coalesce(F.sum(left), F.lit(0))).first()[0])


def folds(items: DataFrame, k: int, seed: int) -> DataFrame:
    """``items`` with ``fold``: dealt in turn within each class, each class going on where the one before ended.

    No more folds than the smallest class has items, but two at least.
    """
    keyed = items.withColumn("_key", seeded(F.col("id"), seed))
    sizes = items.groupBy("cls").agg(F.count("*").alias("_n"))
    offset = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).crossJoin(sizes.agg(F.greatest(F.lit(2), F.least(F.lit(k), F.min("_n"))).alias("_k")))
    out = ranked(keyed, ["cls"], "_key", "id").join(F.broadcast(offset), "cls")  # one row a class
    return out.withColumn("fold", F.pmod(F.col("rn") - 1 + F.col("_offset"), F.col("_k")).cast("int")).select(*items.columns, "fold")


def fold_plan(folded: DataFrame, n_folds: DataFrame | int) -> DataFrame:
    """fold_id, split_role, id, cls: every fold's training and validation rows."""
    ids = folded.sparkSession.range(n_folds).select(F.col("id").cast("int").alias("fold_id"))
    plan = folded.join(F.broadcast(ids))
    return plan.select("fold_id", F.when(F.col("fold") == F.col("fold_id"), "val").otherwise("train").alias("split_role"), "id", "cls")


def class_weights(folded: DataFrame, classes: DataFrame, n_folds: int) -> DataFrame:
    """fold_id, cls, n_train, weight = N / (C N_c) over the taxonomy's C classes; null for a class without training rows.

    Training counts are all counts less the fold's own: one pass whatever the number of folds.
    """
    by = folded.groupBy("fold", "cls").agg(F.count("*").alias("n"))
    total = by.groupBy("cls").agg(F.sum("n").alias("all"))
    ids = folded.sparkSession.range(n_folds).select(F.col("id").cast("int").alias("fold_id"))
    grid = ids.join(classes).join(total, "cls", "left").join(by.select(F.col("fold").alias("fold_id"), "cls", "n"), ["fold_id", "cls"], "left")
    n = (F.coalesce("all", F.lit(0)) - F.coalesce("n", F.lit(0))).cast("long")
    grid = grid.select("fold_id", "cls", n.alias("n_train"))
    w = Window.partitionBy("fold_id")
    return grid.withColumn("weight", F.when(F.col("n_train") > 0, F.sum("n_train").over(w) / (F.count("*").over(w) * F.col("n_train"))))


def present_weights(items: DataFrame) -> DataFrame:
    """cls, weight with C the classes present and counts of at least one."""
    counts = items.groupBy("cls").agg(F.count("*").alias("n"))
    w = Window.partitionBy()  # over one row a class
    return counts.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.greatest(F.lit(1), F.col("n"))))


def invariants(plan: DataFrame, split: DataFrame) -> DataFrame:
    """check, n_rows, n_violations of a fold plan against the outer split."""
    def row(name: str, rows: DataFrame, bad: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n_rows")).crossJoin(bad.agg(F.count("*").alias("n_violations"))).select(F.lit(name).alias("check"), "n_rows", "n_violations")

    by_id = plan.groupBy("id").agg(F.count_if(F.col("split_role") == "val").alias("v"))
    both = plan.groupBy("fold_id", "id").agg(F.count_distinct("split_role").alias("r"))
    held = split.filter("split <> 'train'").select("id")
    augmented = split.filter("source_type <> 'original'").select("id")
    checks = [
        row("train and val of a fold are disjoint", both, both.filter("r > 1")),
        row("each item is validated once", by_id, by_id.filter("v <> 1")),
        row("no held-out item is in a fold", plan, plan.join(held, "id", "left_semi")),
        row("no augmented item is in a fold", plan, plan.join(augmented, "id", "left_semi")),
        row("each row has a class", plan, plan.filter("cls IS NULL")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def isolation(parts: DataFrame) -> DataFrame:
    """One row: ids, and ids found in more than one ``part``."""
    return parts.groupBy("id").agg(F.count_distinct("part").alias("k")).agg(F.count("*").alias("n_ids"), F.count_if(F.col("k") > 1).alias("n_shared"))


def seeded_sample(items: DataFrame, m: int, seed: int) -> DataFrame:
    """The first m of each class in seeded order. Candidates are cut to m a slice before they meet."""
    keyed = items.withColumn("_key", seeded(F.col("id"), seed))
    inner = Window.partitionBy("cls", F.substring("_key", 1, 2)).orderBy("_key", "id")
    few = keyed.withColumn("_r", F.row_number().over(inner)).filter(F.col("_r") <= m)
    return few.withColumn("rn", F.row_number().over(Window.partitionBy("cls").orderBy("_key", "id"))).filter(F.col("rn") <= m).select(*items.columns, F.col("rn").cast("long").alias("rn"))
