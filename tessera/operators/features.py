"""Feature vectors: fold-safe normalisation, fusion in canonical order, masks and their stability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Branch widths and the eight fusion arms (hog after its reduction to 32).
BRANCHES = {"deep": 1280, "glcm": 12, "lbp": 18, "hog": 32, "color_lab": 6}
ARMS = {
    "A0": ("deep",),
    "A1": ("deep", "glcm"),
    "A2": ("deep", "lbp"),
    "A3": ("deep", "hog"),
    "A4": ("deep", "color_lab"),
    "A5": ("deep", "glcm", "lbp"),
    "A6": ("deep", "glcm", "lbp", "hog", "color_lab"),
    "A7": ("deep", "glcm", "lbp", "color_lab"),
}
ALIASES = {"lab": "color_lab"}


def canonical(branches: list[str]) -> list[str]:
    """Aliases resolved, repeats dropped, canonical order; unknown branches raise."""
    named = {ALIASES.get(b, b) for b in branches}
    if named - BRANCHES.keys():
        raise ValueError(f"unknown branches {sorted(named - BRANCHES.keys())}")
    return [b for b in BRANCHES if b in named]


def slice_map(spark) -> DataFrame:
    """arm, branch, start, stop, arm_dim of every arm."""
    rows = [(a, i, b, BRANCHES[b]) for a, branches in ARMS.items() for i, b in enumerate(branches)]
    df = spark.createDataFrame(rows, "arm string, i int, branch string, dim int")
    w = Window.partitionBy("arm")
    stop = F.sum("dim").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return df.select("arm", "branch", (stop - F.col("dim")).alias("start"), stop.alias("stop"), F.sum("dim").over(w).alias("arm_dim"))


def fuse(branches: dict[str, DataFrame], id_: str, chosen: list[str]) -> DataFrame:
    """id and ``fused``: the chosen branches' vectors (a DataFrame each: id, vec), joined one to one and concatenated.

    One grouping by id instead of a join a branch. An id that a branch lacks or has twice is an error, raised when the
    row is read.
    """
    order = canonical(chosen)
    parts = [branches[b].select(id_, F.lit(i).alias("i"), F.col("vec").cast("array<double>").alias("vec")) for i, b in enumerate(order)]
    by = reduce(DataFrame.unionByName, parts).groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("i", "vec"))).alias("got"))
    whole = F.transform("got", lambda x: x["i"]) == F.array(*[F.lit(i) for i in range(len(order))])
    bad = F.raise_error(F.concat(F.lit("branches missing or repeated for id "), F.coalesce(F.col(id_).cast("string"), F.lit("null")))).cast("array<double>")
    return by.select(id_, F.when(whole, F.flatten(F.transform("got", lambda x: x["vec"]))).otherwise(bad).alias("fused"))


def bad_vectors(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows of the wrong width, or with NaN or infinite entries."""
    odd = F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(vec).isNull() | (F.size(vec) != dim) | odd)


def column_stats(train: DataFrame, vec: str, *by: str) -> DataFrame:
    """pos, n, mean and population std of each vector place over training rows; a std under 1e-8 counts as 1."""
    flat = train.select(*by, F.posexplode(vec).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    sd = F.stddev_pop("x")
    return flat.groupBy(*by, "pos").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.when(sd < 1e-8, 1.0).otherwise(sd).alias("std"))


def zscore(rows: DataFrame, vec: str, stats: DataFrame) -> DataFrame:
    """``rows`` with ``z``: standardised by training statistics (one row a place: broadcast, as wide as a vector)."""
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("_s"))
    z = F.zip_with(F.col(vec), F.col("_s"), lambda x, s: (x.cast("double") - s["mean"]) / s["std"])
    return rows.join(F.broadcast(packed)).withColumn("z", z).drop("_s")


def masked(vec: Column, mask: Column) -> Column:
    return F.filter(vec, lambda x, i: F.get(mask, i))


def variance_masks(rows: DataFrame, vec: str, k: int, n_folds: int) -> DataFrame:
    """fold, pos, selected: the k places of largest training variance of each fold.

    Per-fold training moments are all moments less the fold's own.
    """
    flat = rows.select("fold", F.posexplode(vec).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    by = flat.groupBy("fold", "pos").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = by.groupBy("pos").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    d = by.join(total, "pos").select("fold", "pos", (F.col("tn") - F.col("n")).alias("n"), (F.col("ts") - F.col("s")).alias("s"), (F.col("tq") - F.col("q")).alias("q"))
    var = F.round(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), 9)
    return d.withColumn("r", F.row_number().over(Window.partitionBy("fold").orderBy(var.desc(), "pos"))).select("fold", "pos", (F.col("r") <= k).alias("selected"))


def branch_retained(masks: DataFrame, ranges: DataFrame) -> DataFrame:
    """fold, branch, total, retained. ``ranges``: branch, start, stop."""
    on = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))
    return masks.join(F.broadcast(ranges), on).groupBy("fold", "branch").agg(F.count("*").alias("total"), F.count_if("selected").alias("retained"))


def family_breakdown(retained: DataFrame) -> DataFrame:
    """branch, mean and population std of retained features over folds, and per cent of the branch."""
    return retained.groupBy("branch").agg(F.avg("retained").alias("mean_retained"), F.stddev_pop("retained").alias("std_retained"), (100 * F.avg(F.col("retained") / F.col("total"))).alias("percent"))


def jaccard(masks: DataFrame) -> DataFrame:
    """fold_a, fold_b, jaccard of selected sets (two empty sets: 1)."""
    sets = masks.groupBy("fold").agg(F.collect_list(F.when(F.col("selected"), F.col("pos"))).alias("s"))
    a, b = sets.alias("a"), sets.alias("b")
    both, either = F.size(F.array_intersect("a.s", "b.s")), F.size(F.array_union("a.s", "b.s"))
    return a.join(b, F.col("a.fold") < F.col("b.fold")).select(F.col("a.fold").alias("fold_a"), F.col("b.fold").alias("fold_b"), F.when(either == 0, 1.0).otherwise(both / either).alias("jaccard"))


def branch_jaccard(masks: DataFrame, ranges: DataFrame) -> DataFrame:
    """branch, mean_jaccard: mean pairwise Jaccard index of the folds' selections within each branch (two empty ones: 1)."""
    on = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))
    sets = masks.join(F.broadcast(ranges), on).groupBy("branch", "fold").agg(F.collect_list(F.when(F.col("selected"), F.col("pos"))).alias("s"))
    a, b = sets.alias("a"), sets.alias("b")
    both, either = F.size(F.array_intersect("a.s", "b.s")), F.size(F.array_union("a.s", "b.s"))
    pairs = a.join(b, (F.col("a.branch") == F.col("b.branch")) & (F.col("a.fold") < F.col("b.fold"))).select(F.col("a.branch").alias("branch"), F.when(either == 0, 1.0).otherwise(both / either).alias("jaccard"))
    return ranges.select("branch").join(pairs.groupBy("branch").agg(F.avg("jaccard").alias("j")), "branch", "left").select("branch", F.coalesce("j", F.lit(1.0)).alias("mean_jaccard"))


def dimension_stats(masks: DataFrame) -> DataFrame:
    """mean, population std and, in order of folds, the numbers of selected places."""
    by = masks.groupBy("fold").agg(F.count_if("selected").alias("n"))
    per_fold = F.transform(F.array_sort(F.collect_list(F.struct("fold", "n"))), lambda x: x["n"])
    return by.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.array_join(per_fold, ",").alias("per_fold"))


def final_fit(train: DataFrame, vec: str) -> tuple[DataFrame, DataFrame]:
    """Normaliser (pos, mean, std) of all training rows, and class centres (cls, centre) of the normalised vectors."""
    stats = column_stats(train, vec)
    flat = zscore(train.filter("cls IS NOT NULL"), vec, stats).select("cls", F.posexplode("z").alias("pos", "x"))
    means = flat.groupBy("cls", "pos").agg(F.avg("x").alias("x")).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
    return stats, means.select("cls", F.transform("c", lambda x: x["x"]).alias("centre"))


def final_scores(held: DataFrame, vec: str, stats: DataFrame, centres: DataFrame) -> DataFrame:
    """id, y, pred of held-out rows, normalised as the training rows were; the nearest centre, the first label among equals."""
    packed = centres.agg(F.collect_list(F.struct("cls", "centre")).alias("centres"))  # classes x places numbers
    z = zscore(held, vec, stats).join(F.broadcast(packed))
    apart = lambda k: F.round(F.aggregate(F.zip_with("z", k["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 6)
    nearest = F.array_min(F.transform("centres", lambda k: F.struct(apart(k).alias("d"), k["cls"].alias("cls"))))
    return z.select("id", F.col("cls").alias("y"), nearest["cls"].alias("pred"))


def jaccard_summary(pairs: DataFrame) -> DataFrame:
    """mean, median, min, max; 1 where there are no two masks."""
    one = F.lit(1.0)
    return pairs.agg(*[F.coalesce(x, one).alias(n) for x, n in ((F.avg("jaccard"), "mean"), (F.percentile("jaccard", F.lit(0.5)), "median"), (F.min("jaccard"), "min"), (F.max("jaccard"), "max"))])


def attribution(rows: DataFrame, vec: str, mean: DataFrame, weights: DataFrame) -> DataFrame:
    """pos, attribution: mean additive contribution |w (x - mean)| of each place of a linear scorer."""
    flat = rows.select(F.posexplode(vec).alias("pos", "x"))
    return flat.join(F.broadcast(mean), "pos").join(F.broadcast(weights), "pos").groupBy("pos").agg(F.avg(F.abs(F.col("w") * (F.col("x") - F.col("mean")))).alias("attribution"))


def attribution_rollup(per_place: DataFrame, ranges: DataFrame) -> DataFrame:
    """branch, sum, mean, per cent and rank of absolute attribution."""
    on = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))
    by = per_place.join(F.broadcast(ranges), on).groupBy("branch").agg(F.sum("attribution").alias("total"), F.avg("attribution").alias("mean"))
    w = Window.partitionBy()  # over one row a branch
    return by.withColumn("percent", 100 * F.col("total") / F.sum("total").over(w)).withColumn("rank", F.row_number().over(Window.orderBy(F.round("total", 9).desc(), "branch")).cast("int"))
