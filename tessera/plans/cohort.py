"""The driver's tables in the roles of a labelled cohort.

An item is a row of ``documents``; its class is ``lang``, its source ``source``. Sources numbered 16 and up count as
augmented. Feature vectors are letter frequencies of the text, or the branches of ``embeddings``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import scoring, splits
from tessera.sources.sinks import written

CONFIG = Config()
CLASSES = ["de", "en", "es", "fr"]
#: Branches of the 64 embedding places.
EMBEDDING_BRANCHES = [("deep", 0, 40), ("glcm", 40, 52), ("lbp", 52, 58), ("lab", 58, 64)]
AUGMENTED_FROM = 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def items(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """id, cls, source, source_type and the further columns asked for (the scan reads no others)."""
    number = F.regexp_extract("source", r"([0-9]+)$", 1).cast("int")
    kind = F.when(number >= AUGMENTED_FROM, "augmented").otherwise("original")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("cls"), "source", kind.alias("source_type"), *more)


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CLASSES], "cls string")


def split_items(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return splits.stratified_split(items(spark, sf_dir, *more), CONFIG.train_ratio, CONFIG.val_ratio, CONFIG.seed)


def folded(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Training originals with their fold."""
    rows = split_items(spark, sf_dir, *more).filter("split = 'train' AND source_type = 'original'")
    return splits.folds(rows, CONFIG.folds, CONFIG.seed + 1)


def holdout(spark: SparkSession, sf_dir: str, split: str, *more: str) -> DataFrame:
    return split_items(spark, sf_dir, *more).filter(F.col("split") == split)


#: Written tables of this process by (application, what, folder): several queries of one session share them.
_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def _shared(spark: SparkSession, what: str, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, what, sf_dir)
    if key not in _SHARED:
        _SHARED[key] = written(make())
    return _SHARED[key]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, cls, source_type, split, x (letter features) of all items: texts are read once a session, then left behind."""

    def make() -> DataFrame:
        rows = split_items(spark, sf_dir, "text").withColumn("x", F.array(*scoring.letter_features(F.col("text"))))
        return rows.select("id", "cls", "source_type", "split", "x")

    return _shared(spark, "base", sf_dir, make)


def _developed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, "development", sf_dir, lambda: development(base(spark, sf_dir)))


def development(rows: DataFrame) -> DataFrame:
    """id, cls, fold, x of the training originals of ``base``."""
    return splits.folds(rows.filter("split = 'train' AND source_type = 'original'").select("id", "cls", "x"), CONFIG.folds, CONFIG.seed + 1).select("id", "cls", "fold", "x")


def _oof(rows: DataFrame, k: int) -> DataFrame:
    some = rows.withColumn("x", F.slice("x", 1, k))
    return scoring.predictions(some, scoring.centroids(some, CONFIG.folds, k), CLASSES)


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of the training originals."""
    return _oof(_developed(spark, sf_dir), len(scoring.LETTERS))


def holdout_predictions(spark: SparkSession, sf_dir: str, *which: str) -> DataFrame:
    """Predictions of held-out rows by the scorer fitted on all training originals, with ``part``: calib or conf of the
    validation rows, test of the test rows."""
    rows = base(spark, sf_dir)
    held = rows.filter(F.col("split").isin(*which))
    parts = splits.halves(held.filter("split = 'val'").select("id", "cls"), CONFIG.seed + 2).select("id", "part")
    if "test" in which:
        parts = parts.unionByName(held.filter("split = 'test'").select("id", F.lit("test").alias("part")))
    # Fold -1 is trained on all folds, so one fold number does for the training rows.
    train = rows.filter("split = 'train' AND source_type = 'original'").select("cls", F.lit(0).alias("fold"), "x")
    centres = scoring.centroids(train, 0, len(scoring.LETTERS))
    return scoring.predictions(held.select("id", "cls", F.lit(-1).alias("fold"), "x"), centres, CLASSES).join(parts, "id")


def arm_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, id, fold, y, pred of three letter sets."""
    rows = _developed(spark, sf_dir)
    parts = [_oof(rows, k).select(F.lit(f"L{k}").alias("arm"), "id", "fold", "y", "pred") for k in (4, 8, 12)]
    return reduce(DataFrame.unionByName, parts)


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, cls (label as text), vec, fold."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("cls"), F.col("embedding").alias("vec"))
    return splits.folds(rows, CONFIG.folds, CONFIG.seed + 3)


def branch_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EMBEDDING_BRANCHES, "branch string, start int, stop int")
