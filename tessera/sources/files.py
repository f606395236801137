"""File trees, label dictionaries and tables as sources. Contents are read only where they are asked for."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import suffix
from tessera.operators.labels import prefix_class
from tessera.schema import CLASS_MAPPING, DISCOVERED, FOLD_PLAN, PROVENANCE, struct

#: The extensions that count as images.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".webp")


def listing(spark: SparkSession, root: str, content: bool = False, extensions=EXTENSIONS) -> DataFrame:
    """path, rel (below ``root``), length and, if asked for, content of the files with a known extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.filter(suffix(F.col("path")).isin(*extensions))
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    rel = F.regexp_replace("path", r"^.*?" + "".join("\\" + x if not x.isalnum() and x != "/" else x for x in base) + "/", "")
    return files.select("path", rel.alias("rel"), "length", *(["content"] if content else []))


def _discovered(files: DataFrame, dataset: str, label: Column, version: Column, split: Column, kind: Column, raw: Column) -> DataFrame:
    none = F.lit("")
    return files.select(F.lit(dataset).alias("dataset"), "path", F.coalesce(version, none).alias("dataset_version"), F.coalesce(split, none).alias("original_split"), kind.alias("source_type"), label.alias("normalized_label"), raw.alias("raw_label"))


def scan_flat(files: DataFrame, dataset: str, **_) -> DataFrame:
    """root/<class>/**"""
    folder = F.get(F.split("rel", "/"), F.lit(0))
    return _discovered(files.filter(F.instr("rel", "/") > 0), dataset, folder, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("original"), folder)


def scan_splits(files: DataFrame, dataset: str, classes: list[str] | None = None, **_) -> DataFrame:
    """root/{train,test}/<class>/**; with ``classes`` a file whose name begins with one takes it as its label. Trees
    without split folders are flat."""
    parts = F.split("rel", "/")
    has = F.get(parts, F.lit(0)).isin("train", "test") & (F.size(parts) > 2)
    folder = F.when(has, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    rows = files.filter(F.instr("rel", "/") > 0).withColumn("_name", F.element_at(parts, -1))
    rows = prefix_class(rows, "_name", classes) if classes else rows.withColumn("prefix_class", F.lit(None).cast("string"))
    return _discovered(rows, dataset, F.coalesce("prefix_class", folder), F.lit(None).cast("string"), F.when(has, F.get(parts, F.lit(0))), F.lit("original"), folder)


def scan_versions(files: DataFrame, dataset: str, labels: dict[str, str] | None = None, **_) -> DataFrame:
    """root/{v1,v2}/{Preprocessed,Augmented}/<class>/**; labels by dictionary, unknown ones are left out."""
    parts = F.split("rel", "/")
    named = files.filter(F.size(parts) > 3).withColumn("_raw", F.get(parts, F.lit(2)))
    table = F.create_map(*[F.lit(x) for kv in (labels or {}).items() for x in kv]) if labels else None
    label = F.element_at(table, F.col("_raw")) if labels else F.col("_raw")
    kind = F.when(F.lower(F.get(parts, F.lit(1))) == "augmented", "augmented").otherwise("original")
    return _discovered(named.filter(label.isNotNull()), dataset, label, F.get(parts, F.lit(0)), F.lit(None).cast("string"), kind, F.col("_raw"))


SCANNERS: dict[str, Callable[..., DataFrame]] = {"flat": scan_flat, "splits": scan_splits, "versions": scan_versions}


def discover(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """All sources' files. A source: name, root, kind (unknown kinds are flat) and what its scanner takes."""
    parts = []
    for s in sources:
        more = {k: v for k, v in s.items() if k not in ("name", "root", "kind")}
        parts.append(SCANNERS.get(s.get("kind", "flat"), scan_flat)(listing(spark, s["root"]), s["name"], **more))
    return reduce(DataFrame.unionByName, parts)


def checked(files: DataFrame) -> DataFrame:
    """label, ok of (label, content) rows: whether the whole body is sound (see ``image_files.intact``). Bodies are read in Arrow batches."""

    def run(batches):
        import pyarrow as pa

        from tessera.functions.image_files import intact

        for batch in batches:
            ok = [body.is_valid and intact(body.as_buffer().to_pybytes()) for body in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ok, pa.bool_())], names=["label", "ok"])

    return files.select(F.col("label").cast("string").alias("label"), "content").mapInArrow(run, "label string, ok boolean")


def validate(files: DataFrame) -> DataFrame:
    """label, n_readable, n_corrupt, status of (label, content) rows: FAIL without a readable file, WARNING with corrupt ones."""
    out = checked(files).groupBy("label").agg(F.count_if("ok").alias("n_readable"), F.count_if(~F.col("ok")).alias("n_corrupt"))
    return out.withColumn("status", F.when(F.col("n_readable") == 0, "FAIL").when(F.col("n_corrupt") > 0, "WARNING").otherwise("PASS"))


def mapping_from_json(spark: SparkSession, text: str) -> DataFrame:
    """dataset, raw_label, target of a nested dictionary; keys that begin with an underscore are notes."""
    rows = [(d, label, t) for d, inner in json.loads(text).items() if not d.startswith("_") for label, t in inner.items()]
    return spark.createDataFrame(rows, CLASS_MAPPING)


def provenance_csv(spark: SparkSession, path: str) -> DataFrame:
    """The provenance table; of rows that repeat an id the last one stays (files in order of name, then lines)."""
    rows = spark.read.schema(struct(PROVENANCE)).csv(path, header=True)
    placed = rows.select(F.struct(*rows.columns).alias("row"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return placed.groupBy("row.item_id").agg(F.max_by("row", F.struct("file", "line")).alias("row")).select("row.*")


def fold_plan_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(struct(FOLD_PLAN)).csv(path, header=True)


def loaded_fold_plan(plan: DataFrame, classes: DataFrame, n_folds: int) -> tuple[DataFrame, DataFrame]:
    """A stored plan checked: weights by fold and class recomputed from its training rows, and its violations (check, detail).

    An id must be in each fold exactly once, and be validated by exactly one fold; folds must be numbered from 0 without gaps.
    """
    train = plan.filter("split_role = 'train'")
    per = train.groupBy("fold_id", "cls").agg(F.count("*").alias("n_train"))
    grid = plan.select("fold_id").distinct().join(F.broadcast(classes)).join(per, ["fold_id", "cls"], "left").withColumn("n_train", F.coalesce("n_train", F.lit(0)))
    n = F.broadcast(grid.groupBy("fold_id").agg(F.sum("n_train").alias("all"), F.count("*").alias("k")))
    weights = grid.join(n, "fold_id").select("fold_id", "cls", "n_train", F.when(F.col("n_train") > 0, F.col("all") / (F.col("k") * F.col("n_train"))).alias("weight"))
    by = plan.groupBy("id").agg(F.count("*").alias("rows"), F.count_distinct("fold_id").alias("folds"), F.count_if(F.col("split_role") == "val").alias("vals"))
    bad = by.select(F.explode(F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in (("once a fold", F.col("rows") == F.col("folds")), ("all folds", F.col("folds") == n_folds), ("validated once", F.col("vals") == 1))]), lambda x: x.isNotNull())).alias("check"), F.col("id").cast("string").alias("detail"))
    numbers = plan.select("fold_id").distinct().filter(~F.col("fold_id").between(0, n_folds - 1)).select(F.lit("fold number").alias("check"), F.col("fold_id").cast("string").alias("detail"))
    return weights, bad.unionByName(numbers)


def vectors(spark: SparkSession, path: str, column: str, dim: int) -> DataFrame:
    """A feature table whose vectors are checked as they are read: wrong widths, NaN and infinity raise."""
    rows = spark.read.parquet(path)
    good = (F.size(column) == dim) & ~F.exists(column, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.withColumn(column, F.when(good, F.col(column)).otherwise(F.raise_error(F.lit(f"bad vector in {column}")).cast(rows.schema[column].dataType)))
