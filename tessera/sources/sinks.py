"""Tables and manifests as outputs."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, is_dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_report(df: DataFrame, path: str, order: list[str], places: int = 6) -> None:
    """CSV sorted by ``order``; doubles to ``places``, null for undefined numbers, maps and arrays as JSON."""
    out = df
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out = out.withColumn(name, F.round(F.when(~F.isnan(name), F.col(name)), places))
        elif kind.startswith(("map", "array", "struct")):
            out = out.withColumn(name, F.to_json(name))
    out.orderBy(*order).write.mode("overwrite").csv(path, header=True)


def partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("split", "mapped_class")) -> None:
    """Parquet routed to one folder a value: statuses instead of moved files."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def metadata_digest(df: DataFrame, buckets: int = 256) -> DataFrame:
    """n, sha256 over all rows as JSON: rows are hashed, sorted and hashed within buckets, then the buckets in order."""
    rows = df.select(F.sha2(F.to_json(F.struct(*df.columns)), 256).alias("h"))
    parts = rows.groupBy(F.substring("h", 1, 2).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return parts.agg(F.sum("n").cast("long").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("sha256"))


def dataset_manifest(items: DataFrame, config, **facts) -> str:
    """Sorted JSON: rows, their digest, rows by class and split, the configuration and further facts."""
    n, digest = metadata_digest(items).first()
    counts = {f"{r.split}/{r.cls}": r.n for r in items.groupBy("split", "cls").agg(F.count("*").alias("n")).collect()}  # splits x classes rows
    return json.dumps({"n": n or 0, "sha256": digest, "counts": counts, "config": json.loads(config_snapshot(config)), **facts}, sort_keys=True, default=str)


def winner_json(selected: DataFrame, evidence: DataFrame) -> str:
    """The selected arm's row and its tests against the others, as sorted JSON (one row an arm)."""
    row = selected.first()
    if row is None:
        raise ValueError("no arm was selected")
    tests = [r.asDict() for r in evidence.orderBy("other").collect()]
    return json.dumps({**row.asDict(), "evidence": tests}, sort_keys=True, default=str)


def save_tables(path: str, **tables: DataFrame) -> DataFrame:
    """Parameter tables below ``path`` (Parquet), and a manifest of their digests; returns the manifest: name, n, sha256."""
    parts = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        parts.append(metadata_digest(df.sparkSession.read.parquet(f"{path}/{name}")).select(F.lit(name).alias("name"), "n", "sha256"))
    manifest = reduce(DataFrame.unionByName, parts)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest.sparkSession.read.parquet(f"{path}/manifest")


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of ``save_tables``; a table that is not what the manifest says is an error."""
    out = {}
    for row in spark.read.parquet(f"{path}/manifest").collect():  # one row a table
        out[row["name"]] = spark.read.parquet(f"{path}/{row['name']}")
        if tuple(metadata_digest(out[row["name"]]).first()) != (row["n"], row["sha256"]):
            raise ValueError(f"{row['name']} is not the table that was saved")
    return out


def config_snapshot(config) -> str:
    return json.dumps(asdict(config) if is_dataclass(config) else config, sort_keys=True, default=str, indent=1)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, where what follows reads it more than once or lineage should end.

    The folder is spark.checkpoint.dir; a local session may leave it unset.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    path = f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
