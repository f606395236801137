"""Texture, gradient and colour descriptors of images as a table, tolerant of bad rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRANCHES = ("glcm", "lbp", "hog", "color_lab")


def extract(images: DataFrame) -> DataFrame:
    """id, the four descriptors (arrays), error: a row for each row of ``images`` (id, height, width, pixels: RGB bytes by row).

    A row whose pixels do not fill its size, or whose descriptors are not finite, has null descriptors and says why; the
    others are not touched by it. Arrow batches, no shuffle.
    """
    kind = images.schema["id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from tessera.functions.images import describe

        for batch in batches:
            out: dict[str, list] = {b: [] for b in (*BRANCHES, "error")}
            for h, w, body in zip(*(c.to_pylist() for c in batch.columns[1:4])):
                found, error = {}, None
                if body is None or not h or not w or len(body) != 3 * h * w:
                    error = "pixels do not fill the size"
                else:
                    found = describe(np.frombuffer(body, np.uint8).reshape(h, w, 3))
                    if not all(np.isfinite(v).all() for v in found.values()):
                        found, error = {}, "not finite"
                for b in BRANCHES:
                    out[b].append(found[b].tolist() if b in found else None)
                out["error"].append(error)
            kinds = {b: pa.list_(pa.float64()) for b in BRANCHES} | {"error": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[b], kinds[b]) for b in out)], names=["id", *out])

    schema = ", ".join([f"id {kind}", *(f"{b} array<double>" for b in BRANCHES), "error string"])
    return images.select("id", F.col("height").cast("int"), F.col("width").cast("int"), "pixels").mapInArrow(run, schema)


def report(extracted: DataFrame) -> DataFrame:
    """n, n_failed and the widths of each descriptor."""
    return extracted.agg(F.count("*").alias("n"), F.count("error").alias("n_failed"), *[F.max(F.size(b)).alias(f"{b}_width") for b in BRANCHES])


def preprocessing(hair: Column, contrast: Column, mode: Column | str = "conditional") -> Column:
    """Steps that fire, as an array: hair removal for a coverage of 3 to 30 per cent, contrast equalisation under a std of 40; none in standard mode."""
    steps = F.filter(F.array(F.when(hair.between(0.03, 0.30), F.lit("hair_removal")), F.when(contrast < 40.0, F.lit("clahe"))), lambda x: x.isNotNull())
    return F.when((mode if isinstance(mode, Column) else F.lit(mode)) == "standard", F.array().cast("array<string>")).otherwise(steps)
