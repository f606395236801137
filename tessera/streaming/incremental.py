"""Counts kept up to date over arriving items. The batch operators define the results; these follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_inventory(items: DataFrame) -> DataFrame:
    """Counts by (source, class) of a stream (complete or update mode)."""
    return items.groupBy("source", "cls").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, ts: str, by: str, width: str, late: str) -> DataFrame:
    """Tumbling counts and sums with a watermark: state for windows older than ``late`` is dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def new_items(items: DataFrame, id_: str, ts: str, late: str) -> DataFrame:
    """Items not seen within the watermark."""
    return items.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_])
