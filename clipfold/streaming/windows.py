"""Rolling windows over events, alike for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hopping(events: DataFrame, at: str, keys: list[str], length: str = "7 days", step: str = "1 day", shift_hours: int = 9, value: str = "cents") -> DataFrame:
    """Counts and sums in windows that start at midnight of the editorial day; ``events`` may be a stream with a watermark on ``at``."""
    local = events.withColumn("_at", F.col(at) + F.expr(f"interval {shift_hours} hours"))
    out = local.groupBy(F.window("_at", length, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias(value))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", value)


def first_seen(events: DataFrame, at: str, key: str, within: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark; later ones are dropped. For streams."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark([key])
