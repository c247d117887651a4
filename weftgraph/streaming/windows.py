"""Structured Streaming counterparts of the batch segmentations: an extension, bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_parquet(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events of each key in tumbling or sliding windows; later than ``late`` is dropped: start, end, key, n."""
    w = F.window(time, length, slide or length)
    out = events.withWatermark(time, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key that end after a gap: start, end, key, n."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of rows delivered again within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
