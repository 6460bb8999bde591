"""Streams of activity: windows, sessions and unique events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, at: str = "ts") -> DataFrame:
    """A stream of the files under ``path``; its time column as a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 day", late: str = "40 days", at: str = "ts") -> DataFrame:
    """Events per window and type, late ones within ``late``."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "40 days", at: str = "ts", key: str = "user_id") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))


def unique(events: DataFrame, key: str = "event_id", late: str = "40 days", at: str = "ts") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
