"""Windowed statistics of an event stream with late data, and the running total of a feature stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """New Parquet files under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Count and sum by window and key; events later than the watermark are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = events.withWatermark(time, late).groupBy(window.alias("w"), key)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def category_stats(features: DataFrame) -> DataFrame:
    """Running statistics by category."""
    return features.groupBy("category").agg(F.count("*").alias("cnt"), F.sum("area").alias("area"), F.sum("length").alias("length"))


def start(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes a stream to Parquet until its input is used up; the checkpoint makes each row appear once."""
    return result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
