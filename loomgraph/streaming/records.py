"""Structured Streaming forms of the record operators (an extension: the data model itself has no event time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators.records import normalize_and_score, stage_signature


def record_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def deduplicated(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Normalised, scored records of a stream, the first of each stage signature within the watermark."""
    scored = normalize_and_score(stream.withColumn("seq", F.lit(0).cast("bigint")))
    keyed = scored.where(F.size("problems") == 0).withColumn("signature", stage_signature())
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["signature"])


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", length: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(window_start, key, n, total) over tumbling or sliding windows; batch input gives the batch equivalent."""
    timed = events.withWatermark(time, delay) if events.isStreaming else events
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return timed.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """(key, session_start, session_end, n) of runs of events whose gaps are shorter than `gap`."""
    timed = events.withWatermark(time, delay) if events.isStreaming else events
    return timed.groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Start an append query that has processed what is there when awaited."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
