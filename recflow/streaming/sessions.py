"""Conversations as a stream of message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import speaker


def read_messages(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A stream of a folder of message files, with the schema of those there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def distinct_arrivals(messages: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Messages without redeliveries that come within the watermark."""
    rows = messages.withColumn("speaker", speaker(F.col("role"))).withColumn("event_time", F.coalesce("sent_at", "ingested_at"))
    return rows.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["session_id", "turn_number", "speaker", "content"])


def activity(messages: DataFrame, width: str = "1 day", lateness: str = "2 hours") -> DataFrame:
    """Tumbling counts of messages by speaker; rows later than the watermark are left out."""
    rows = messages.withColumn("speaker", F.coalesce(speaker(F.col("role")), F.lit("other"))).withColumn("event_time", F.coalesce("sent_at", "ingested_at"))
    counts = rows.withWatermark("event_time", lateness).groupBy(F.window("event_time", width).alias("w"), "speaker").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "speaker", "n")


def session_lengths(messages: DataFrame, gap: str = "6 hours", lateness: str = "2 hours") -> DataFrame:
    """Session windows of users' activity: rows, first and last time."""
    rows = messages.where(F.trim(F.coalesce("user_id", F.lit(""))) != "").withColumn("event_time", F.coalesce("sent_at", "ingested_at"))
    w = rows.withWatermark("event_time", lateness).groupBy(F.session_window("event_time", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
