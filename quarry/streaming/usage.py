"""Structured Streaming over usage events: windowed counts, sessions, files opened once, index upkeep per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events per window and type; works alike on batches."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def opened_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    own = events.where("event_type = 'view'").withWatermark("ts", late)
    return own.dropDuplicatesWithinWatermark(["user_id"]) if events.isStreaming else own.dropDuplicates(["user_id"])


def keep_index(files: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that merges each batch of a stream of files into an index."""
    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
