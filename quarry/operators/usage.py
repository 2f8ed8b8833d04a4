"""Usage reports: inspection of an index and gains from logged events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def language_counts(files: DataFrame, top: int = 15) -> DataFrame:
    """extension, files: the most frequent extensions, the others summed as (other)."""
    counts = files.groupBy("extension").agg(F.count(F.lit(1)).alias("files"))
    place = F.row_number().over(Window.orderBy(F.desc("files"), "extension"))
    return counts.withColumn("place", place).groupBy(F.when(F.col("place") <= top, F.col("extension")).otherwise("(other)").alias("extension")).agg(F.sum("files").alias("files"))


def inspect_index(docs: DataFrame, chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: files, chunks, sum of distinct terms per file, distinct terms, mean length."""
    return docs.agg(F.count(F.lit(1)).alias("files"), F.round(F.avg("doc_length"), 6).alias("average")).join(chunks.agg(F.count(F.lit(1)).alias("chunks"))).join(postings.agg(F.count(F.lit(1)).alias("file_terms"), F.count_distinct("term").alias("terms")))


def gains(log: DataFrame) -> DataFrame:
    """One row of log(event, path, files_suggested, tokens_suggested): sessions, queries, sums, distinct files opened."""
    is_ = lambda e: F.col("event") == e
    queries = F.count_if(is_("query"))
    files = F.coalesce(F.sum(F.when(is_("query"), F.col("files_suggested"))), F.lit(0))
    return log.agg(
        F.count_if(is_("session_start")).alias("sessions"), queries.alias("queries"), files.alias("files_suggested"), F.coalesce(F.sum(F.when(is_("query"), F.col("tokens_suggested"))), F.lit(0)).alias("tokens_suggested"), F.count_distinct(F.when(is_("file_read"), F.col("path"))).alias("files_opened"),
        F.round(F.when(queries > 0, files / queries).otherwise(0.0), 6).alias("files_per_query"),
    )
