"""Renderings of a selection: JSON lines, one JSON object, compact and table lines; and reading JSON lines back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSION = "0.3"


def compact_line(path: Column, role: Column, tokens: Column, score: Column) -> Column:
    return F.format_string("%s (%s, %dtok, %.2f)", path, role, tokens.cast("long"), score)


def shortened(path: Column, width: int = 60) -> Column:
    """Cut from the left, with dots."""
    return F.when(F.length(path) > width, F.concat(F.lit("..."), F.right(path, F.lit(width - 3)))).otherwise(path)


def jsonl(selected: DataFrame, query: str, preset: str, min_score: float, scanned: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """section, rank, line: header, a line per file in rank order, footer. Order by section, rank to write."""
    spark = selected.sparkSession
    budget = F.struct(F.lit(max_bytes).cast("long").alias("MaxBytes"))
    head = spark.range(1).select(F.lit(0).alias("section"), F.lit(0).alias("rank"), F.to_json(F.struct(F.lit(VERSION).alias("Version"), F.lit(query).alias("Query"), F.lit(preset).alias("Preset"), budget.alias("Budget"), F.lit(float(min_score)).alias("MinScore"))).alias("line"))
    body = selected.select(F.lit(1).alias("section"), "rank", F.to_json(F.struct(F.col("path").alias("Path"), F.col("score").alias("Score"), F.col("tokens").alias("Tokens"), F.col("language").alias("Language"), F.col("role").alias("Role"))).alias("line"))
    total = selected.agg(F.count(F.lit(1)).alias("TotalFiles"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("TotalTokens")).join(scanned.agg(F.count(F.lit(1)).alias("ScannedFiles")))
    return head.unionByName(body).unionByName(total.select(F.lit(2).alias("section"), F.lit(0).alias("rank"), F.to_json(F.struct("TotalFiles", "TotalTokens", "ScannedFiles")).alias("line")))


def json_object(selected: DataFrame, query: str, preset: str) -> DataFrame:
    """One row: the whole selection (bounded by its budget) as an object."""
    files = F.sort_array(F.collect_list(F.struct("rank", "path", "score", "tokens", "language", "role")))
    return selected.agg(F.to_json(F.struct(F.lit(query).alias("query"), F.lit(preset).alias("preset"), F.transform(files, lambda f: F.struct(f["path"].alias("path"), f["score"].alias("score"), f["tokens"].alias("tokens"), f["language"].alias("language"), f["role"].alias("role"))).alias("files"))).alias("line"))


def compact(selected: DataFrame) -> DataFrame:
    return selected.select("rank", compact_line(F.col("path"), F.col("role"), F.col("tokens"), F.col("score")).alias("line"))


def human(selected: DataFrame, width: int = 60) -> DataFrame:
    return selected.select("rank", F.concat(F.rpad(shortened(F.col("path"), width), width, " "), F.lit(" "), F.format_string("%8.4f %8d %s", F.col("score"), F.col("tokens").cast("long"), F.col("role"))).alias("line"))


def reread(lines: DataFrame) -> DataFrame:
    """line -> kind (header, footer, file, other) and the fields that re-rendering needs."""
    get = lambda name: F.get_json_object("line", f"$.{name}")
    kind = F.when(get("Version").isNotNull(), "header").when(get("TotalFiles").isNotNull(), "footer").when(get("Path").isNotNull(), "file").otherwise("other")
    return lines.select("line", kind.alias("kind"), get("Path").alias("path"), get("Score").cast("double").alias("score"), get("Tokens").cast("long").alias("tokens"), get("Language").alias("language"), get("Role").alias("role"))


def rank_of(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))
