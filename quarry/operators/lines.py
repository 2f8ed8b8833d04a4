"""Source lines, and first-match rules over them: (kind, pattern, group) tables become one CASE chain per language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_lines(files: DataFrame) -> DataFrame:
    """path, language, line_no (from 1), line (trimmed) of files(path, language, content)."""
    return files.select("path", "language", F.posexplode(F.split("content", "\n")).alias("at", "raw")).select("path", "language", (F.col("at") + 1).alias("line_no"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("line"))


def first_match(line: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(kind, name) of the first rule whose pattern captures something that is not blank."""
    tried = F.array(*(F.struct(F.lit(kind).alias("kind"), F.trim(F.regexp_extract(line, pattern, 1)).alias("name")) for kind, pattern in rules))
    return F.get(F.filter(tried, lambda x: x["name"] != ""), F.lit(0))
