"""Imports of source files, their resolution to files by equi-joins, and the import graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.classify import is_vendored, parts, stem
from quarry.operators.lines import source_lines

_Q = r"[\"']*"
#: Patterns whose first group is the import; every pattern that captures something gives one.
PATTERNS: dict[str, list[str]] = {
    "rust": [r"^use crate::\s*([^:;{][^:;]*|\{[^:;]+)", r"^mod ([^{;][^;]*)"],
    "python": [r"^(?:import|from)\s+(\S+)"],
    "javascript": [r"^import .*?from \s*[\"';]*([^\"';]+)", r"require\([\"']*([^\"']+)"],
    "java": [r"^import (?:static )?\s*([^;]+)"],
    "c": [r"^#include\s*\"+([^\"]+)"],
    "ruby": [rf"^(?:require|require_relative) \s*{_Q}([^\"']+)"],
    "swift": [r"^(?:@testable )?import\s+(?:(?:class|struct|enum|protocol|func|var|typealias)\s+)?([^\s.]+)"],
    "elixir": [r"^(?:alias|import|use|require) (\p{Lu}[^,{ ]*)"],
    "php": [r"^use ([^; \\]*\\[^; ]*)", rf"^(?:require|require_once|include|include_once) \s*{_Q}([^\"';]+)"],
    "scala": [r"^import ([^{ ]*[^{ .])"],
    "r": [rf"^(?:library|require|source)\({_Q}([^\"')]+)"],
    "shell": [r"^(?:source|\.) \s*[\"']*([^\"'$][^\"']*)"],
    "go": [r"^import \s*\"*([^\"(]+)"],
}
PATTERNS["typescript"], PATTERNS["kotlin"], PATTERNS["cpp"] = PATTERNS["javascript"], PATTERNS["java"], PATTERNS["c"]


def imports(files: DataFrame) -> DataFrame:
    """path, language, line_no, raw: duplicates stay. Go's blocks are told by a running count of open lines per file."""
    own = source_lines(files.where(F.col("language").isin(list(PATTERNS))))
    found = F.array()
    for language, patterns in PATTERNS.items():
        found = F.when(F.col("language") == language, F.array(*(F.trim(F.regexp_extract("line", p, 1)) for p in patterns))).otherwise(found.cast("array<string>"))
    plain = own.where("language <> 'go'").select("path", "language", "line_no", F.explode(F.filter(found, lambda x: x != "")).alias("raw"))
    go = own.where("language = 'go'")
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("line") == "import (", F.lit(1)).when(F.col("line") == ")", F.lit(0))
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(0)) == 1
    single = F.regexp_extract("line", PATTERNS["go"][0], 1)
    block = F.regexp_replace("line", '^"+|"+$', "")
    raw = F.when(F.col("line") == "import (", "").when(inside & (F.col("line") == ")"), "").when(inside, block).otherwise(F.trim(single))
    return plain.unionByName(go.select("path", "language", "line_no", raw.alias("raw")).where("raw <> ''"))


def _folder(path: Column, up: int) -> Column:
    """The name of the folder `up` levels above the file; empty if there is none."""
    own = parts(path)
    return F.when(F.size(own) > up, F.element_at(own, -1 - up)).otherwise("")


def stem_index(paths: DataFrame) -> DataFrame:
    """key, path: file stems, and the folder's name for mod, index and __init__ files (rows may repeat)."""
    own = F.lower(stem(F.col("path")))
    more = paths.where(stem(F.col("path")).isin("mod", "index", "__init__")).select(F.lower(_folder(F.col("path"), 1)).alias("key"), "path").where("key <> ''")
    return paths.select(own.alias("key"), "path").unionByName(more)


def dir_index(paths: DataFrame) -> DataFrame:
    return paths.select(F.lower(_folder(F.col("path"), 1)).alias("key"), "path").where("key <> ''")


def _joined(importer: Column, raw: Column) -> Column:
    """The import beside its importer, lexically: ./ and ../ stay as they are."""
    base = F.regexp_extract(importer, r"^(.*)/[^/]*$", 1)
    return F.when(raw.startswith("/") | (base == ""), raw).otherwise(F.concat(base, F.lit("/"), raw))


def candidates(found: DataFrame) -> DataFrame:
    """The keys that each import may resolve by: kind of index, key and priority; beside is the joined path."""
    raw, lang = F.col("raw"), F.col("language")
    beside = _joined(F.col("path"), raw)
    key = lambda kind, value, tier: F.struct(F.lit(kind).alias("kind"), value.alias("key"), F.lit(tier).alias("tier"))
    last = lambda text, sep: F.lower(F.element_at(F.split(text, sep, -1), -1))
    file_stem = F.lower(stem(raw))
    dotted = F.regexp_replace(raw, r"^\.+", "")
    by_path = F.array(key("path", beside, 0), key("stem", file_stem, 10))
    segments = F.reverse(F.split(raw, r"\.", -1))
    keys = (
        F.when(lang == "go", F.array(key("dir", last(raw, "/"), 0), key("stem", last(raw, "/"), 10)))
        .when(lang.isin("javascript", "typescript"), F.when(raw.startswith("."), F.array(key("stem", F.lower(stem(beside)), 0))).otherwise(F.array(key("stem", last(raw, "/"), 0))))
        .when(lang == "python", F.when(raw.startswith("."), F.array(key("stem", F.when(dotted == "", F.lower(_folder(F.col("path"), 1))).otherwise(last(dotted, r"\.")), 0))).otherwise(F.array(key("stem", last(raw, r"\."), 0), key("stem", F.lower(F.element_at(F.split(raw, r"\.", -1), 1)), 10))))
        .when(lang == "elixir", F.transform(segments, lambda s, i: F.struct(F.lit("stem").alias("kind"), F.lower(s).alias("key"), (i * 10).alias("tier"))))
        .when(lang.isin("c", "cpp", "shell"), by_path)
        .when(lang == "php", F.when(raw.contains("\\"), F.array(key("stem", last(raw, r"\\"), 0))).otherwise(by_path))
        .when(lang == "r", F.when(raw.rlike("[/.]"), by_path).otherwise(F.array(key("stem", F.lower(raw), 0))))
        .when(lang == "ruby", F.array(key("stem", last(raw, "/"), 0)))
        .when(lang.isin("java", "kotlin", "scala"), F.array(key("stem", last(F.regexp_replace(raw, r"(\.\*)+$", ""), r"\."), 0)))
        .otherwise(F.array(key("stem", F.lower(raw), 0)))
    )
    return found.withColumn("beside", beside).withColumn("x", F.explode(keys)).select("path", "language", "line_no", "raw", "beside", "x.kind", "x.key", "x.tier").where("key <> ''")


def resolve(found: DataFrame, paths: DataFrame) -> DataFrame:
    """path, raw, target: the best tier of matches of each import. Files without a match (external) drop out."""
    paths = paths.select("path")
    lookup = stem_index(paths).select(F.lit("stem").alias("kind"), "key", F.col("path").alias("target")).unionByName(dir_index(paths).select(F.lit("dir").alias("kind"), "key", F.col("path").alias("target"))).unionByName(paths.select(F.lit("path").alias("kind"), F.col("path").alias("key"), F.col("path").alias("target")))
    asked = candidates(found)
    hits = asked.join(lookup, ["kind", "key"])
    bare = F.regexp_replace(F.col("target"), r"^(.*[^/])\.[^./]*$", "$1")
    penultimate = F.lower(F.element_at(F.concat(F.array(F.lit("")), F.split("raw", "/", -1)), -2))
    near = (
        F.when((F.col("language") == "go") & (F.col("kind") == "dir"), (penultimate != "") & (F.lower(_folder(F.col("target"), 2)) == penultimate))
        .when(F.col("language").isin("javascript", "typescript") & F.col("raw").startswith("."), (bare == F.col("beside")) | F.startswith(F.col("target"), F.col("beside")))
        .when((F.col("language") == "ruby") & F.col("raw").rlike(r"/|^\."), bare == F.col("beside")).otherwise(False)
    )
    tier = F.col("tier") + F.when(near, 0).otherwise(1)
    best = Window.partitionBy("path", "line_no", "raw")
    return hits.withColumn("own", tier).withColumn("least", F.min("own").over(best)).where("own = least").select("path", "raw", "target")


def import_edges(files: DataFrame) -> DataFrame:
    """src, dst: resolved imports without self-imports, vendored files being left out on both sides."""
    own = files.where(~is_vendored(F.col("path")))
    return resolve(imports(own), own).where("path <> target").select(F.col("path").alias("src"), F.col("target").alias("dst"))


