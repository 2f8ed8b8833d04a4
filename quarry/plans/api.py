"""The query API: index, query, quick, explain, inspect, describe, render."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.classify import extension, is_vendored
from quarry.operators.chunks import chunks
from quarry.operators.graph import normalised, pagerank
from quarry.operators.imports import import_edges
from quarry.operators.index import Index
from quarry.operators.rendering import compact, human, json_object, jsonl
from quarry.operators.scoring import RRF_K, fuse_scored, hybrid
from quarry.operators.selection import PRESETS, Preset, preset, select_files
from quarry.operators.usage import inspect_index, language_counts


def build_index(files: DataFrame, existing: Index | None = None, rounds: int | None = None) -> Index:
    own = files.where("content is not null")
    nodes = own.where(~is_vendored(F.col("path"))).select("path")
    return Index.build(own, normalised(pagerank(import_edges(own), nodes, rounds)), existing)


def score_files(files: DataFrame, task: str, how: Preset, ranks: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """files with their scores, exact where they are at least `least`."""
    scored = hybrid(files, task)
    if how.structural and ranks is not None:
        reach = max(1, math.ceil(2 / least) - RRF_K + 1) if least > 0 else None
        scored = fuse_scored(scored, ranks, "pagerank", candidates=reach)
    return scored


def query(files: DataFrame, task: str, preset_name: str = "balanced", index: Index | None = None, top: int | None = None, max_bytes: int | None = None, max_tokens: int | None = None, min_score: float | None = None) -> DataFrame:
    """The files that serve a task best, within the budget: path, language, role, tokens, scores, rank."""
    how = preset(preset_name)
    least = how.min_score if min_score is None else min_score
    scored = score_files(files, task, how, index.pagerank if index else None, least)
    return select_files(scored, least, top, how.max_bytes if max_bytes is None else max_bytes, max_tokens)


def quick(files: DataFrame, task: str, preset_name: str = "balanced", **options) -> DataFrame:
    """Index if the preset needs one, then query."""
    how = preset(preset_name)
    return query(files, task, preset_name, build_index(files) if how.structural else None, **options)


def explain(files: DataFrame, task: str, top: int = 10, preset_name: str = "balanced", index: Index | None = None) -> DataFrame:
    """The parts of the best scores; no minimum, no budget."""
    least = 1 / (RRF_K + max(1, top))  # the fused score of the top rows is no less
    return score_files(files, task, preset(preset_name), index.pagerank if index else None, least).orderBy(F.desc("score"), "path").limit(top)


def inspect(files: DataFrame, index: Index | None) -> tuple[DataFrame, DataFrame]:
    if index is None:
        raise ValueError("no index: build one first")
    return inspect_index(index.docs, chunks(files), index.postings), language_counts(files.select(extension(F.col("path")).alias("extension")))


def describe() -> dict:
    """What this engine can do, for programs."""
    return {"commands": ["index", "query", "quick", "render", "explain", "inspect", "describe"], "presets": sorted(PRESETS), "formats": ["jsonl", "json", "compact", "human"], "signals": ["bm25f", "heuristic", "pagerank", "recency", "embedding"]}


def render(selected: DataFrame, fmt: str, task: str = "", preset_name: str = "balanced", scanned: DataFrame | None = None) -> DataFrame:
    how = preset(preset_name)
    if fmt == "jsonl":
        return jsonl(selected, task, how.name, how.min_score, scanned if scanned is not None else selected, how.max_bytes)
    return {"json": lambda: json_object(selected, task, how.name), "compact": lambda: compact(selected), "human": lambda: human(selected)}[fmt]()
