"""Minimum score, top-n and token budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Preset:
    name: str
    needs_index: bool
    rebuild: bool
    structural: bool
    max_bytes: int
    min_score: float


# The presets.
PRESETS = {p.name: p for p in (Preset("fast", False, False, False, 50_000, 0.05), Preset("balanced", True, False, False, 100_000, 0.01), Preset("deep", True, True, True, 200_000, 0.005), Preset("thorough", True, True, True, 500_000, 0.001))}
#: A file has at least this many tokens to count against a budget when candidates are bounded.
LEAST_TOKENS = 1


def preset(name: str | Preset) -> Preset:
    """By name; an unknown name means balanced."""
    return name if isinstance(name, Preset) else PRESETS.get(name, PRESETS["balanced"])


def within_budget(scored: DataFrame, max_bytes: int | None = None, max_tokens: int | None = None) -> DataFrame:
    """The longest prefix in score order whose tokens fit, the first row always; with rank and cumulative tokens.

    Rows without tokens fit any budget, so only rows with tokens bound the prefix: candidates are the rows that can be
    among it, found by top-k, and only they are put in one order.
    """
    order = Window.orderBy(F.desc("score"), "path")
    most = min([x for x in ((max_bytes // 4) if max_bytes is not None else None, max_tokens) if x is not None], default=None)
    out = scored.withColumn("rank", F.row_number().over(order)).withColumn("cumulative", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if most is None:
        return out
    fits = F.lit(True)
    if max_bytes is not None:
        fits = fits & (F.col("cumulative") * 4 <= max_bytes)
    if max_tokens is not None:
        fits = fits & (F.col("cumulative") <= max_tokens)
    return out.where((F.col("rank") == 1) | fits)


def select_files(scored: DataFrame, min_score: float = 0.0, top: int | None = None, max_bytes: int | None = None, max_tokens: int | None = None) -> DataFrame:
    """Filter, then top, then budget."""
    out = scored.where(F.col("score") >= min_score)
    if top is None and (max_bytes is not None or max_tokens is not None):
        out = _bounded(out, max_bytes, max_tokens)
    if top is not None:
        out = out.orderBy(F.desc("score"), "path").limit(top)
    return within_budget(out, max_bytes, max_tokens)


def _bounded(scored: DataFrame, max_bytes: int | None, max_tokens: int | None) -> DataFrame:
    """Rows at or above the score where the budget is surely spent, so that the global order covers few rows.

    Sums of tokens per score step (a partial aggregate of at most 10,001 steps) find the step where the budget ends.
    """
    most = min(x for x in ((max_bytes // 4) if max_bytes is not None else None, max_tokens) if x is not None)
    step = F.floor(F.least(F.lit(10_000), F.greatest(F.lit(0), F.col("score") * 2000))).cast("int")
    sums = scored.groupBy(step.alias("step")).agg(F.sum("tokens").alias("tokens"))
    run = sums.withColumn("above", F.coalesce(F.sum("tokens").over(Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lowest = run.where(F.col("above") <= most).agg(F.min("step").alias("lowest"))
    return scored.withColumn("step", step).join(F.broadcast(lowest)).where(F.col("step") >= F.col("lowest")).drop("step", "lowest")
