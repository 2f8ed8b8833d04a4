"""Mixing sources to target weights by Pfair scheduling.

A source of weight w owes its j-th block (j = 0, 1, ...) a slot in the window from release floor(j / w) to deadline
ceil((j + 1) / w). Earliest deadline first over the released blocks then keeps every source less than one block from its
share at every moment. Weights are exact fractions, windows whole numbers made from them: nothing is rounded to a period,
and the bound holds at any length. The schedule is one pass over the blocks (not the rows) in one task, which holds one
entry for each source and skips idle slots; it is dealt to the rows' buckets as short arrays. Besides it only each
document's place in its source is needed, which is counted over bounded buckets of a hash order: a source with a third of
all rows is many buckets, and no task sees a whole source.

Defined results: every row comes back once, repeated rows too; a null or empty source is the source ''; sources missing
from given weights share the weight of the lane '*', each with its own part by number of documents and its own deadlines;
sources without a positive weight come after all others; a source that ends leaves its slots idle, the others' windows
stay; a null doc_id is ordered like any other value; empty in, empty out.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIOD, BLOCK_DOCS, BUCKET_ROWS = 1000, 16, 4096
#: Without given weights: shares of the number of documents to this power (small sources gain).
TEMPERATURE = 0.7
REST = "*"


def quantised(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots of a period by largest remainder; every source has one at least."""
    total, names = math.fsum(weights.values()), sorted(weights)
    if not names:
        return {}
    if len(names) > period:
        raise ValueError("more sources than slots in a period")
    exact = {k: weights[k] / total * period if total > 0 else period / len(names) for k in names}
    slots = {k: max(1, int(exact[k])) for k in names}
    while sum(slots.values()) < period:
        k = max(names, key=lambda k: (exact[k] - slots[k], k))
        slots[k] += 1
    while sum(slots.values()) > period:
        k = max((k for k in names if slots[k] > 1), key=lambda k: (slots[k] - exact[k], k))
        slots[k] -= 1
    return slots


def deal(lanes: list[tuple[float, int]]) -> Iterator[tuple[int, int, int]]:
    """slot, lane, block of lanes (weight, blocks), in order of slots: earliest deadline first among released blocks."""
    positive = any(w > 0 for w, _ in lanes)
    exact = [Fraction(max(w, 0)) if positive else Fraction(1) for w, _ in lanes]
    scale = math.lcm(*(w.denominator for w in exact))
    own = [int(w * scale) for w in exact]
    total, slot = sum(own), 0
    waiting = [(0, i, 0) for i, (_, n) in enumerate(lanes) if n > 0 and own[i]]  # release, lane, block
    ready: list[tuple[int, int, int]] = []
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // own[i]), i, j))
        deadline, i, j = heapq.heappop(ready)
        assert slot < deadline, "a deadline was missed"
        yield slot, i, j
        slot += 1
        if j + 1 < lanes[i][1]:
            heapq.heappush(waiting, ((j + 1) * total // own[i], i, j + 1))
    late = [i for i, (_, n) in enumerate(lanes) if n > 0 and not own[i]]
    for at, k, j in deal([(1, lanes[i][1]) for i in late]) if late else ():
        yield slot + at, late[k], j


def schedule(slots: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of whole weights."""
    names, out = sorted(slots), {k: [] for k in slots}
    for t, i, _ in deal([(slots[k], slots[k]) for k in names]):
        out[names[i]].append(t)
    return out


def target_weights(sizes: dict[str, int], weights: dict[str, float] | None) -> dict[str, float | Fraction]:
    """The weight of every source: given, or by its number of documents; what is not given shares one weight."""
    own = {k: n**TEMPERATURE for k, n in sizes.items()}
    if weights is None:
        return own
    rest = [k for k in sizes if k not in weights]
    total, least = sum(Fraction(own[k]) for k in rest), Fraction(min(weights.values(), default=1.0))
    return weights | {k: least * Fraction(own[k]) / total for k in rest}


def _slots(weights: dict[str, float] | None, block_docs: int):
    """mix_source, block, slot of all sources' sizes, in bounded batches."""

    def run(batches):
        sizes = {k: n for batch in batches for k, n in zip(batch["mix_source"].tolist(), batch["n"].tolist(), strict=True)}
        targets = target_weights(sizes, weights)
        names = sorted(targets)  # sources without rows keep their share of the slots
        dealt = deal([(targets[k], -(-sizes.get(k, 0) // block_docs)) for k in names])
        while rows := list(itertools.islice(dealt, 10_000)):
            yield pd.DataFrame({"mix_source": [names[i] for _, i, _ in rows], "block": [j for _, _, j in rows], "slot": [t for t, _, _ in rows]})

    return run


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id") -> DataFrame:
    """docs with mix_lane, mix_position (place in the source), mix_block and mix_slot added; order by mix_slot, mix_position.

    All columns of docs are kept; those of the new names are replaced. period has no effect any more:
    no weight is rounded to it and it bounds no number of sources.
    """
    new = ["mix_lane", "mix_position", "mix_block", "mix_slot"]
    docs = docs.drop(*new)
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    named = docs.withColumn("mix_source", source)
    sizes = named.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n"))
    slots = sizes.repartition(1).mapInPandas(_slots(weights, block_docs), "mix_source string, block long, slot long")

    # only sources of more than a bucket are many buckets: at most a row for each BUCKET_ROWS documents
    large = sizes.where(F.col("n") > BUCKET_ROWS).select("mix_source", F.ceil(F.col("n") / BUCKET_ROWS).alias("mix_buckets"))
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit(5))
    dealt = named.join(F.broadcast(large), "mix_source", "left").withColumn("mix_hash", h).withColumn("mix_bucket", F.coalesce(F.pmod("mix_hash", "mix_buckets"), F.lit(0)).cast("int"))
    before = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("mix_source", "mix_bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = starts.select("mix_source", "mix_bucket", "start", F.explode(F.sequence(F.floor(F.col("start") / block_docs), F.floor((F.col("start") + F.col("n") - 1) / block_docs))).alias("block"))
    places = own.join(slots, ["mix_source", "block"]).groupBy("mix_source", "mix_bucket").agg(F.min("start").alias("mix_start"), F.array_sort(F.collect_list(F.struct("block", "slot"))).alias("mix_places"))
    inside = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_hash", id_col)
    placed = dealt.withColumn("mix_rn", F.row_number().over(inside) - 1).join(places, ["mix_source", "mix_bucket"])
    placed = placed.withColumn("mix_position", (F.col("mix_start") + F.col("mix_rn")).cast("long")).withColumn("mix_block", F.floor(F.col("mix_position") / block_docs))
    slot = F.get("mix_places", (F.col("mix_block") - F.floor(F.col("mix_start") / block_docs)).cast("int")).getField("slot")
    lane = F.col("mix_source") if weights is None else F.when(F.col("mix_source").isin(sorted(weights)), F.col("mix_source")).otherwise(F.lit(REST))
    return placed.withColumn("mix_slot", slot).withColumn("mix_lane", lane).select(*docs.columns, *new)


def in_mix_order(docs: DataFrame, **options) -> DataFrame:
    """docs, sorted so that reading on is reading the mixture."""
    return mix_sources(docs, **options).repartitionByRange("mix_slot", "mix_position").sortWithinPartitions("mix_slot", "mix_position").select(docs.columns)
