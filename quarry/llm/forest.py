"""Approximate nearest neighbours by inner product: a hash-prefix forest over row blocks.

Each block of rows holds, per tree, the sorted array of its rows' 64-bit hash strings (signs of random projections). A
query descends every tree to its longest matching prefix, and then all trees ascend in step: the prefix length that counts
is the same in all of them and shortens until together they meet the wanted number of rows. How long a prefix that leaves
differs from query to query. Candidates are scored exactly in double precision on the original vectors; the best of all
blocks are merged.

Inner products become angles by one more dimension, sqrt(M^2 - |x|^2), M being the largest norm. How many rows are wanted
is measured, not guessed: a bounded sample of queries is held against brute force over all rows, and the number doubles
until the sample's recall reaches `recall`. Every distinct vector is indexed, every query sees every block.

Copies have one score and ties go to the smaller vec_id, so a vector is indexed once, with the k + 1 smallest of its
vec_ids (one may be the query's own) and how often each comes, and is expanded after the search: exact for any number of
copies. Distinct vectors of one hash string in a tree are one place, taken as a whole.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, neither does a
null vec_id; a query sees rows of its own length only; rows with the query's vec_id are never its neighbours; other
repeated rows each count; ties go to the smaller vec_id; with fewer candidates all are returned; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.scratch import Scratch

TREES, BITS = 64, 64
#: Rows that all trees of a block together meet at least, at first.
WANTED = 32 * TREES
#: Rows of a block, queries of a task, and queries that the depth is measured on.
BLOCK_ROWS, BLOCK_QUERIES, MEASURED = 16384, 16384, 96


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(good).where(fine)


def projections(dim: int, tree: int) -> np.ndarray:
    return np.random.default_rng([7, dim, tree]).normal(size=(dim, BITS))


def strings(x: np.ndarray, tree: int) -> np.ndarray:
    """The hash strings of augmented rows in one tree, the first bit being the most significant."""
    bits = x @ projections(x.shape[1], tree) > 0
    return np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64)


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """v, members array<struct<vec_id, n>> of rows(vec_id, v): the k + 1 smallest vec_ids of each vector, n at most k."""
    counted = rows.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    first = counted.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("rn") <= k + 1)
    return first.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("members"))


class Forest:
    def __init__(self, members: list, rows: np.ndarray, largest: float, trees: int = TREES):
        self.rows = rows
        self.members = [(np.array([m["vec_id"] for m in own], np.int64), np.array([m["n"] for m in own], np.int64)) for own in members]
        self.single = np.array([len(ids) == 1 for ids, _ in self.members], bool)
        self.plain = self.single & np.array([n[0] == 1 for _, n in self.members], bool)
        self.ids = np.array([ids[0] for ids, _ in self.members], np.int64)
        self.next = np.array([ids[-1] if len(ids) == 1 else ids[1] for ids, _ in self.members], np.int64)
        more = np.sqrt(np.maximum(largest**2 - (rows * rows).sum(1), 0))
        full = np.hstack([rows, more[:, None]])
        self.trees = []
        for t in range(trees):
            s = strings(full, t)
            order = np.argsort(s, kind="stable")
            keys, starts = np.unique(s[order], return_index=True)
            self.trees.append((keys, np.append(starts, len(order)), order))

    def candidates(self, queries: np.ndarray, wanted: int) -> np.ndarray:
        """For each query a mark on the rows that share with it, in some tree, a prefix of the length at which all trees
        together first meet `wanted` rows (each tree counts its own)."""
        full = np.hstack([queries, np.zeros((len(queries), 1))])
        own = [strings(full, t) for t in range(len(self.trees))]
        # synchronous ascent: the longest prefix length that meets enough, the same in all trees; found by bisection
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), BITS)
        while (low < high).any():
            mid = (low + high + 1) // 2
            met = sum(np.diff(self._range(t, own[t], mid), axis=0)[0] for t in range(len(own)))
            low, high = np.where(met >= wanted, mid, low), np.where(met >= wanted, high, mid - 1)
        marks = np.zeros((len(queries), len(self.ids)), bool)
        for t, (_, _, order) in enumerate(self.trees):
            first, last = self._range(t, own[t], low)
            for mark, i, j in zip(marks, first.tolist(), last.tolist(), strict=True):
                mark[order[i:j]] = True
        return marks

    def _range(self, t: int, own: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(first, last) places in a tree's order of the rows that share the first `length` bits with each string."""
        keys, starts, _ = self.trees[t]
        free = np.where(length > 0, np.left_shift(np.uint64(1), (BITS - np.maximum(length, 1)).astype(np.uint64)) - np.uint64(1), np.uint64(2**64 - 1))
        return np.stack([starts[np.searchsorted(keys, own & ~free)], starts[np.searchsorted(keys, own | free, side="right")]])

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int, wanted: int):
        for first in range(0, len(ids), 256):
            for i, mark in enumerate(self.candidates(queries[first : first + 256], wanted), first):
                yield ids[i], *self._best(np.flatnonzero(mark), ids[i], queries[i], k)

    def _best(self, c: np.ndarray, own: int, query: np.ndarray, k: int):
        """The k best members, without the query's own, of the vectors c."""
        c = c[~(self.single[c] & (self.ids[c] == own))]
        score = self.rows[c] @ query
        if len(c) > k:
            c, score = (x[score >= np.partition(score, len(score) - k)[len(score) - k]] for x in (c, score))
        least = np.where(self.ids[c] == own, self.next[c], self.ids[c])
        best = np.lexsort((least, -score))[:k]
        c, score, least = c[best], score[best], least[best]
        if self.plain[c].all():
            return least, score
        told = [(m[m != own], n[m != own]) for m, n in (self.members[j] for j in c)]
        ids = [np.repeat(m, n)[:k] for m, n in told]
        ids, score = np.concatenate(ids), np.repeat(score, [len(m) for m in ids])
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]

    def all(self, ids: np.ndarray, queries: np.ndarray, k: int):
        """Brute force, for the sample that the depth is measured on."""
        for own, query in zip(ids, queries, strict=True):
            yield own, *self._best(np.arange(len(self.ids)), own, query, k)


def _hits(k: int, wanted: int, largest: float, exact: bool):
    """Answers of one (row block, query block) pair."""

    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        members, x = rows["members"].tolist(), np.stack(rows["v"].to_numpy())
        qid, q = queries["vec_id"].to_numpy(np.int64), np.stack(queries["v"].to_numpy())
        forest = Forest(members, x, largest, 0 if exact else TREES)
        out = list(forest.nearest(qid, q, k, wanted) if not exact else forest.all(qid, q, k))
        return pd.DataFrame({"query_id": np.repeat([o[0] for o in out], [len(o[1]) for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    return run


def _search(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, k: int, wanted: int, largest: float, exact: bool = False) -> DataFrame:
    blocks, parts = -(-n_rows // BLOCK_ROWS), max(1, -(-n_queries // BLOCK_QUERIES))
    wide = F.size("v").alias("dim")
    x = rows.select("members", "v", wide, F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    q = queries.select("vec_id", "v", wide, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int").alias("part"))
    hits = x.groupBy("dim", "block", "part").cogroup(q.groupBy("dim", "block", "part")).applyInPandas(_hits(k, wanted, largest, exact), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def hash_prefix_forest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.96, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors found nearest to each row of queries."""
    rows, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col).dropDuplicates(["vec_id"])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = Scratch(rows.sparkSession, "forest").keep(distinct(rows, k))  # read by every measured depth
    n_rows, largest = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    n_queries = asked.count()
    if not n_rows or not n_queries:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    sample = asked.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(MEASURED)
    best = {(r.query_id, r.vec_id) for r in _search(rows, sample, n_rows, MEASURED, k, 0, largest, exact=True).collect()}  # MEASURED * k rows
    wanted = WANTED
    while wanted < BLOCK_ROWS * TREES and best:
        got = {(r.query_id, r.vec_id) for r in _search(rows, sample, n_rows, MEASURED, k, wanted, largest).collect()}
        if len(got & best) >= recall * len(best):
            break
        wanted *= 2
    return _search(rows, asked, n_rows, n_queries, k, wanted, largest)
