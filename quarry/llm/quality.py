"""Quality classifier by co-training of two views.

The content view is a logistic regression over hashed byte n-grams of the whole text and its layout (lines, words,
capitals, digits, marks); the metadata view one over what is known without reading it: source, declared language and
length. Over rounds each view labels the unlabelled rows it is surest of and the other view learns from them. Both views
are then calibrated together (Platt scaling of their margins on rows that neither learnt from), which scores all rows.

Labelled and unlabelled rows are fitted on bounded samples (fit_rows each); scoring covers every row and whole texts.

Defined results: null texts and texts without any word have score 0 and are not kept; null metadata is a value of its
own; labels with a null quality or without a document are ignored, repeated labels count once each; with labels of fewer
than two kinds all texts with a word are kept with score 1; repeated rows come back once each; empty in, empty out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm.arrowtext import _SPACE
from quarry.llm.language_id import held_out
from quarry.llm.textfeatures import bounded_sample, fitted, profiles, softmax_regression, unit

DIMS, META, LAYOUT, FIT_ROWS, ROUNDS, SURE = 2048, 64, 21, 2500, 3, 0.95
_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5


def metadata(source: str | None, lang: str | None, n: int) -> np.ndarray:
    """The metadata view of a page: its source, declared language and length; nothing that its text says."""
    x = np.zeros(META, np.float32)
    x[zlib.crc32(f"source {source}".encode()) % 32] = 0.3
    x[32 + zlib.crc32(f"lang {lang}".encode()) % 16] = 0.3
    x[48 + min(14, int(np.log2(n + 1)))] = 0.3
    x[63] = 1.0
    return x


def layout(raw: np.ndarray) -> np.ndarray:
    """Kinds of characters, lines, words and marks of a text."""
    x = np.zeros(LAYOUT, np.float32)
    n = len(raw)
    kinds = np.bincount(_KIND[raw], minlength=6)[1:] / max(1, n)
    lines, space = int((raw == 10).sum()) + 1, _SPACE[raw]
    words = int((~space[1:] & space[:-1]).sum()) + int(n > 0 and not space[0])
    x[:5] = 2 * np.sqrt(kinds)
    x[5:9] = np.log1p(lines) / 5, np.log1p(n / lines) / 8, np.log1p(n / max(1, words)) / 3, np.log1p(words / lines) / 5
    marks = np.bincount(raw[_KIND[raw] == 5], minlength=127)[33:127].astype(np.float32)
    if marks.sum():
        for j, c in enumerate((33, 35, 36, 37, 38, 42, 44, 46, 124, 64, 47, 58)):
            x[9 + j] = np.sqrt(marks[c - 33] / max(1, words))
    return x


def content(raw: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The content view: hashed byte n-grams of the whole text and its layout."""
    return np.concatenate([unit(counts), layout(raw)])


def _views(dims: int):
    def run(batches):
        for batch in batches:
            labels, source, lang = (batch.column(c).to_pylist() for c in ("label", "source", "lang"))
            fold = batch.column("fold").to_pylist()
            rows = [(labels[i], fold[i], content(raw, c).astype(np.float16).tobytes(), metadata(source[i], lang[i], len(raw)).tobytes()) for i, raw, c in profiles(batch.column("text"), dims) if not _SPACE[raw].all()]
            kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["label", "fold", "a", "b"])

    return run


def _chance(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = x @ (w[1, :-1] - w[0, :-1]) + w[1, -1] - w[0, -1]
    return z


class CoTrained:
    """Two views and the calibration that joins them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, y: np.ndarray, fold: np.ndarray, ua: np.ndarray, ub: np.ndarray, rounds: int = ROUNDS, sure: float = SURE):
        own = [(a[~fold], y[~fold]), (b[~fold], y[~fold])]
        pool, free = (ua, ub), np.ones(len(ua), bool)
        self.told = 0
        for turn in range(rounds + 1):
            self.w = [softmax_regression(x, t, 2) for x, t in own]
            if turn == rounds or not free.any():
                break
            goods = [1 / (1 + np.exp(-np.clip(_chance(w, x), -30, 30))) for w, x in zip(self.w, pool, strict=True)]
            for teacher, pupil in ((0, 1), (1, 0)):
                p = goods[teacher]
                most = max(1, int(free.sum()) // (2 * rounds))
                for kind, how in ((1, p), (0, 1 - p)):
                    pick = np.flatnonzero(free & (how >= sure))
                    share = max(1, int(most * (y == kind).mean()))
                    pick = pick[np.argsort(-how[pick], kind="stable")][:share]
                    own[pupil] = np.vstack([own[pupil][0], pool[pupil][pick]]), np.concatenate([own[pupil][1], np.full(len(pick), kind)])
                    free[pick] = False
                    self.told += len(pick)
        at = fold if len(set(y[fold])) == 2 else np.ones(len(y), bool)
        z = np.stack([_chance(self.w[0], a[at]), _chance(self.w[1], b[at])], 1)
        self.scale = np.maximum(np.abs(z).max(0), 1e-6)
        self.join = softmax_regression((z / self.scale).astype(np.float32), y[at], 2, rounds=2000, rate=10.0, decay=1e-4)

    def score(self, a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
        """Chance of good quality by content, by metadata and by both."""
        z = np.array([_chance(self.w[0], a), _chance(self.w[1], b)], float)
        both = _chance(self.join, z / self.scale)
        return tuple(float(1 / (1 + np.exp(-np.clip(v, -60, 60)))) for v in (*z, both))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, dims: int = DIMS) -> CoTrained | None:
    """Learns from docs(doc_id, text, lang, source) and labels(doc_id, quality); None if there is nothing to tell apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))
    marked = bounded_sample(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null"), fit_rows, F.col("doc_id"))
    known = docs.join(F.broadcast(marked), "doc_id").limit(4 * fit_rows)  # the broadcast side has 2 * fit_rows rows at most
    free = bounded_sample(docs.where("text is not null"), fit_rows, F.col("doc_id")).withColumn("label", F.lit(None).cast("int"))
    rows = known.select("text", "source", "lang", "label", held_out().alias("fold")).unionByName(free.select("text", "source", "lang", "label", F.lit(False).alias("fold"))).mapInArrow(_views(dims), "label int, fold boolean, a binary, b binary")
    return fitted(rows, _learn)


def _learn(rows: list[tuple]) -> CoTrained | None:
    told = [r for r in rows if r[0] is not None]
    if len({r[0] for r in told if not r[1]}) < 2:
        return None
    a, b, ua, ub = (np.stack([np.frombuffer(r[j], kind) for r in own]).astype(np.float32) if own else None for own in (told, [r for r in rows if r[0] is None]) for j, kind in ((2, np.float16), (3, np.float32)))
    if ua is None:
        ua, ub = a[:0], b[:0]
    return CoTrained(a, b, np.array([r[0] for r in told], int), np.array([r[1] for r in told], bool), ua, ub)


def score(docs: DataFrame, model: CoTrained | None, dims: int = DIMS, least: float = 0.5) -> DataFrame:
    """docs with content_score, metadata_score, quality_score and keep added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ["content_score", "metadata_score", "quality_score"]
    own = [c for c in docs.columns if c not in (*new, "keep")]
    docs = docs.select(own)

    def run(batches):
        for batch in batches:
            source, lang = (batch.column(c).to_pylist() for c in ("source", "lang"))
            out = []
            for i, raw, counts in profiles(batch.column("text").cast(pa.string()), dims):
                empty = bool(_SPACE[raw].all())
                out.append((0.0,) * 3 if empty else (1.0,) * 3 if shared.value is None else shared.value.score(content(raw, counts), metadata(source[i], lang[i], len(raw))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[j] for r in out], pa.float64()) for j in range(3))], names=[*own, *new])

    kinds = StructType([*docs.schema.fields, *(StructField(c, DoubleType()) for c in new)])
    return docs.mapInArrow(run, kinds).withColumn("keep", F.col("quality_score") >= least)


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, content_score, metadata_score, quality_score, keep for every row of docs."""
    model = fit(docs, labels)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))
    return score(docs, model).select("doc_id", "content_score", "metadata_score", "quality_score", "keep")
