"""Language ID by hierarchical discrimination.

A softmax regression over hashed byte n-grams of the whole text predicts the language family; inside a family, one linear
support vector machine for each pair of its languages votes, summed margins breaking ties. The score is the family's
probability times the winner's mean pairwise confidence.

The models learn from text and non-null lang of rows outside the held-out fold (crc32 of doc_id as text, modulo 5, is 0),
of which a bounded sample is fitted (fit_rows). lang, source and doc_id never enter a prediction.

Defined results: null texts and texts without a letter are `und` with score 0; a null doc_id counts as held out; repeated
rows come back once each; without any labelled row everything is `und`; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quarry.llm.textfeatures import bounded_sample, fitted, has_letter, linear_svm, profiles, softmax_regression, unit

#: Languages that are closely related; any other is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"], "romance": ["fr", "es", "it", "pt", "ro", "ca"], "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"],
}
DIMS, FIT_ROWS = 4096, 3000


def held_out(doc_id: str | Column = "doc_id", fold: int = 0) -> Column:
    """Whether crc32(doc_id as text) mod 5 is the fold; true for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % 5 == fold, F.lit(True))


def _vectors(dims: int):
    def run(batches):
        for batch in batches:
            labels, rows = batch.column("label").to_pylist(), []
            for i, raw, counts in profiles(batch.column("text"), dims):
                if has_letter(raw):
                    rows.append((labels[i], unit(counts).astype(np.float16).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["label", "x"])

    return run


class Model:
    def __init__(self, x: np.ndarray, labels: np.ndarray, families: dict[str, list[str]]):
        of = {lang: name for name, langs in families.items() for lang in langs}
        self.langs = sorted(set(labels))
        self.families = sorted({of.get(k, k) for k in self.langs})
        self.members = [[k for k in self.langs if of.get(k, k) == f] for f in self.families]
        family = np.array([self.families.index(of.get(k, k)) for k in labels], int)
        self.top = softmax_regression(x, family, len(self.families)) if len(self.families) > 1 else np.zeros((len(self.families), x.shape[1] + 1), np.float32)
        self.pairs: list[list[tuple[int, int]]] = []
        self.svm: list[np.ndarray] = []
        for langs in self.members:
            pairs, rows = list(itertools.combinations(range(len(langs)), 2)), []
            for a, b in pairs:
                pick = (labels == langs[a]) | (labels == langs[b])
                rows.append(linear_svm(x[pick], np.where(labels[pick] == langs[a], 1.0, -1.0)).astype(np.float32))
            self.pairs.append(pairs)
            self.svm.append(np.array(rows, np.float32).reshape(len(pairs), x.shape[1] + 1))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        z = self.top[:, :-1] @ x + self.top[:, -1]
        p = np.exp(z - z.max())
        p /= p.sum()
        f = int(p.argmax())
        langs, pairs = self.members[f], self.pairs[f]
        if len(langs) == 1:
            return langs[0], float(p[f])
        margins = self.svm[f][:, :-1] @ x + self.svm[f][:, -1]
        votes, total, sure = np.zeros(len(langs)), np.zeros(len(langs)), np.zeros(len(langs))
        for (a, b), m in zip(pairs, margins, strict=True):
            votes[a if m >= 0 else b] += 1
            for who, side in ((a, m), (b, -m)):
                total[who] += side
                sure[who] += 1 / (1 + np.exp(-4 * np.clip(side, -20, 20)))
        best = max(range(len(langs)), key=lambda i: (votes[i], total[i], -i))
        return langs[best], float(p[f] * sure[best] / (len(langs) - 1))


def fit(docs: DataFrame, families: dict[str, list[str]] = FAMILIES, fit_rows: int = FIT_ROWS, dims: int = DIMS) -> Model | None:
    """Learns from docs(doc_id, text, lang) outside the held-out fold; None without a usable row."""
    pool = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("label")).where("label is not null and text is not null").where(~held_out())
    rows = bounded_sample(pool, fit_rows, F.col("doc_id")).select("text", "label").mapInArrow(_vectors(dims), "label string, x binary")
    return fitted(rows, lambda own: Model(np.stack([np.frombuffer(x, np.float16) for _, x in own]).astype(np.float32), np.array([k for k, _ in own]), families) if own else None)


def predict(docs: DataFrame, model: Model | None, dims: int = DIMS) -> DataFrame:
    """docs with lang_pred and score added; text is the only column that a prediction reads."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(own)

    def run(batches):
        for batch in batches:
            names, scores = [], []
            for _, raw, counts in profiles(batch.column("text").cast(pa.string()), dims):
                lang, score = shared.value.predict(unit(counts)) if shared.value is not None and has_letter(raw) else ("und", 0.0)
                names.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*own, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang)."""
    model = fit(docs)
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
