"""Hashed byte n-gram profiles of whole texts, and small linear models on them, in numpy."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrowtext import _LOWER, _SPACE, buffers, chunks, tidy

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def has_letter(raw: np.ndarray) -> bool:
    """Whether a UTF-8 text holds a letter of any script."""
    if _ASCII_LETTER[raw].any():
        return True
    return bool((raw >= 128).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "ignore"))


def profiles(column: pa.Array, dims: int):
    """(row, bytes, n-gram counts) of every text: 2- and 3-byte grams of A-Z-lowered text, hashed to `dims` (a power of 2)."""
    at, raw = buffers(column)
    shift = np.uint32(32 - dims.bit_length() + 1)
    for first, last in chunks(at):
        base, own = at[first], raw[at[first] : at[last]]
        low = _LOWER[own].astype(np.uint32)
        low[_SPACE[own]] = 32
        two = low[:-1] | low[1:] << 8 if len(low) > 1 else low[:0]
        three = two[:-1] | low[2:] << 16 if len(low) > 2 else low[:0]
        h2 = ((two + np.uint32(0x1000193)) * np.uint32(0x9E3779B1) >> shift).astype(np.int32)
        h3 = ((three ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) >> shift).astype(np.int32)
        for i in range(first, last):
            a, b = at[i] - base, at[i + 1] - base
            counts = np.bincount(h2[a : max(a, b - 1)], minlength=dims) + np.bincount(h3[a : max(a, b - 2)], minlength=dims)
            yield i, own[a:b], counts


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots, scaled to length 1: long and short texts weigh alike."""
    x = np.sqrt(counts.astype(np.float32))
    norm = np.sqrt((x * x).sum(-1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def bounded_sample(df: DataFrame, rows: int, *key: Column) -> DataFrame:
    """About `rows` rows chosen by a hash of key, and never more than twice as many."""
    n = df.count()
    share = min(1.0, rows / max(1, n))
    return df.where(F.pmod(F.xxhash64(*key, F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0)).limit(2 * rows)


def fitted(rows: DataFrame, learn):
    """learn(rows as a list) of a bounded sample, run in one task and not on the driver; None without rows.

    The rows come in an order of their own, whichever tasks they come from.
    """

    def run(batches):
        own = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        own.sort(key=lambda r: tuple((v is not None, v) if v is not None else (False, 0) for v in r))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(own), 5)], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(tidy(run), "model binary").collect()  # one row: the model
    return pickle.loads(found[0].model) if found else None


def softmax_regression(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, rate: float = 20.0, decay: float = 1e-5, weight: np.ndarray | None = None) -> np.ndarray:
    """(classes, dims + 1) weights by full-batch gradient descent with momentum; the classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    goal = np.eye(classes, dtype=np.float32)[y]
    each = (1 / (classes * np.maximum(goal.sum(0), 1)))[y] if weight is None else weight / weight.sum()
    w, speed = np.zeros((classes, x.shape[1]), np.float32), 0
    for _ in range(rounds):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - rate * (((p - goal) * each[:, None]).T @ x + decay * w).astype(np.float32) * 0.1
        w = w + speed
    return w


def linear_svm(x: np.ndarray, y: np.ndarray, rounds: int = 400, cost: float = 300.0) -> np.ndarray:
    """(dims + 1) weights of a two-class machine, y in -1, 1: squared hinge, accelerated gradient descent; the classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1 / (1 + 4 * cost)
    w = last = np.zeros(x.shape[1])
    for i in range(rounds):
        ahead = w + i / (i + 3) * (w - last)
        gap = np.maximum(0, 1 - y * (x @ ahead))
        last, w = w, ahead - step * (ahead - 2 * cost * ((each * gap * y) @ x))
    return w
