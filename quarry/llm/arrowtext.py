"""Numpy views of Arrow string columns, and word shingles of whole texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once (arrays of some 100 bytes a byte of text); a longer text is a chunk of its own.
CHUNK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def tidy(run: Callable) -> Callable:
    """A function over Arrow batches after which the worker, which Spark keeps, gives free memory back."""

    @wraps(run)
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # no glibc
            pass

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK:
            _POWERS[base] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls are empty texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def chunks(at: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about size bytes; a longer text comes alone."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        yield first, last
        first = last


def words(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, number of words before each text): A-Z lower-cased, ASCII white space splits."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    ink = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[at] = True
    starts = ink.copy()
    starts[1:] &= ~ink[:-1] | edge[1:n]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, U)
    np.cumsum((_LOWER[raw].astype(U) + U(1)) * powers(BASE, n), out=sums[1:])
    h = (sums[e] - sums[s]) * powers(INVERSE, n)[s]
    return mix(h + (e - s).astype(U) * U(0xD6E8FEB86659FD93)), np.searchsorted(s, at).astype(np.int64)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingles) of every text; a text of fewer words is one shingle, one without words none."""
    at, raw = buffers(column)
    for first, last in chunks(at):
        own = at[first : last + 1] - at[first]
        w, before = words(own, raw[at[first] : at[last]])
        k = max(0, len(w) - width + 1)
        grams = np.zeros(k, U)
        for i in range(width):
            grams = grams * U(0x2545F4914F6CDD1D) + w[i : i + k]
        grams = mix(grams ^ U(width))
        for i in range(last - first):
            a, b = before[i], before[i + 1]
            if b - a >= width:
                yield first + i, np.unique(grams[a : b - width + 1])
            elif b > a:
                h = U(0)
                for x in w[a:b]:
                    h = np.asarray([h], U) * U(0x2545F4914F6CDD1D) + x
                    h = h[0]
                yield first + i, mix(np.asarray([h], U) ^ U(1000 + b - a))
            else:
                yield first + i, np.zeros(0, U)
