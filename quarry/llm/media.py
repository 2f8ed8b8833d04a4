"""Media columns: texts as payload of progressive JPEG files, read back and decoded to RGB tensors.

Defined results: null is the empty text, which is a payload of 64 zero bytes; equal texts give equal values; rows come
back once each, whatever their doc_id (null too); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrowtext import buffers
from quarry.llm.progressive_jpeg import decode, encode_bytes, rgb, stored_bytes

DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Bytes of payload or tensors that are gathered before a batch leaves the worker.
FLUSH = 16 << 20


def padded(text: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def feature(tensor) -> str:
    """Size, mean of each channel in thousandths (whole-number arithmetic) and a checksum of all samples."""
    h, w, _ = tensor.shape
    means = [int(tensor[:, :, c].sum()) * 1000 // (h * w) for c in range(3)]
    return f"{w}x{h}:{means[0]},{means[1]},{means[2]}:{zlib.crc32(tensor):08x}"


def media_column(docs: DataFrame, tensors: bool = True) -> DataFrame:
    """doc_id, media (the JPEG file), n_bytes, height, width and rgb (height * width * 3 samples) of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            at, raw = buffers(batch.column("text"))
            rows, size = [], 0
            for i, doc_id in enumerate(batch.column("doc_id")):
                text = raw[at[i] : at[i + 1]].tobytes()
                media = encode_bytes(padded(text))
                tensor = rgb(decode(media)) if tensors else None
                h, w = tensor.shape[:2] if tensors else (None, None)
                rows.append((doc_id.as_py(), media, len(text), h, w, tensor.tobytes() if tensors else None))
                size += len(media) + (tensor.nbytes if tensors else 0)
                if size > FLUSH:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows):
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "media", "n_bytes", "height", "width", "rgb"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, media binary, n_bytes long, height int, width int, rgb binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """What media_column stores, read back: sizes, hashes of the recovered payload, and a feature of the decoded tensor."""

    def run(batches):
        for batch in batches:
            at, raw = buffers(batch.column("text"))
            out = [[] for _ in range(7)]
            for i in range(len(at) - 1):
                text = raw[at[i] : at[i + 1]].tobytes()
                want = len(text) + 64 - len(text) % 64 if len(text) % 64 or not text else len(text)
                media = encode_bytes(padded(text))
                image = decode(media)
                payload = stored_bytes(image, want)
                values = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(rgb(image)))
                for x, v in zip(out, values, strict=True):
                    x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", *names])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, DIGEST)
