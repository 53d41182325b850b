"""Distributed census of 64-bit hashes: in how many documents of the corpus does each occur?

Texts are dealt into chunks of bounded size by a hash of doc_id.  A chunk sends
its distinct hashes, packed into five bytes each with a byte for the number of its
documents (255 stands for more), to buckets; a bucket adds up the documents of each
hash and replies to each chunk one byte per hash, in the order sent.  The byte
is 1 for one document and grows by 8 for every doubling, so any number fits
and orders hashes alike everywhere.  The shuffle moves packed arrays, not a row
per word, and a hash that stands in a third of all documents costs one entry
per chunk.  The number of chunks and buckets grows with the corpus, so each task's
share stays the same; a message shrinks as buckets become more, and
near 10^5 chunks (about a terabyte) it holds a few hashes only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, partitions

CHUNK_BYTES = 6_000_000
BUCKET_BYTES = 4_000_000
MISSING = (1 << 63) - 1


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """(docs with `chunk`, dealt out by it; number of partitions; number of buckets)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // chunk_bytes))
    parts = max(n, partitions(docs.sparkSession))
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n))).repartition(parts, "chunk"), parts, max(4, -(-size // BUCKET_BYTES))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def code(documents: int) -> int:
    """The reply that stands for a number of documents."""
    return int(_codes(np.array([documents]))[0])


def _codes(n: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(8 * np.log2(np.maximum(n, 1))), 255).astype(np.uint8)


def send(chunk: int, h: np.ndarray, documents: np.ndarray, buckets: int) -> dict[str, list]:
    """Rows (chunk, bucket, data) for sorted distinct hashes and the number of documents of each; inside a bucket the order of `h` is kept."""
    b = bucket_of(h, buckets)
    order = np.argsort(b, kind="stable")
    packed, n = h[order].view(np.uint8).reshape(-1, 8)[:, :5], np.minimum(documents, 255).astype(np.uint8)[order]
    cut = np.searchsorted(b[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cut))
    return {"chunk": [chunk] * len(some), "bucket": some.tolist(), "data": [packed[cut[i] : cut[i + 1]].tobytes() + n[cut[i] : cut[i + 1]].tobytes() for i in some]}


SENT = "chunk bigint, bucket bigint, data binary"
_SENT = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])


def sent_table(rows: dict[str, list]) -> pa.Table:
    return pa.table(rows, schema=_SENT)


def _count(t: pa.Table) -> pa.Table:
    data = t["data"].to_pylist()
    sizes = [len(d) // 6 for d in data]
    raw = np.zeros((sum(sizes), 8), np.uint8)
    raw[:, :5] = np.frombuffer(b"".join(d[: 5 * n] for d, n in zip(data, sizes)), np.uint8).reshape(-1, 5)
    documents = np.frombuffer(b"".join(d[5 * n :] for d, n in zip(data, sizes)), np.uint8)
    _, at = np.unique(raw.view(np.uint64).ravel(), return_inverse=True)
    reply, to = _codes(np.bincount(at, documents))[at], np.cumsum([0, *sizes])
    return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "data": [reply[a:b].tobytes() for a, b in zip(to, to[1:])]}, schema=_SENT)


def count_documents(sent: DataFrame) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(lean(_count), SENT)


def read_replies(rows: dict[int, bytes], h: np.ndarray, buckets: int) -> np.ndarray:
    """The codes of the hashes that this chunk sent."""
    b = bucket_of(h, buckets)
    order = np.argsort(b, kind="stable")
    out = np.empty(len(h), np.uint8)
    out[order] = np.frombuffer(b"".join(rows[i] for i in sorted(rows)), np.uint8)
    return out


def texts_of(t: pa.Table) -> list[bytes | None]:
    return t["text"].cast(pa.large_binary()).to_pylist()
