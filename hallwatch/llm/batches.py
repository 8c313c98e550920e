"""Texts in batches, their keys in buckets, and back.

Three operators need a statistic of every window or word of every text (how often, in which smallest document).
A row per window would cost several times its eight bytes in a shuffle, so keys travel packed: texts are dealt into
batches of some megabytes, every batch sends each bucket one row with its keys that fall there (each distinct key once:
a key that a third of all documents hold costs one entry per batch), and the bucket answers with one row per batch.
The batch finds its keys again by repeating the deterministic first step on the same rows.

Sizes follow the input: a batch holds about ``BATCH_BYTES`` of text and a bucket about as many keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

BATCH_BYTES, LEAST_BATCHES = 8 << 20, 8
KEY_BYTES = 7  # the bucket number adds the bits that the eighth byte would have


def batch_count(docs: DataFrame, text: str = "text") -> int:
    """Of batches and of buckets; it grows with the texts, not with the cluster, as every batch sends every bucket a row."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(LEAST_BATCHES, -(-int(size) // BATCH_BYTES))


def with_batch(docs: DataFrame, batches: int, key: Column) -> DataFrame:
    return docs.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))


def in_order(table: pa.Table, *keys: str) -> pa.Table:
    """Rows of a batch in an order that does not depend on how they arrived."""
    return table.take(pc.sort_indices(table, sort_keys=[(k, "ascending") for k in keys]))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """From the top byte, which is not sent, and the bits below it."""
    high = (keys >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    return (high % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys by bucket, first position of each bucket)."""
    where = bucket_of(keys, buckets)
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(buckets + 1))


def pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel()


def binaries(table: pa.Table, column: str) -> list[bytes]:
    return table.column(column).to_pylist()


def same_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start of each run of equal keys in that order, run of each entry in that order)."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1
