"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words; repeats become maximal removal intervals.

A word goes if some window of its text covers it whose word sequence also starts in a document with a smaller id.
Windows are judged on the input. Hashes have 56 bits and the bucket number on top; at 10^10 windows a bucket layout of
thousands makes a chance repeat of one window about 10^-9.

Defined results: a null text has no words; a null id counts as larger than every id; rows that repeat an id are separate
documents none of which is smaller than the other; a text below ``width`` words is kept. Columns named in ``carry`` come
back untouched inside the struct ``carried``, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from hallwatch.llm import batches as B, words as W

WIDTH = 13
_LAST = np.iinfo(np.int64).max
_PACKED = "batch int, bucket int, keys binary, ids binary, runs binary"


def _repeats(table: pa.Table, width: int):
    """The windows of a batch: its words, which windows are sent (in order), and where every window finds its key."""
    ids = table.column("doc_id").fill_null(_LAST).to_numpy()
    data, offsets = W.text_bytes(table.column("text"))
    hashes, counts = W.hash_words(data, offsets)
    keys, first = W.windows(hashes, counts, width)
    of_text = ids[W.owners(counts)[first]]
    order, starts, run = B.same_keys(keys)
    leader = np.empty(len(keys), np.int64)
    leader[order] = order[starts][run] if len(keys) else order
    sent = np.flatnonzero(leader == np.arange(len(keys)))  # the first of equal windows, that of the smallest id here
    return data, offsets, counts, keys, first, of_text, leader, sent


def _send(width: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        _, _, _, keys, _, of_text, _, sent = _repeats(B.in_order(table, "doc_id", "text"), width)
        keys, of_text = keys[sent], of_text[sent]
        order, bounds = B.split(keys, buckets)
        rows = []
        for b in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[b]:bounds[b + 1]]
            ids = of_text[at]
            change = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            rows.append((batch, int(b), B.pack(keys[at]), ids[change].tobytes(), np.diff(np.r_[change, len(ids)]).astype(np.uint32).tobytes()))
        return _table(rows, ("batch", "bucket", "keys", "ids", "runs"), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))
    return send


def _table(rows: list[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


def _judge(table: pa.Table) -> pa.Table:
    """For every key that was sent: does it also start in a smaller document?"""
    packed = B.binaries(table, "keys")
    keys = np.concatenate([B.unpack(k) for k in packed])
    ids = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(r, np.uint32)) for i, r in zip(B.binaries(table, "ids"), B.binaries(table, "runs"))])
    order, starts, run = B.same_keys(keys)
    smallest = np.minimum.reduceat(ids[order], starts)
    repeated = np.empty(len(keys), bool)
    repeated[order] = ids[order] > smallest[run]
    bucket, rows, at = table.column("bucket")[0].as_py(), [], 0
    for batch, k in zip(table.column("batch").to_pylist(), packed):
        n = len(k) // B.KEY_BYTES
        if repeated[at:at + n].any():
            rows.append((batch, bucket, np.packbits(repeated[at:at + n]).tobytes()))
        at += n
    return _table(rows, ("batch", "bucket", "mask"), (pa.int32(), pa.int32(), pa.binary()))


def _joined(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Kept words of every text, one space between."""
    parts, lengths, at = [], [], 0
    for i, j in W.chunks(offsets):
        part = data[offsets[i]:offsets[j]]
        starts, ends, counts = W.spans(part, offsets[i:j + 1] - offsets[i])
        kept = keep[at:at + len(starts)]
        at += len(starts)
        text = W.owners(counts)[kept]
        starts, size = starts[kept], (ends - starts)[kept] + 1
        total = np.bincount(text, size, minlength=j - i).astype(np.int64)
        place = np.cumsum(size) - size
        index = np.repeat(starts - place, size)
        index += np.arange(len(index))
        out = np.append(part, np.uint8(32))[index]
        out[place + size - 1] = 32
        last = np.flatnonzero(np.r_[text[1:] != text[:-1], True]) if len(text) else np.zeros(0, np.int64)
        parts.append(np.delete(out, (place + size - 1)[last]))
        lengths.append(np.maximum(total - 1, 0))
    ends = np.concatenate([[0], *lengths]).cumsum().astype(np.int64)
    body = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(body.tobytes())).cast(pa.string())


def _remove(width: int, buckets: int, untouched: bool):
    def remove(docs: pa.Table, masks: pa.Table) -> pa.Table:
        docs = B.in_order(docs, "doc_id", "text") if len(docs) else docs
        data, offsets, counts, keys, first, of_text, leader, sent = _repeats(docs, width)
        order, bounds = B.split(keys[sent], buckets)
        known = np.zeros(len(keys), bool)  # at the windows that were sent
        for b, mask in zip(masks.column("bucket").to_pylist(), B.binaries(masks, "mask")):
            at = order[bounds[b]:bounds[b + 1]]
            known[sent[at]] = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(at)).astype(bool)
        repeated = known[leader] | (of_text > of_text[leader])
        n = int(counts.sum())
        steps = np.bincount(first[repeated], minlength=n + width + 1) - np.bincount(first[repeated] + width, minlength=n + width + 1)
        gone = np.cumsum(steps)[:n] > 0
        text = W.owners(counts)
        # maximal intervals of removed words, numbered within their text
        fresh = np.r_[True, (text[1:] != text[:-1]) | ~gone[:-1]] if n else np.zeros(0, bool)
        close = np.r_[(text[1:] != text[:-1]) | ~gone[1:], True] if n else np.zeros(0, bool)
        a, z = np.flatnonzero(gone & fresh), np.flatnonzero(gone & close) + 1
        base = (np.cumsum(counts) - counts)[text[a]]
        pairs = pa.StructArray.from_arrays([pa.array(a - base), pa.array(z - base)], names=["first", "last"])
        per_text = np.r_[0, np.cumsum(np.bincount(text[a], minlength=len(counts)))].astype(np.int32)
        n_removed, kept = np.bincount(text[gone], minlength=len(counts)).astype(np.int64), _joined(data, offsets, ~gone)
        if untouched:
            kept = pc.if_else(pa.array(n_removed == 0), docs.column("text"), kept)
        return pa.table({
            "doc_id": docs.column("doc_id"), "n_words": pa.array(counts.astype(np.int64)),
            "n_removed": pa.array(n_removed), "kept": kept, "removed": pa.ListArray.from_arrays(pa.array(per_text), pairs), "carried": docs.column("carried")})
    return remove


def remove_repeats(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = (), untouched: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (words left, one space between; with ``untouched`` a text that loses nothing
    stays as it is), ``removed`` (word intervals, end exclusive), ``carried``.

    Texts are shuffled once into batches; the same exchange serves both passes."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.struct(*[F.col(c) for c in carry] or [F.lit(None).cast("boolean").alias("none")]).alias("carried"))
    batches = B.batch_count(rows)
    rows = B.with_batch(rows, batches, F.struct("doc_id", F.length("text")))
    carried = rows.schema["carried"].dataType.simpleString()
    by_batch = rows.groupBy("batch")
    sent = by_batch.applyInArrow(_send(width, batches), _PACKED)
    masks = sent.groupBy("bucket").applyInArrow(_judge, "batch int, bucket int, mask binary")
    return by_batch.cogroup(masks.groupBy("batch")).applyInArrow(
        _remove(width, batches, untouched), f"doc_id long, n_words long, n_removed long, kept string, removed array<struct<first:bigint,last:bigint>>, carried {carried}")


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
spread AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM texts),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM texts WHERE len(words) >= 13),
windows_ AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS key FROM starts),
least_ AS (SELECT key, min(doc_id) AS m FROM windows_ GROUP BY key),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM windows_ JOIN least_ USING (key) WHERE m < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM spread ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)"""
