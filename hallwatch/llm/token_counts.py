"""Token counts by a map-side look-up in two tiers; no pre-token is ever shuffled.

A pre-token is a run of white space marks and what follows up to the next one, or a line end and what follows. No piece of
the vocabulary crosses such a border (checked when the model is read), so no merge does, and the tokens of a text are the
sum over its pre-tokens.

Tier one is a compact hash table (open addressing, 64-bit hashes and lengths) of the pre-tokens that are frequent in the
whole corpus: every task of a first pass keeps ``FREQUENT`` counters by the Misra-Gries rule, and the summaries, one
bounded row a task, are merged in groups by the same rule. So every pre-token that makes up more than
``1 / FREQUENT`` of all is in the table, whatever the number of tasks, and the broadcast has a fixed bound. Tier two is a
cache in each Python worker; what misses both is encoded by the library once. Neither tier changes a result, they only
save encodings (a chance hit of a 64-bit hash among the table's entries: below 10^-5 for 10^10 distinct pre-tokens).

Defined results: a null text is empty and has no tokens and no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from hallwatch.llm import words as W
from hallwatch.operators.state_tables import discard, settle

FREQUENT = 1 << 14
LIMIT = 4096
MERGED = 64  # summaries merged in one task
CACHE_PIECES, CACHE_LENGTH = 400_000, 64
SPACE, LINE = 32, 10
SUMMARY = "task int, keys binary, counts binary, sizes binary, names binary"


class Model:
    """The library with a cache of pre-token lengths."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.library = SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or self.library.normalize(" ﬁ\n½ ") != "▁▁ﬁ\n½▁":
            raise ValueError("a piece or the normaliser crosses the borders of pre-tokens")
        self.known: dict[bytes, int] = {}

    def lengths(self, pieces: list[bytes]) -> list[int]:
        """Tokens of pre-tokens: the library adds the first mark itself, and a lone one before a line end counts one."""
        found = {p: self.known.get(p) for p in pieces}
        fresh = [p for p, n in found.items() if n is None]
        if fresh:
            marked = [p[0] == SPACE and len(p) > 1 for p in fresh]
            done = self.library.encode([(p[1:] if m else b"\n" + p[1:]).decode() for p, m in zip(fresh, marked)], num_threads=1)
            found.update((p, len(d) - (not m)) for p, m, d in zip(fresh, marked, done))
            if len(self.known) > CACHE_PIECES:
                self.known.clear()
            self.known.update((p, found[p]) for p in fresh if len(p) <= CACHE_LENGTH)
        return [found[p] for p in pieces]


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def pre_tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of (first text, end text, bytes, starts, ends, hashes, pre-tokens per text); each text has its first mark."""
    column = pc.replace_substring(pc.fill_null(column, ""), "▁", " ")
    column = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(" ", column, ""))
    data, offsets = W.text_bytes(column)
    for i, j in W.chunks(offsets):
        part, begins = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        if len(part) == 0:
            continue
        space = part == SPACE
        start = (part == LINE) | (space & ~np.r_[False, space[:-1]])
        start[begins[:-1][np.diff(begins) > 0]] = True
        starts = np.flatnonzero(start)
        ends = np.r_[starts[1:], len(part)]
        yield i, j, part, starts, ends, W.hash_spans(part, starts, ends), np.diff(np.searchsorted(starts, begins))


class LengthTable:
    """Open addressing in two arrays; a free slot has length 0."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        self.shift = np.uint64(64 - max(1, int(2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.lengths, self.last = np.zeros(size, np.uint64), np.zeros(size, np.uint32), size - 1
        at = self._slot(keys)
        while len(keys):  # a round: the first that asks for a free slot gets it, the others move on
            _, first = np.unique(at, return_index=True)
            first = first[self.lengths[at[first]] == 0]
            self.keys[at[first]], self.lengths[at[first]] = keys[first], lengths[first]
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, lengths, at = keys[rest], lengths[rest], at[rest] + 1 & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Length of each key, 0 where it is missing."""
        out, open_, at = np.zeros(len(keys), np.int64), np.arange(len(keys)), self._slot(keys)
        while len(open_):
            lengths = self.lengths[at]
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = lengths[hit]
            on = ~hit & (lengths > 0)
            open_, at = open_[on], at[on] + 1 & self.last
        return out


class Frequent:
    """Misra-Gries counters: beyond ``limit`` the next largest count is taken off all and what is left is kept."""

    def __init__(self, limit: int):
        self.limit, self.keys, self.counts, self.names = limit, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, keys: np.ndarray, counts: np.ndarray, name) -> None:
        """``name(i)`` gives the bytes of the i-th of ``keys``, which are distinct."""
        both, which = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        total = np.bincount(which, np.concatenate([self.counts, counts]), minlength=len(both)).astype(np.int64)
        if len(both) > self.limit:
            total -= np.partition(total, len(total) - self.limit - 1)[len(total) - self.limit - 1]
        kept = np.flatnonzero(total > 0)
        place = np.full(len(both), -1)
        place[which[len(self.keys):]] = np.arange(len(keys))
        old = np.full(len(both), -1)
        old[which[:len(self.keys)]] = np.arange(len(self.keys))
        names = np.empty(len(kept), object)
        names[:] = [self.names[old[k]] if old[k] >= 0 else name(place[k]) for k in kept]
        self.keys, self.counts, self.names = both[kept], total[kept], names

    def row(self, task: int) -> pa.Table:
        sizes = np.array([len(n) for n in self.names], np.uint32)
        return pa.table({"task": pa.array([task], pa.int32()), "keys": pa.array([self.keys.tobytes()], pa.binary()), "counts": pa.array([self.counts.tobytes()], pa.binary()),
                         "sizes": pa.array([sizes.tobytes()], pa.binary()), "names": pa.array([b"".join(self.names)], pa.binary())})


def _read(keys: bytes, counts: bytes, sizes: bytes, names: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ends = np.cumsum(np.frombuffer(sizes, np.uint32)).tolist()
    return np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64), [names[a:z] for a, z in zip([0, *ends], ends)]


def _summarise(limit: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = Frequent(limit), 0
        for part in parts:
            if part.num_rows:
                task = part.column("task")[0].as_py()
            for _, _, data, starts, ends, hashes, _ in pre_tokens(part.column("text")):
                short = np.flatnonzero(ends - starts <= CACHE_LENGTH)
                keys, first, counts = np.unique(hashes[short], return_index=True, return_counts=True)
                first = short[first]
                held.add(keys, counts, lambda k: data[starts[first[k]]:ends[first[k]]].tobytes())
        if len(held.keys):
            yield from held.row(task).to_batches()
    return run


def _merge(limit: int):
    def run(table: pa.Table) -> pa.Table:
        held = Frequent(limit)
        for row in table.sort_by("task").to_pylist():
            keys, counts, names = _read(row["keys"], row["counts"], row["sizes"], row["names"])
            held.add(keys, counts, names.__getitem__)
        return held.row(table.column("task")[0].as_py())
    return run


def frequent(texts: DataFrame, limit: int = FREQUENT) -> tuple[np.ndarray, list[bytes]]:
    """(hashes, bytes) of at most ``limit`` pre-tokens, among them all that make up more than ``1 / limit`` of the corpus."""
    held = settle(texts.withColumn("task", F.spark_partition_id()).mapInArrow(_summarise(limit), SUMMARY))
    merged, count = held, held.count()
    while count > 1:
        count = -(-count // MERGED)
        number = F.pmod(F.xxhash64("task"), F.lit(count)).cast("int")
        merged = merged.withColumn("task", number).groupBy("task").applyInArrow(_merge(limit), SUMMARY)
    row = merged.first()
    discard(held)
    if row is None:
        return np.zeros(0, np.uint64), []
    keys, _, names = _read(*(bytes(row[c]) for c in ("keys", "counts", "sizes", "names")))
    return keys, names


def count_tokens(docs: DataFrame, path: str, limit: int = FREQUENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row; ``path`` names the model file, which every worker must have."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keys, names = frequent(rows.select("text"), limit)
    table = LengthTable(keys, np.array(model(path).lengths(names), np.uint32))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for part in parts:
            tokens = np.zeros(part.num_rows, np.int64)
            for i, j, data, starts, ends, hashes, per_text in pre_tokens(part.column("text")):
                lengths = table.find(hashes)
                missing = np.flatnonzero(lengths == 0)
                _, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
                raw, at = data.tobytes(), missing[first]
                lengths[missing] = np.array(own.lengths([raw[a:z] for a, z in zip(starts[at].tolist(), ends[at].tolist())]), np.int64)[which]
                tokens[i:j] = np.bincount(np.repeat(np.arange(j - i), per_text), lengths, minlength=j - i).astype(np.int64)
            size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = count_tokens(spark.read.parquet(f"{folder}/documents.parquet"), default_model())
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
