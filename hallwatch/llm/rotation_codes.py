"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector is turned by random orthogonal matrices; the signs of its coordinates are its *code*, the inner product of
vector and code direction is its *correction factor*, and the coordinates of the first turn are kept in four bits each.
All three are stored, some tens of bytes. Code of one and coarse coordinates of the other, divided by the factor, give an
unbiased estimate of the cosine of two vectors; a pair that has the threshold errs below it by no more than ``SIGMAS``
times the known spread, so a pair beyond this bound is dropped without its vectors (``screen``). Vectors are fetched only
for members of pairs that are left; these are computed again in double precision, and only that value decides.

Pairs are found in tables: table ``t`` groups codes by ``k`` of their bits. ``k`` grows with the logarithm of the number
of distinct vectors, so groups keep their size, and there are as many tables as a pair exactly at the threshold needs to
meet in one of them with probability ``RECALL`` (closer pairs meet more surely). A pair is counted in the first table
where it meets; no list of pairs is ever written. Groups over ``BLOCK`` codes, and over ``NEAR_BLOCK`` vectors that are
left (many near copies), are compared block by block in separate tasks, without a cap. Equal vectors are one class with a count.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of
different lengths are not compared; a null id takes part but never names a component; rows with one id stay rows. Classes
go by a 64-bit hash of the vector (a chance repeat among 10^8 distinct vectors: 0.0003).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hallwatch.llm import batches as B
from hallwatch.llm.components import components
from hallwatch.operators.state_tables import settle

COSINE, RECALL = 0.9, 0.99
GROUP, BLOCK, NEAR_BLOCK = 512, 2000, 256
SIGMAS = 4.0  # width of the confidence bound
FEW = 16  # shorter vectors are not screened: the spread is known for many coordinates
LEVELS = 7  # of coarse coordinates on each side of 0


@lru_cache(maxsize=4)
def rotations(size: int, count: int) -> np.ndarray:
    """``count`` random orthogonal matrices, side by side."""
    rng = np.random.default_rng(20240601)
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((size, size)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, 1)


def layout(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """(bits per table, tables) for this many distinct vectors."""
    bits = min(60, max(1, math.ceil(math.log2(max(vectors, 1) / GROUP + 1))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log1p(-meet)))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def turns(size: int, bits: int, tables: int) -> int:
    return max(1, -(-bits * tables // size))


def encode(u: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(table keys, stored codes as rows of bytes) of unit vectors."""
    size = u.shape[1]
    turned = u @ rotations(size, turns(size, bits, tables))
    signs = turned > 0
    keys = signs[:, :bits * tables].reshape(len(u), tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    first = turned[:, :size]
    factor = np.abs(first).sum(1) / math.sqrt(size)
    step = np.abs(first).max(1) / LEVELS
    coarse = np.rint(first / step[:, None])
    lost = np.sqrt(((first - coarse * step[:, None]) ** 2).sum(1))
    nibbles = np.pad((coarse + LEVELS + 1).astype(np.uint8), ((0, 0), (0, size % 2)))
    constants = np.stack([factor, step, lost], 1).astype("<f4")
    return keys, np.concatenate([constants.view(np.uint8).reshape(len(u), 12), nibbles[:, ::2] << 4 | nibbles[:, 1::2], np.packbits(signs, axis=1)], 1)


class Codes:
    """Stored codes of some vectors of one size."""

    def __init__(self, raw: np.ndarray, size: int, bits: int, tables: int):
        n, half = len(raw), (size + 1) // 2
        self.size = size
        self.factor, self.step, self.lost = np.ascontiguousarray(raw[:, :12]).view("<f4").astype(np.float64).T
        nibbles = np.empty((n, 2 * half), np.uint8)
        nibbles[:, ::2], nibbles[:, 1::2] = raw[:, 12:12 + half] >> 4, raw[:, 12:12 + half] & 15
        self.coarse = ((nibbles[:, :size].astype(np.float32) - (LEVELS + 1)) * self.step[:, None].astype(np.float32))
        signs = np.unpackbits(raw[:, 12 + half:], axis=1, count=size * turns(size, bits, tables))
        self.signs = signs[:, :size].astype(np.float32) * 2 - 1
        self.keys = signs[:, :bits * tables].reshape(n, tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))

    def fresh(self, i: np.ndarray, j: np.ndarray, table: int) -> np.ndarray:
        """Pairs that meet in no earlier table."""
        return ~(self.keys[i, :table] == self.keys[j, :table]).any(1)

    def screen(self, cosine: float, side: np.ndarray, table: int) -> np.ndarray:
        """Which vectors are in a pair that meets here first and may reach ``cosine``; with two sides only pairs across."""
        n, found = len(self.factor), np.zeros(len(self.factor), bool)
        scaled = self.signs / (math.sqrt(self.size) * self.factor[:, None]).astype(np.float32)
        spread = np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor / math.sqrt(max(self.size - 1, 1))
        error = SIGMAS * (spread * math.sqrt(1 - cosine**2) + self.lost / math.sqrt(self.size) / self.factor.min()) / 2
        least = (cosine / 2 - error).astype(np.float32) if self.size >= FEW else np.full(n, -np.inf, np.float32)
        for a in range(0, n, 512):
            estimate = (scaled[a:a + 512] @ self.coarse.T + self.coarse[a:a + 512] @ scaled.T) / 2
            i, j = np.nonzero(estimate >= least[a:a + 512, None] + least[None])
            i += a
            fits = (side[i] == 0) & (side[j] == 1) if side.any() else i < j
            i, j = i[fits], j[fits]
            for b in range(0, len(i), 65536):
                x, y = i[b:b + 65536], j[b:b + 65536]
                new = self.fresh(x, y, table)
                found[x[new]] = found[y[new]] = True
        return found


def _encode(bits: int, tables: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = np.diff(part.column("embedding").offsets.to_numpy()) if part.num_rows else np.zeros(0, int)
            flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):  # vectors of one length at a time
                at = np.flatnonzero(sizes == size)
                keys, stored = encode(unit(flat[starts[at][:, None] + np.arange(size)].astype(np.float64)), bits, tables)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel()))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("copies").take(take), pa.array([size] * len(at), pa.int32()), listed,
                                                  pa.array([r.tobytes() for r in stored], pa.binary())], names=["id", "copies", "size", "keys", "code"])
    return run


def _groups(task: pa.Table) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end, size, table) of each group of two or more in a sorted task."""
    where = np.stack([task.column(c).to_numpy().astype(np.int64) for c in ("size", "t", "key", "x", "y")], 1)
    starts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(1)])
    for lo, hi in zip(starts, np.r_[starts[1:], len(where)]):
        if hi - lo > 1:
            yield lo, hi, int(where[lo, 0]), int(where[lo, 1])


def _read_codes(raw: list[bytes], size: int, bits: int, tables: int) -> Codes:
    return Codes(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), size, bits, tables)


def _screen(bits: int, tables: int, cosine: float):
    """Entries of a task that need their vectors."""
    def run(task: pa.Table) -> pa.Table:
        task = B.in_order(task, "size", "t", "key", "x", "y", "side", "id")
        side, raw, found = task.column("side").to_numpy(), B.binaries(task, "code"), np.zeros(len(task), bool)
        for lo, hi, size, table in _groups(task):
            found[lo:hi] = _read_codes(raw[lo:hi], size, bits, tables).screen(cosine, side[lo:hi], table)
        return task.filter(pa.array(found))
    return run


def _linked(u: np.ndarray, held: Codes, side: np.ndarray, table: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one group that reach ``cosine`` and meet here first; with two sides only pairs across."""
    found = []
    for a in range(0, len(u), 512):
        i, j = np.nonzero(u[a:a + 512] @ u.T >= cosine - 1e-9)
        i += a
        fits = (side[i] == 0) & (side[j] == 1) if side.any() else i < j
        i, j = i[fits], j[fits]
        for b in range(0, len(i), 65536):
            x, y = i[b:b + 65536], j[b:b + 65536]
            near = (np.einsum("ij,ij->i", u[x], u[y]) >= cosine) & held.fresh(x, y, table)
            found.append((x[near], y[near]))
    i, j = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(bits: int, tables: int, cosine: float):
    """Links of the groups of a task, by the vectors themselves."""
    def run(task: pa.Table) -> pa.Table:
        task = B.in_order(task, "size", "t", "key", "x", "y", "side", "id")
        ids, copies, side = (task.column(c).to_numpy() for c in ("id", "copies", "side"))
        raw, vectors, out = B.binaries(task, "code"), task.column("embedding").combine_chunks(), []
        for lo, hi, size, table in _groups(task):
            u = unit(vectors[int(lo):int(hi)].flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, size).astype(np.float64))
            i, j = _linked(u, _read_codes(raw[lo:hi], size, bits, tables), side[lo:hi], table, cosine)
            if len(i):
                own, times = ids[lo:hi], copies[lo:hi]
                links = np.bincount(i, times[j], minlength=hi - lo) + np.bincount(j, times[i], minlength=hi - lo)
                at = np.flatnonzero(links)
                out.append((own[at], own[_roots(hi - lo, i, j)[at]], links[at].astype(np.int64)))
        a, b, n = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "links"])
    return run


def _dealt(entries: DataFrame, block: int, tables: int, count: int) -> DataFrame:
    """Entries with the task of their group; groups of more than ``block`` as pairs of blocks, so an entry stands in several."""
    group = ["size", "t", "key"]
    crowded = entries.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    entries = entries.join(crowded, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    entries = entries.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entries = entries.withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other"), "side": (F.col("mine") > F.col("other")).cast("int")}).drop("mine", "other", "blocks")
    tasks = max(2 * int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), count * tables // 20_000)
    return entries.withColumn("task", F.pmod(F.xxhash64(*group, "x", "y"), F.lit(tasks)))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row."""
    kind = "<f4" if "float" in vectors.schema[embedding].dataType.simpleString() else "<f8"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    sound = F.size("embedding") > 0
    for test in (lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),):
        sound = sound & F.forall("embedding", test)
    sound = F.coalesce(sound & F.exists("embedding", lambda x: x != 0), F.lit(False))
    classes = settle(rows.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
                     .withColumn("id", F.xxhash64("embedding")))
    count = classes.count()
    bits, tables = layout(count, cosine)
    codes = settle(classes.mapInArrow(_encode(bits, tables), "id long, copies long, size int, keys array<bigint>, code binary"))
    entries = _dealt(codes.select("id", "copies", "size", "code", F.posexplode("keys").alias("t", "key")), BLOCK, tables, count)
    near = entries.groupBy("task").applyInArrow(_screen(bits, tables, cosine), "id long, copies long, size int, code binary, t int, key long, x int, y int, side int, task long")
    near = settle(near.select("id", "copies", "size", "code", "t", "key").dropDuplicates(["size", "t", "key", "id"]))
    near = _dealt(near, NEAR_BLOCK, tables, count).join(classes.select("id", "embedding"), "id")
    found = settle(near.groupBy("task").applyInArrow(_compare(bits, tables, cosine), "a long, b long, links long"))
    groups = components(found.select("a", "b")).select(F.col("node").alias("id"), "root")
    sums = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    classes = classes.join(sums, "id", "left").join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    named = named.select("id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", F.when(sound, F.xxhash64("embedding")).alias("id")).join(named, "id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
