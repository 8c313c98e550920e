"""N-gram Jaccard join with signature trees.

Texts become sets of word n-gram hashes; equal sets are one class, named by a hash of the set. Two classes link when
``100 * overlap >= percent * union``. The join is exact on the hashes:

1. How many sets hold an n-gram is counted in buckets (``batches``). A class whose n-grams are mostly its own cannot
   link and leaves. Of the rest only shared n-grams can overlap.
2. Classes that share an n-gram of their prefixes (rarest first) fall into one *grove*; links never leave a grove.
3. Each grove is a signature tree: leaves are classes, nodes hold the OR of their bitmaps, the range of set sizes and
   the most n-grams one bitmap may hide by collisions. A dual traversal keeps node pairs whose largest possible overlap
   reaches the threshold for their smallest sizes, skips pairs that are already one component, and counts exactly
   below. All classes are sorted by grove over all tasks, so a grove may span many; their places, added up over the
   tasks, cut it into blocks of about ``BLOCK_SETS`` or ``BLOCK_BYTES`` that are trees of their own, and the levels
   above the blocks are traversed as Spark joins, by block, so no grove is ever in one task.

Defined results: no words or a null text give an empty set that links with nothing; fewer than ``n`` words are one
n-gram; rows with a null id have no component number of their own but count in their component's links; repeated rows
are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hallwatch.llm import batches as B, words as W
from hallwatch.llm.components import components
from hallwatch.operators.state_tables import discard, settle

N, PERCENT = 5, 75
BLOCK_SETS, BLOCK_BYTES = 1024, 8 << 20
LANES = 32  # a signature: so many 64-bit numbers
FAN = 8


def shingles(column: pa.Array | pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes, text of each), by text and hash."""
    data, offsets = W.text_bytes(column)
    hashes, texts = [], []
    for i, j in W.chunks(offsets):
        h, counts = W.hash_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], lower=True)
        grams, first = W.windows(h, counts, n)
        text = W.owners(counts)
        ends = np.cumsum(counts)
        for short in np.flatnonzero((counts > 0) & (counts < n)):
            whole = np.full(1, counts[short], np.uint64)
            for value in h[ends[short] - counts[short]:ends[short]]:
                whole = W.mix(whole * np.uint64(31) + value)
            grams, first = np.append(grams, whole), np.append(first, ends[short] - 1)
        order = np.argsort(text[first], kind="stable")
        v, g = W.distinct_within(grams[order], text[first][order])
        hashes.append(v)
        texts.append(g + i)
    return (np.concatenate(hashes), np.concatenate(texts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _classes(values: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, class key) per text; the key of an empty set is 0."""
    size = np.bincount(text, minlength=texts)
    total = np.r_[np.uint64(0), np.cumsum(W.mix(values ^ np.uint64(0x5851F42D4C957F2D)))]
    ends = np.cumsum(size)
    key = W.mix(total[ends] - total[ends - size] + size.astype(np.uint64)).view(np.int64)
    return size, np.where(size > 0, key, 0)


def set_classes(docs: DataFrame, n: int = N, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set_key`` of every row."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            size, key = _classes(*shingles(part.column(1), n), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), pa.array(key)], names=["doc_id", "n_shingles", "set_key"])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key long")


def _batch_sets(table: pa.Table, n: int):
    """First text of every class in a batch: (sizes, class keys, n-grams, their class)."""
    table = B.in_order(table, "text")
    values, text = shingles(table.column("text"), n)
    size, key = _classes(values, text, len(table))
    _, first = np.unique(key, return_index=True)
    first = np.sort(first[size[first] > 0])
    number = np.full(len(table), -1)
    number[first] = np.arange(len(first))
    mine = number[text] >= 0
    return size[first], key[first], values[mine], number[text][mine]


def _send(n: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        _, _, values, _ = _batch_sets(table, n)
        values, times = np.unique(values, return_counts=True)
        order, bounds = B.split(values, buckets)
        at = np.flatnonzero(np.diff(bounds))
        cut = [order[bounds[b]:bounds[b + 1]] for b in at]
        return pa.table({"batch": pa.array([batch] * len(at), pa.int32()), "bucket": pa.array(at, pa.int32()),
                         "keys": pa.array([B.pack(values[c]) for c in cut], pa.binary()), "times": pa.array([times[c].astype(np.uint32).tobytes() for c in cut], pa.binary())})
    return send


def _count(table: pa.Table) -> pa.Table:
    packed = B.binaries(table, "keys")
    keys = np.concatenate([B.unpack(k) for k in packed])
    times = np.concatenate([np.frombuffer(t, np.uint32) for t in B.binaries(table, "times")]).astype(np.int64)
    order, starts, run = B.same_keys(keys)
    total = np.empty(len(keys), np.int64)
    total[order] = np.add.reduceat(times[order], starts)[run]
    total = np.minimum(total, 2**32 - 1).astype(np.uint32)
    cuts = np.cumsum([0, *[len(k) // B.KEY_BYTES for k in packed]])
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "times": pa.array([total[a:z].tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary())})


def _least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap of sets of these sizes that link."""
    return -(-percent * (a + b) // (100 + percent))


def _candidates(n: int, percent: int, buckets: int):
    def candidates(docs: pa.Table, counts: pa.Table) -> pa.Table:
        if len(docs) == 0:
            size, key, values, owner = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        else:
            size, key, values, owner = _batch_sets(docs, n)
        sent, place = np.unique(values, return_inverse=True)
        order, bounds = B.split(sent, buckets)
        held = np.zeros(len(sent), np.int64)
        for b, times in zip(counts.column("bucket").to_pylist(), B.binaries(counts, "times")):
            held[order[bounds[b]:bounds[b + 1]]] = np.frombuffer(times, np.uint32)
        held = held[place]
        shared = held >= 2
        n_shared = np.bincount(owner[shared], minlength=len(size))
        need = -(-percent * size // 100)
        alive = n_shared >= need
        use = shared & alive[owner]
        values, owner, held = values[use].view(np.int64), owner[use], held[use]
        order = np.lexsort((values, held, owner))
        values, owner = values[order], owner[order]
        kept = np.flatnonzero(alive)
        ends = np.cumsum(n_shared[kept])
        starts = ends - n_shared[kept]
        prefix = (size[kept] - need[kept] + 1) - (size[kept] - n_shared[kept])  # own n-grams come first in the order
        return pa.table({
            "set_key": pa.array(key[kept]), "size": pa.array(size[kept].astype(np.int64)),
            "prefix": pa.array([values[a:a + p] for a, p in zip(starts, prefix)], pa.list_(pa.int64())),
            "lowest": pa.array([int(values[a:z].min()) for a, z in zip(starts, ends)], pa.int64()),
            "grams": pa.array([np.sort(values[a:z]).tobytes() for a, z in zip(starts, ends)], pa.binary())})
    return candidates


# ---- one tree in one task -------------------------------------------------------------------------------------------

def signature(grams: np.ndarray) -> np.ndarray:
    bits = np.unique(W.mix(grams.view(np.uint64)) >> np.uint64(64 - 11))  # LANES * 64 = 2^11 bits
    out = np.zeros(LANES * 64, np.uint8)
    out[bits.astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


class _Joined:
    """Components so far, by path halving."""

    def __init__(self, labels: np.ndarray):
        _, first, which = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[which]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up


def grow(sizes: np.ndarray, grams: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
    """Levels of a tree, leaves first: OR of signatures, size range, most n-grams held, most hidden by equal bits."""
    bits = np.stack([signature(g) for g in grams])
    held = np.array([len(g) for g in grams])
    level = {"bits": bits, "low": sizes, "held": held, "hidden": held - np.bitwise_count(bits).sum(1).astype(np.int64)}
    levels = [level]
    while len(level["low"]) > 1:
        at = np.arange(0, len(level["low"]), FAN)
        level = {"bits": np.bitwise_or.reduceat(level["bits"], at), "low": np.minimum.reduceat(level["low"], at),
                 "held": np.maximum.reduceat(level["held"], at), "hidden": np.maximum.reduceat(level["hidden"], at)}
        levels.append(level)
    return levels


def possible(level: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Node pairs whose largest possible overlap suffices for their smallest sizes."""
    most = np.bitwise_count(level["bits"][i] & level["bits"][j]).sum(1).astype(np.int64) + np.minimum(level["hidden"][i], level["hidden"][j])
    most = np.minimum(most, np.minimum(level["held"][i], level["held"][j]))
    return most >= _least_overlap(level["low"][i], level["low"][j], percent)


def join_tree(sizes: np.ndarray, grams: list[np.ndarray], percent: int = PERCENT, labels: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """Component of each set (an index); ``labels`` are components known before, ``side`` asks only for links across."""
    n = len(sizes)
    joined = _Joined(np.arange(n) if labels is None else labels)
    _, place = np.unique(np.concatenate(grams), return_inverse=True)
    cuts = np.cumsum([0, *map(len, grams)])
    places = [place[a:z] for a, z in zip(cuts, cuts[1:])]
    mark = np.zeros(place.max(initial=0) + 1, bool)

    def compare(i: int, others: np.ndarray) -> None:
        others = others[joined.roots()[others] != joined.find(i)]
        if side is not None:
            others = others[side[others] != side[i]]
        if len(others) == 0:
            return
        mark[places[i]] = True
        own = [places[j] for j in others]
        overlap = np.add.reduceat(mark[np.concatenate(own)].astype(np.int64), np.cumsum([0, *map(len, own[:-1])]))
        mark[places[i]] = False
        for j in others[overlap >= _least_overlap(sizes[i], sizes[others], percent)]:
            joined.up[joined.find(j)] = joined.find(i)

    if n > FAN:  # most groups of copies are one star: merge it before the traversal
        compare(0, np.arange(1, n))
    levels = grow(sizes, grams)
    i = j = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        if depth < len(levels) - 1:
            count = len(level["low"])
            a, b = np.divmod(np.arange(FAN * FAN), FAN)
            i, j = (i[:, None] * FAN + a).ravel(), (j[:, None] * FAN + b).ravel()
            fits = (i <= j) & (j < count)
            i, j = i[fits], j[fits]
        roots, at = joined.roots(), np.arange(0, n, FAN ** depth)
        low, high = np.minimum.reduceat(roots, at), np.maximum.reduceat(roots, at)
        open_ = (low[i] != high[i]) | (low[j] != high[j]) | (low[i] != low[j])
        i, j = i[open_], j[open_]
        keep = np.concatenate([possible(level, i[a:a + 65536], j[a:a + 65536], percent) for a in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        i, j = i[keep], j[keep]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    for k in np.unique(i):
        compare(int(k), j[np.searchsorted(i, k):np.searchsorted(i, k, "right")])
    return joined.roots()


def _grove_links(percent: int):
    """Links of all blocks of a task as (set, another set of its component)."""
    def run(table: pa.Table) -> pa.Table:
        table = B.in_order(table, "grove", "block", "lowest", "set_key")
        keys, size = table.column("set_key").to_numpy(), table.column("size").to_numpy()
        grams = [np.frombuffer(g, np.int64) for g in B.binaries(table, "grams")]
        where = np.stack([table.column(c).to_numpy() for c in ("grove", "block")], 1)
        new = np.r_[True, (where[1:] != where[:-1]).any(1)]
        starts = np.flatnonzero(new)
        a, b = [], []
        for lo, hi in zip(starts, np.r_[starts[1:], len(keys)]):
            one = np.unique(keys[lo:hi], return_index=True)[1] + lo  # copies of a set from several batches
            one.sort()
            if len(one) > 1:
                root = join_tree(size[one], [grams[k] for k in one], percent)
                a.append(keys[one])
                b.append(keys[one][root])
        return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], names=["a", "b"])
    return run


def _block_links(percent: int):
    """Links across the two blocks of one node pair."""
    def run(table: pa.Table) -> pa.Table:
        table = B.in_order(table, "set_key", "side")
        keys, side = table.column("set_key").to_numpy(), table.column("side").to_numpy()
        one = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        grams = B.binaries(table, "grams")
        root = join_tree(table.column("size").to_numpy()[one], [np.frombuffer(grams[k], np.int64) for k in one], percent, table.column("label").to_numpy()[one], side[one])
        return pa.table([pa.array(keys[one]), pa.array(keys[one][root])], names=["a", "b"])
    return run


def _star(percent: int):
    """Links of the sets of a block with the pivot of its grove."""
    def run(table: pa.Table, pivots: pa.Table) -> pa.Table:
        a, b = [], []
        for pivot, p_size, p_grams in zip(*(pivots.column(c).to_pylist() for c in ("pivot", "p_size", "p_grams"))):
            grams = np.frombuffer(p_grams, np.int64)
            for key, size, own in zip(*(table.column(c).to_pylist() for c in ("set_key", "size", "grams"))):
                if np.isin(np.frombuffer(own, np.int64), grams, assume_unique=True).sum() >= _least_overlap(size, p_size, percent):
                    a.append(key)
                    b.append(pivot)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _lanes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        bits = [signature(np.frombuffer(g, np.int64)) for g in part.column("grams").to_pylist()]
        lanes = np.stack(bits) if bits else np.zeros((0, LANES), np.uint64)
        held = np.array([len(g.as_py()) // 8 for g in part.column("grams")], np.int64)
        hidden = held - np.bitwise_count(lanes).sum(1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("grove", "block", "size", "label")], pa.array(held), pa.array(hidden),
                                          *[pa.array(np.ascontiguousarray(lanes[:, k]).view(np.int64)) for k in range(LANES)]],
                                         names=["grove", "block", "size", "label", "held", "hidden", *[f"w{k}" for k in range(LANES)]])


def _wide_links(wide: DataFrame, inner: DataFrame, percent: int) -> DataFrame:
    """Links between blocks of groves that have several: pivots first, then the upper levels by joins."""
    pivots = wide.groupBy("grove").agg(F.min("set_key").alias("pivot"))
    pivots = wide.select("grove", "block").distinct().join(pivots, "grove")  # one copy of a pivot's n-grams a block
    pivots = pivots.join(wide.select(F.col("set_key").alias("pivot"), F.col("size").alias("p_size"), F.col("grams").alias("p_grams")).dropDuplicates(["pivot"]), "pivot")
    pivots = pivots.select(F.col("grove").alias("p_grove"), F.col("block").alias("p_block"), "pivot", "p_size", "p_grams")
    star = settle(wide.groupBy("grove", "block").cogroup(pivots.groupBy("p_grove", "p_block")).applyInArrow(_star(percent), "a long, b long"))
    labels = components(inner.unionByName(star))
    wide = settle(wide.join(labels.withColumnsRenamed({"node": "set_key", "root": "label"}), "set_key", "left").withColumn("label", F.coalesce("label", "set_key")))
    lanes = [f"w{k}" for k in range(LANES)]
    rolled = [F.min("size").alias("low"), F.max("held").alias("held"), F.max("hidden").alias("hidden"), F.min("label").alias("first"), F.max("label").alias("last"), *[F.bit_or(w).alias(w) for w in lanes]]
    schema = "grove long, block long, size long, label long, held long, hidden long, " + ", ".join(f"{w} long" for w in lanes)
    blocks = wide.select("grove", "block", "size", "label", "grams").mapInArrow(_lanes, schema).groupBy("grove", "block").agg(*rolled)
    levels = [settle(blocks.withColumn("node", F.col("block").cast("int")))]
    again = [F.min("low").alias("low"), F.max("held").alias("held"), F.max("hidden").alias("hidden"), F.min("first").alias("first"), F.max("last").alias("last"), *[F.bit_or(w).alias(w) for w in lanes]]
    while levels[-1].agg(F.max("node")).first()[0]:
        levels.append(settle(levels[-1].groupBy("grove", F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(*again)))
    pairs = levels[-1].select("grove", F.col("node").alias("i"), F.col("node").alias("j"))
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        x, y = (level.select("grove", F.col("node").alias(side), F.floor(F.col("node") / FAN).cast("int").alias(f"up_{side}"),
                             *[F.col(c).alias(f"{c}_{side}") for c in ("low", "held", "hidden", "first", "last", *lanes)]) for side in ("i", "j"))
        if depth < len(levels) - 1:
            up = pairs.withColumnsRenamed({"i": "up_i", "j": "up_j"})
            pairs = up.join(x, ["grove", "up_i"]).join(y, ["grove", "up_j"]).where("i <= j")
        else:
            pairs = pairs.join(x, ["grove", "i"]).join(y, ["grove", "j"])
        most = sum((F.bit_count(F.col(f"{w}_i").bitwiseAND(F.col(f"{w}_j"))) for w in lanes), F.lit(0)) + F.least("hidden_i", "hidden_j")
        most = F.least(most, F.col("held_i"), F.col("held_j"))
        settled = (F.col("first_i") == F.col("last_i")) & (F.col("first_j") == F.col("last_j")) & (F.col("first_i") == F.col("first_j"))
        pairs = settle(pairs.where((most * (100 + percent) >= percent * (F.col("low_i") + F.col("low_j"))) & ~settled).select("grove", "i", "j"))
    pairs = pairs.where("i < j")
    sets = wide.select("grove", F.col("block").cast("int").alias("node"), "set_key", "size", "grams", "label")
    sides = [pairs.withColumn("node", F.col(c)).join(sets, ["grove", "node"]).withColumn("side", F.lit(k)).drop("node") for k, c in enumerate(("i", "j"))]
    crossed = sides[0].unionByName(sides[1]).groupBy("grove", "i", "j").applyInArrow(_block_links(percent), "a long, b long")
    return star.unionByName(crossed)


def _place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each set lies in the part of its grove that this task holds, in blocks; sets arrive in order."""
    grove, last, at = None, None, 0.0
    for part in parts:
        keep, places = [], []
        for k, (g, key, n) in enumerate(zip(part.column("grove").to_pylist(), part.column("set_key").to_pylist(), pc.binary_length(part.column("grams")).to_pylist())):
            if g != grove:
                grove, at = g, 0.0
            elif key == last:  # the same set from another batch
                continue
            last = key
            keep.append(k)
            places.append(at)
            at += max(1 / BLOCK_SETS, n / BLOCK_BYTES)
        part = part.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(places, pa.float64())], names=[*part.schema.names, "place"])


def _in_blocks(members: DataFrame) -> DataFrame:
    """``block`` of each set in its grove: its place after all that earlier tasks hold of the grove."""
    held = F.max(F.col("place") + F.greatest(F.lit(1 / BLOCK_SETS), F.octet_length("grams") / BLOCK_BYTES)).alias("held")
    slices = members.groupBy("grove", "slice").agg(held)  # a row per task and grove
    w = Window.partitionBy("grove").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.sum("held").over(w)).where("before is not null").select("grove", "slice", "before")
    return members.join(slices, ["grove", "slice"], "left").withColumn("block", F.floor(F.coalesce("before", F.lit(0.0)) + F.col("place"))).drop("before", "slice", "place")


def set_links(docs: DataFrame, n: int = N, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``a, b``: pairs of set keys in one component, enough of them to connect it."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    parts = B.batch_count(rows)
    by_batch = B.with_batch(rows, parts, F.struct("doc_id", F.length("text"))).groupBy("batch")
    counts = (by_batch.applyInArrow(_send(n, parts), "batch int, bucket int, keys binary, times binary")
              .groupBy("bucket").applyInArrow(_count, "batch int, bucket int, times binary"))
    sets = settle(by_batch.cogroup(counts.groupBy("batch")).applyInArrow(_candidates(n, percent, parts), "set_key long, size long, prefix array<bigint>, lowest long, grams binary"))
    held = sets.select("set_key", F.explode("prefix").alias("gram"))
    hubs = held.groupBy("gram").agg(F.min("set_key").alias("hub"), F.max("set_key").alias("other")).where("hub <> other").select("gram", "hub")
    groves = components(held.join(hubs, "gram").select(F.col("set_key").alias("a"), F.col("hub").alias("b")))
    members = sets.drop("prefix").join(groves.withColumnsRenamed({"node": "set_key", "root": "grove"}), "set_key")
    tasks = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sets.agg(F.sum(F.octet_length("grams"))).first()[0] or 0) // BLOCK_BYTES))
    order = ["grove", "lowest", "set_key"]
    members = members.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id())
    members = _in_blocks(settle(members.select("set_key", "size", "lowest", "grams", "grove", "slice").mapInArrow(
        _place, "set_key long, size long, lowest long, grams binary, grove long, slice int, place double"), wide=True))
    discard(sets)
    inner = settle(members.withColumn("task", F.pmod(F.xxhash64("grove", "block"), F.lit(tasks))).groupBy("task").applyInArrow(_grove_links(percent), "a long, b long"))
    blocks = members.select("grove", "block").distinct()
    several = blocks.groupBy("grove").count().where("count > 1")
    if several.isEmpty():
        return inner
    wide = members.join(blocks.join(several, "grove", "left_semi"), ["grove", "block"], "left_semi")
    return inner.unionByName(_wide_links(settle(wide, wide=True), inner, percent))


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, set_key`` per row; ``component_id`` is the smallest id reachable by links."""
    rows = settle(set_classes(docs, n, doc_id, text))
    links = components(set_links(docs, n, percent, doc_id, text)).withColumnsRenamed({"node": "set_key"})
    classes = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least")).join(links, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set_key", "component_id")
    return rows.join(named, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "set_key")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet")).drop("set_key")


OP1_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM texts WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT t.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id JOIN reach r ON r.a = t.doc_id GROUP BY ALL"""
