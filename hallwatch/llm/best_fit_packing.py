"""Best-fit packing into sequences of several permitted lengths.

Pieces are packed in groups of about ``GROUP`` (by a hash of row and place, so a group is a random share of the corpus,
whatever the ids, and no task holds more than ``TASK_GROUPS`` of them on average). Inside a group the longest piece goes first, into the open bin it fits most tightly. If none fits, the bin size
is opened whose cost per token placed is least after a trial fill with the pieces still to come (the longest that fits,
again and again, so what cannot be filled counts as padding). Pieces may later fit another bin more tightly; at the end
every bin shrinks to the smallest permitted length that holds its contents. The cost of a sequence of ``c`` tokens is
``c * (1 + c / ATTENTION)`` plus a constant ``START``.

Texts longer than the longest sequence become pieces of that length and a rest; no token is lost. Defined results: a
text without words is one row of length 0 without a bin; null and repeated ids are packed as rows of their own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from hallwatch.llm import words as W
from hallwatch.operators.state_tables import settle

LENGTHS = (512, 1024, 2048, 4096)
GROUP, TASK_GROUPS = 2000, 16
ATTENTION, START = 16384.0, 16.0


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / ATTENTION) + START


def pack_group(pieces: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset there, length of each bin); ``pieces`` descend.

    A trial fill can be wrong where other bins take the pieces, so the plan with smallest bins is kept if it costs less."""
    return min((_plan(pieces, lengths, trial) for trial in (True, False)), key=lambda plan: sum(map(cost, plan[2])))


def _plan(pieces: Sequence[int], lengths: Sequence[int], trial: bool) -> tuple[list[int], list[int], list[int]]:
    lengths = sorted(lengths)
    sizes = sorted(set(pieces))
    rest = Counter(pieces)  # pieces still to come

    def fill(free: int) -> int:
        """Tokens that the pieces still to come can put into ``free``."""
        space, at = free, bisect_right(sizes, free) - 1
        while at >= 0:
            space -= sizes[at] * min(rest[sizes[at]], space // sizes[at])
            at = min(at, bisect_right(sizes, space)) - 1
        return free - space

    spare: list[tuple[int, int]] = []  # (free tokens, bin), ascending
    bins, offsets, used = [], [], []
    for size in pieces:
        rest[size] -= 1
        at = bisect_left(spare, (size, -1))
        if at < len(spare):
            free, number = spare.pop(at)
        else:
            free = min((c for c in lengths if c >= size), key=lambda c: (cost(c) / (size + fill(c - size)) if trial else c, c))
            number = len(used)
            used.append(0)
        bins.append(number)
        offsets.append(used[number])
        used[number] += size
        if free > size:
            insort(spare, (free - size, number))
    return bins, offsets, [lengths[bisect_left(lengths, u)] for u in used]


def _lengths(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        data, offsets = W.text_bytes(part.column(1))
        counts = [W.spans(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])[2] for i, j in W.chunks(offsets)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))], names=["doc_id", "n_words"])


def _pack(lengths: Sequence[int]):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("place", "ascending")]))
        bins, offsets, sizes = pack_group(table.column("length").to_pylist(), lengths)
        used = np.bincount(bins, table.column("length").to_numpy(), minlength=len(sizes)).astype(np.int64)
        out = table.select(["doc_id", "piece", "first", "length", "grp"])
        for name, values in (("bin", bins), ("offset", offsets), ("capacity", np.array(sizes)[bins]), ("used", used[bins])):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out
    return run


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, first`` (word of the text), ``length, grp, bin, offset`` (in the bin), ``capacity, used`` per piece."""
    longest = max(lengths)
    kind = docs.schema[doc_id].dataType.simpleString()
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_lengths, f"doc_id {kind}, n_words long")
    sized = settle(sized.withColumn("place", F.monotonically_increasing_id()))  # one read of the texts; ids may be null or repeat, places not
    pieces = sized.select("doc_id", "place", "n_words", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col("n_words") / longest)) - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "place", "piece", (F.col("piece") * longest).alias("first"), F.least(F.lit(longest), F.col("n_words") - F.col("piece") * longest).cast("long").alias("length"))
    groups = max(1, -(-pieces.where("length > 0").count() // GROUP))
    filled = pieces.where("length > 0").withColumn("grp", F.pmod(F.xxhash64("doc_id", "length", "place", "piece"), F.lit(groups)))
    tasks = min(groups, max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // TASK_GROUPS)))
    packed = filled.repartition(tasks, "grp").groupBy("grp").applyInArrow(_pack(lengths), f"doc_id {kind}, piece long, first long, length long, grp long, bin long, offset long, capacity long, used long")
    empty = pieces.where("length = 0").drop("place")
    return packed.unionByName(empty, allowMissingColumns=True)


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(spark.read.parquet(f"{folder}/documents.parquet"))
