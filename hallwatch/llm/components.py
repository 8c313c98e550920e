"""Connected components of a distributed edge table by contraction.

Each round maps every node to its best neighbour (the smallest number in even rounds, which folds stars at once; the
smallest of a fresh hash in odd rounds, which shortens any chain by a constant factor) and keeps only edges between
different images. Only aggregates with partial sums and joins that Spark can split are used: a hub may hold any share
of the edges. Rounds are cut with checkpoints in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hallwatch.operators.state_tables import discard, settle


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``edges`` (``a, b`` long); the root is a node of the same component."""
    def simple(df: DataFrame) -> DataFrame:
        df = df.where("a <> b and a is not null and b is not null")
        return settle(df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    live, labels, turn = simple(edges), None, 0
    while live.take(1):
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c: F.xxhash64(F.col(c), F.lit(turn)))  # noqa: B023
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("to"))).alias("best"))
        hop = settle(best.select(F.col("a").alias("node"), F.when(F.col("best.rank") < rank("a"), F.col("best.to")).otherwise(F.col("a")).alias("root")))
        if labels is None:
            labels = hop
        else:
            moved = hop.select(F.col("node").alias("root"), F.col("root").alias("moved"))
            before, labels = labels, settle(labels.join(moved, "root", "left").select("node", F.coalesce("moved", "root").alias("root")))
            discard(before)
        left, right = hop.withColumnsRenamed({"node": "a", "root": "x"}), hop.withColumnsRenamed({"node": "b", "root": "y"})
        before, live = live, simple(live.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
        discard(before, *[hop] * (labels is not hop))
        turn += 1
    if labels is None:
        labels = live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
