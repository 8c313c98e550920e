"""Global tracks as a stream: the root of every local track, handed on from part to part.

A track that continues nobody is its own root. One that continues another takes over that one's root, which may become
known later: then it waits in the state of the track it points to. A track that does not know its root either but points
further back passes those who wait for it on to there, so pointers double and a chain of ``n`` parts that arrives at once
takes about ``log n`` micro-batches; parts that come one after the other take one each. What is handed or passed on is
appended to the lineage log, and the same log is read back as a stream: that is how a track hears of its root and of
those who point to it. Distinct tracks of a chain point to distinct tracks, so no key gets hot. The log holds the root of
every track once, whatever the split into micro-batches. Tracks lie in state by the bucket, as Arrow batches: calls to
state are per bucket and micro-batch, not per track.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hallwatch.streaming import jobs
from hallwatch.streaming.ordered import PACKED, ROWS_AT_ONCE, packed, state_in_rocksdb, unpacked

LOG = "track_id string, kind string, other string"  # its root, or the earlier track it points to from now on


MESSAGE = ["key", "kind", "other"]
BUCKETS = 256  # of tracks; a state key each


class _HandOn(StatefulProcessor):
    """State of a bucket of tracks: the root of each or the track it points to, who waits for it, and whether it may be forgotten.

    All tracks of a bucket are answered at once. Roots, which never change, are only appended to; the rest is rewritten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.arrow = pa.schema([(name, pa.string()) for name in MESSAGE])
        self.roots, self.open = (handle.getListState(name, PACKED) for name in ("roots", "open"))

    def _read(self, rows: Iterator[tuple]) -> pd.DataFrame:
        return pa.Table.from_batches([unpacked(row, self.arrow) for row in rows], self.arrow).to_pandas()

    def _pieces(self, rows: pd.DataFrame) -> list[tuple]:
        return [packed(rows.iloc[i:i + ROWS_AT_ONCE], self.arrow) for i in range(0, len(rows), ROWS_AT_ONCE)]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = self._read((batch,) for pdf in rows for batch in pdf["rows"])
        known = self._read(self.roots.get())
        rest = pd.concat([self._read(self.open.get()), new], ignore_index=True)
        kind = rest["kind"]
        told = rest[kind == "root"].drop_duplicates("key", keep="last")
        told = told[~told["key"].isin(known["key"])]
        roots = pd.concat([known, told], ignore_index=True)
        ups = rest[(kind == "up") & ~rest["key"].isin(roots["key"])].drop_duplicates("key", keep="last")
        gone, later = rest[kind == "gone"].drop_duplicates("key"), rest[kind == "next"]
        root, up = (later["key"].map(pd.Series(of["other"].to_numpy(), index=of["key"].to_numpy(), dtype=object)) for of in (roots, ups))
        answer = root.where(root.notna(), up)
        out = pd.DataFrame({"track_id": later["other"], "kind": np.where(root.notna(), "root", "up"), "other": answer}, dtype=object)
        left = pd.concat([ups, gone[~gone["key"].isin(roots["key"])], later[answer.isna()]])
        forgotten = roots["key"].isin(gone["key"])
        if forgotten.any():
            kept = roots[~forgotten]
            self.roots.put(self._pieces(kept)) if len(kept) else self.roots.clear()
        elif len(told):
            self.roots.appendList(self._pieces(told))
        self.open.put(self._pieces(left)) if len(left) else self.open.clear()
        yield out[answer.notna()]

    def close(self) -> None:
        pass


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of a bucket that lie in one batch as one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
        rows = pa.RecordBatch.from_arrays([batch[name].cast(pa.string()) for name in MESSAGE], names=MESSAGE).take(pa.array(order))
        ends = np.r_[starts[1:], len(order)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order][starts]), pa.array([packed(rows.slice(a, b - a))[0] for a, b in zip(starts, ends)], pa.binary())],
                                         names=["bucket", "rows"])


def hand_on(parts: DataFrame, log: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """New rows of the lineage log.

    parts: stream of track_id and exit_id (the track it continues, or null), one row per track; log: the stream of what
    this query has written so far; gone: stream of track_id that nothing can continue any more (as O64 gives them), whose
    state may go."""
    state_in_rocksdb(parts.sparkSession)

    def message(key: str, kind: str, other: str) -> Column:
        return F.struct(F.col(key).alias("key"), F.lit(kind).alias("kind"), F.col(other).alias("other"))

    def messages(rows: DataFrame, first: Column, one: list[Column], two: list[Column]) -> DataFrame:
        return rows.select(F.explode(F.when(first, F.array(*one)).otherwise(F.array(*two))).alias("m")).select("m.*")
    parts = parts.select(F.col("track_id").cast("string").alias("track_id"), F.col("exit_id").cast("string").alias("exit_id"))
    # the first part of a chain waits for its own root, so that the log has a row for it too
    told = messages(parts, F.col("exit_id").isNull(), [message("track_id", "root", "track_id"), message("track_id", "next", "track_id")],
                    [message("exit_id", "next", "track_id"), message("track_id", "up", "exit_id")])
    heard = messages(log.filter("track_id <> other"), F.col("kind") == "root", [message("track_id", "root", "other")], [message("other", "next", "track_id"), message("track_id", "up", "other")])
    told = told.unionByName(heard)
    if gone is not None:
        told = told.unionByName(gone.select(F.col("track_id").cast("string").alias("key"), F.lit("gone").alias("kind"), F.lit("").alias("other")))
    told = told.select(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket"), *MESSAGE).mapInArrow(_by_bucket, "bucket int, rows binary")
    return told.groupBy("bucket").transformWithStateInPandas(_HandOn(), outputStructType=LOG, outputMode="Append", timeMode="None")


def lineage_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream; the folder is made if it is not there yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    return spark.readStream.schema(LOG).parquet(path)


def follow(parts: DataFrame, path: str, checkpoint: str, gone: DataFrame | None = None) -> int:
    """Run over all parts that are there now, until nothing is handed on any more; returns the number of runs.

    A long-running query needs no such loop: its next micro-batch reads what the last one wrote."""
    runs = 0
    while True:
        rows = hand_on(parts, lineage_log(parts.sparkSession, path), gone)
        query = jobs.drain(jobs.append_sink(rows, path, checkpoint))
        runs += 1
        if not any(progress.numInputRows for progress in query.recentProgress):
            return runs


def global_ids(log: DataFrame) -> DataFrame:
    """``track_id, global_id`` as the batch operator gives them."""
    return log.filter("kind = 'root'").select("track_id", F.concat(F.lit("global_"), F.col("other")).alias("global_id"))
