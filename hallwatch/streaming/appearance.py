"""Reappearance as a stream: lost tracks and new tracks of one home, compared as they come.

Both sides are cut into time slots of ``slot_sec``, a lost track is copied into every slot it can still be found in, and a
(home, slot) is one state key, so a busy home is spread over time. Whatever comes first waits in list state for the
other side; pairs are scored as matrix blocks inside the processor, and only those over the threshold leave it. Once the
watermark has passed the end of a slot nothing can come for it any more and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from hallwatch.functions.clock import slot, to_micros
from hallwatch.operators.handover import EDGE_COLUMNS, look_alikes
from hallwatch.params import DEFAULTS, Params
from hallwatch.streaming.ordered import PACKED, packed, state_in_rocksdb, unpacked

LOST = ["exit_id", "from_camera", "exit_us", "until_us", "n_vectors", "flat"]
NEW = ["entry_id", "to_camera", "entry_us", "vec"]


class _Compare(StatefulProcessor):
    def __init__(self, slot_us: int, lost_ddl: str, new_ddl: str, p: Params):
        self.slot_us, self.p = slot_us, p
        self.lost_schema, self.new_schema = (to_arrow_schema(StructType.fromDDL(ddl)) for ddl in (lost_ddl, new_ddl))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lost, self.new = handle.getListState("lost", PACKED), handle.getListState("new", PACKED)

    @staticmethod
    def _stored(state: Any, schema: Any) -> Iterator[pd.DataFrame]:
        """Batch by batch, as the rows came; that bounds what a task holds beside its new rows."""
        for row in state.get():
            yield unpacked(row, schema).to_pandas()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        site, number = key
        self.handle.registerTimer((int(number) + 1) * self.slot_us // 1000)
        for pdf in rows:
            lost = pdf.loc[pdf["is_lost"], ["id", "camera_id", "us", "until_us", "n_vectors", "flat"]].set_axis(LOST, axis=1)
            new = pdf.loc[~pdf["is_lost"], ["id", "camera_id", "us", "flat"]].set_axis(NEW, axis=1)
            # new tracks against all lost ones known, then lost ones that came late against new tracks that wait
            for known in self._stored(self.lost, self.lost_schema):
                yield look_alikes(site, known, new, self.p)
            yield look_alikes(site, lost, new, self.p)
            for waiting in self._stored(self.new, self.new_schema):
                yield look_alikes(site, lost, waiting, self.p)
            for state, part, schema in ((self.lost, lost, self.lost_schema), (self.new, new, self.new_schema)):
                if len(part):
                    state.appendList([packed(part, schema)])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.lost.clear()
        self.new.clear()
        yield pd.DataFrame(columns=["site_id", *EDGE_COLUMNS, "score"], dtype=object)

    def close(self) -> None:
        pass


def reappearances(lost: DataFrame, entries: DataFrame, p: Params = DEFAULTS, slot_sec: float | None = None) -> DataFrame:
    """O41 on streams with watermarks on exit_ts and entry_ts; inputs and columns as in the batch operator."""
    state_in_rocksdb(lost.sparkSession)
    length, window = slot_sec or max(p.chunk_sec, p.reappear_sec), to_micros(p.reappear_sec)
    no_end = F.lit(2**62).cast("long")
    us = F.unix_micros("exit_ts")
    x = lost.filter(F.size("vectors") > 0).select(
        "site_id", F.explode(F.sequence(slot(us, length), slot(us + window, length))).alias("slot"), F.lit(True).alias("is_lost"), F.col("exit_id").alias("id"), "camera_id", us.alias("us"),
        (F.coalesce("until_us", no_end) if "until_us" in lost.columns else no_end).alias("until_us"), F.size("vectors").alias("n_vectors"), F.flatten("vectors").alias("flat"), F.col("exit_ts").alias("ts"))
    us = F.unix_micros("entry_ts")
    e = entries.filter((F.col("quality") >= p.min_visibility) & F.col("embedding").isNotNull()).select(
        "site_id", slot(us, length).alias("slot"), F.lit(False).alias("is_lost"), F.col("entry_id").alias("id"), "camera_id", us.alias("us"), no_end.alias("until_us"),
        F.lit(1).alias("n_vectors"), F.col("embedding").alias("flat"), F.col("entry_ts").alias("ts"))
    kind = {c: entries.schema[c].dataType.simpleString() for c in ("site_id", "entry_id")}
    ddl = f"site_id {kind['site_id']}, entry_id {kind['entry_id']}, exit_id {kind['entry_id']}, from_camera string, to_camera string, exit_us long, entry_us long, score double"
    both = x.unionByName(e)
    flat = both.schema["flat"].dataType.simpleString()
    logic = _Compare(to_micros(length), f"exit_id {kind['entry_id']}, from_camera string, exit_us long, until_us long, n_vectors int, flat {flat}",
                     f"entry_id {kind['entry_id']}, to_camera string, entry_us long, vec {flat}", p)
    return both.groupBy("site_id", "slot").transformWithStateInPandas(logic, outputStructType=ddl, outputMode="Append", timeMode="EventTime")
