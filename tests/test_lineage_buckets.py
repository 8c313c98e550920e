"""Tracks of a bucket share their state: calls to it do not grow with the tracks."""

import pandas as pd
import pyarrow as pa

from hallwatch.streaming.lineage import MESSAGE, _by_bucket, _HandOn
from hallwatch.streaming.ordered import unpacked


class Listed:
    def __init__(self):
        self.rows, self.calls = [], 0

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def appendList(self, rows):
        self.calls, self.rows = self.calls + 1, self.rows + list(rows)

    def clear(self):
        self.calls, self.rows = self.calls + 1, []


class Handle:
    def __init__(self):
        self.lists = {}

    def getListState(self, name, schema):
        return self.lists.setdefault(name, Listed())


def _ask(logic, messages):
    batch = pa.RecordBatch.from_pandas(pd.DataFrame([(0, *m) for m in messages], columns=["bucket", *MESSAGE]), preserve_index=False)
    rows = pa.Table.from_batches(_by_bucket(iter([batch]))).to_pandas()
    return sorted(tuple(r) for out in logic.handleInputRows((0,), iter([rows]), None) for r in out.itertuples(index=False))


def test_hand_on():
    logic, handle = _HandOn(), Handle()
    logic.init(handle)
    assert _ask(logic, [("a", "next", "b"), ("b", "up", "a"), ("b", "next", "c"), ("c", "up", "b")]) == [("c", "up", "a")]
    assert _ask(logic, [("a", "next", "c"), ("c", "up", "a")]) == []
    assert _ask(logic, [("a", "root", "a"), ("a", "next", "a")]) == [("a", "root", "a"), ("b", "root", "a"), ("c", "root", "a")]
    assert _ask(logic, [("b", "root", "a"), ("c", "root", "a"), ("c", "next", "d")]) == [("d", "root", "a")]
    assert _ask(logic, [("a", "gone", ""), ("x", "gone", "")]) == []
    left = {name: {(r["key"], r["kind"]) for row in s.rows for r in unpacked(row, logic.arrow).to_pylist()} for name, s in handle.lists.items()}
    assert left == {"roots": {("b", "root"), ("c", "root")}, "open": {("x", "gone")}}
    assert _ask(logic, [("x", "root", "x"), ("x", "next", "y")]) == [("y", "root", "x")]
    assert all(r["key"] != "x" for s in handle.lists.values() for row in s.rows for r in unpacked(row, logic.arrow).to_pylist())


def test_calls_do_not_grow_with_tracks():
    logic, handle = _HandOn(), Handle()
    logic.init(handle)
    n = 5000
    assert len(_ask(logic, [(f"t{k}", kind, f"t{k}") for k in range(n) for kind in ("root", "next")])) == n
    assert sum(s.calls for s in handle.lists.values()) < 10
