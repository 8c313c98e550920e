"""Ordered operators across slot boundaries, against plain sequential models."""

import random
import time
from collections import defaultdict
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hallwatch.operators import gates, handover, identity, reports, throttle, timeline, tracker
from hallwatch.params import DEFAULTS

from conftest import ts

SHORT = replace(DEFAULTS, chunk_sec=10)


def _log(seed, keys=3, rows=400, step=1500):
    rng = random.Random(seed)
    out, now = [], 0
    for i in range(rows):
        now += rng.randint(1, step)
        out.append((f"k{rng.randrange(keys) if rng.random() > 0.4 else 0}", i, now, rng.random() < 0.15, rng.choice([None, 1, 1, 2, 3])))
    return out


def _frame(spark, rows):
    return ts(spark.createDataFrame(rows, "key string, n long, ms long, flag boolean, value long").repartition(5))


@pytest.mark.parametrize("seed", [1, 2])
def test_running_last_sum_and_number(spark, seed):
    rows = _log(seed)
    d = _frame(spark, rows)
    us = F.unix_micros("ts")
    d = timeline.running_last(d, ["key"], ["n"], us, F.col("value"), "last", 7)
    d = timeline.running_last(d, ["key"], ["n"], us, F.col("value"), "before", 7, inclusive=False)
    d = timeline.running_sum(d, ["key"], ["n"], us, F.col("flag").cast("long"), "flags", 7)
    d = timeline.row_number(d, ["key"], ["n"], us, "position", 7)
    got = {r.n: r for r in d.collect()}
    last, flags, count = {}, defaultdict(int), defaultdict(int)
    for key, n, _, flag, value in rows:
        assert got[n].before == last.get(key)
        last[key] = value if value is not None else last.get(key)
        flags[key] += flag
        count[key] += 1
        assert (got[n].last, got[n].flags, got[n].position) == (last[key], flags[key], count[key])


@pytest.mark.parametrize("seed,interval,strict", [(1, 5.0, False), (2, 5.0, True), (3, 0.3, False), (4, 60.0, True)])
def test_throttle(spark, seed, interval, strict, monkeypatch):
    rows = [(k, n, (ms // 500) * 500, f, v) for k, n, ms, f, v in _log(seed, rows=600)]
    seen, kept, last = set(), [], {}
    for key, n, ms, *_ in rows:
        if (key, ms) in seen:
            continue
        seen.add((key, ms))
        if key not in last or ms - last[key] > interval * 1000 or (ms - last[key] == interval * 1000 and not strict):
            kept.append(n)
            last[key] = ms
    monkeypatch.setattr(throttle, "INTERVALS_PER_SLOT", 2)  # many short slots
    got = throttle.keep_spaced(_frame(spark, rows), ["key"], interval, strict, order="n", slot_sec=1)
    assert sorted(r.n for r in got.collect()) == kept
    rest = sorted((r.key, r.ts.timestamp()) for r in got.collect())
    for (ka, a), (kb, b) in zip(rest, rest[1:]):
        assert ka != kb or b - a >= interval


def test_motion_gate(spark):
    rows = [(k, n, ms, 0.5 if f else 0.01) for k, n, ms, f, _ in _log(5, step=3000)]
    d = ts(spark.createDataFrame(rows, "camera_id string, frame_number long, ms long, motion_ratio double"))
    got = {r.frame_number: r.has_motion for r in gates.motion_gate(d, SHORT).collect()}
    last = {}
    for cam, n, ms, ratio in rows:
        if ratio > 0.01:
            last[cam] = ms
        assert got[n] == (cam in last and ms - last[cam] < 5000)
    off = gates.motion_gate(d, replace(DEFAULTS, motion_enabled=False)).collect()
    assert all(r.has_motion and r.motion_ratio == 1.0 for r in off)


def test_stationary(spark):
    rows = [("cam", int(k[1:]), n, ms, f) for k, n, ms, f, _ in _log(6, step=4000)]
    d = ts(spark.createDataFrame(rows, "camera_id string, track_id long, frame_number long, ms long, has_motion boolean"))
    p = replace(SHORT, stationary_timeout_sec=20.0)
    got = {r.frame_number: r for r in tracker.stationary(d, p).collect()}
    since = {}
    for _, track, n, ms, motion in rows:
        if motion:
            since.pop(track, None)
        else:
            since.setdefault(track, ms)
        want = None if motion else (ms - since[track]) // 1000
        assert got[n].stationary_sec == want
        assert got[n].expired == (not motion and ms - since[track] > 20000)
    never = tracker.stationary(d, replace(SHORT, stationary_timeout_sec=0.0))
    assert never.filter("expired").count() == 0


@pytest.mark.parametrize("need", [1, 2, 3])
def test_confirmation(spark, need):
    rows = [(int(k[1:]), n, ms, v) for k, n, ms, _, v in _log(7, keys=12)]
    d = ts(spark.createDataFrame(rows, "track_id long, obs_id long, ms long, candidate long").repartition(6))
    got = {r.track_id: (r.obs_id, r.person_id) for r in identity.confirm_faces(d, replace(SHORT, face_consecutive=need)).collect()}
    state, want = {}, {}
    for track, n, _, person in rows:
        if person is None or track in want:
            continue
        who, run = state.get(track, (None, 0))
        state[track] = (person, run + 1 if who == person else 1)
        if state[track][1] >= need:
            want[track] = (n, person)
    assert got == want


def test_sightings(spark):
    rng = random.Random(8)
    rows = [(f"t{rng.randrange(5)}", "cam", i * 700, rng.choice(["entry", "exit"]), f"z{i % 3}", i) for i in range(300)]
    d = ts(spark.createDataFrame(rows, "track_id string, camera_id string, ms long, kind string, zone string, seq long"))
    got = sorted((r.track_id, r.entered_at.timestamp(), r.exited_at.timestamp() if r.exited_at else None, r.entry_zone, r.exit_zone)
                 for r in reports.sightings(d, SHORT).collect())
    want = []
    for i, (track, _, ms, kind, zone, _) in enumerate(rows):
        if kind == "entry":
            after = next((r for r in rows[i + 1:] if r[0] == track), None)
            closed = after is not None and after[3] == "exit"
            want.append((track, ms / 1000, after[2] / 1000 if closed else None, zone, after[4] if closed else None))
    assert got == sorted(want)


def test_carry_forward(spark):
    rows = [("cam", n, n * 1000, True, n % 4 == 1) for n in range(1, 41)] + [("cam", 41, 41000, False, False)]
    s = ts(spark.createDataFrame(rows, "camera_id string, frame_number long, ms long, process boolean, detect boolean"))
    det = ts(spark.createDataFrame([("cam", n, n * 1000, i) for n in range(1, 41) for i in range(n % 3)], "camera_id string, frame_number long, ms long, det_id long"))
    got = gates.carry_detections(s, det, SHORT).collect()
    for n in range(1, 41):
        source = n - (n - 1) % 4
        ids = sorted(r.det_id for r in got if r.frame_number == n and r.det_id is not None)
        assert ids == list(range(source % 3)) and all(r.source_frame == source for r in got if r.frame_number == n)
    assert not [r for r in got if r.frame_number == 41]


# ---- one-to-one resolution ------------------------------------------------------------------

def _sequential(edges, prefer):
    gone, out, by_entry = set(), {}, defaultdict(list)
    for e in edges:
        by_entry[e["group"], e["entry_us"], e["entry_id"]].append(e)
    for (group, _, entry), options in sorted(by_entry.items()):
        for e in sorted(options, key=lambda e: (prefer(e), e["exit_id"])):
            if (group, e["exit_id"]) not in gone:
                gone.add((group, e["exit_id"]))
                out[group, entry] = e["exit_id"]
                break
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resolve_equals_sequential_rule(spark, seed):
    rng = random.Random(seed)
    edges = []
    for g in ("a", "b"):
        exits = sorted((rng.randrange(100_000_000), i) for i in range(120))
        for entry in range(120):
            at = rng.randrange(100_000_000)
            for us, x in exits:
                if us <= at <= us + 6_000_000:
                    edges.append(dict(group=g, entry_id=entry, exit_id=x, entry_us=at, exit_us=us, score=rng.random()))
    d = spark.createDataFrame([tuple(e.values()) for e in edges], "group string, entry_id long, exit_id long, entry_us long, exit_us long, score double").repartition(7)
    for slot in (3, 1000):
        got = {(r.group, r.entry_id): r.exit_id for r in handover.resolve(d, ["group"], ["exit_us"], slot).collect()}
        assert got == _sequential(edges, lambda e: e["exit_us"])
        assert len(set((g, x) for (g, _), x in got.items())) == len(got)
    ranked = d.withColumn("worse", -F.col("score"))
    got = {(r.group, r.entry_id): r.exit_id for r in handover.resolve(ranked, ["group"], ["worse"], 3).collect()}
    assert got == _sequential(edges, lambda e: -e["score"])


def test_resolve_one_endless_chain(spark):
    """Every answer depends on the one before it, across many slots."""
    edges = [("a", n, n - d, n * 1_000_000, (n - d) * 1_000_000) for n in range(60) for d in (0, 1)]
    d = spark.createDataFrame(edges, "group string, entry_id long, exit_id long, entry_us long, exit_us long")
    got = {r.entry_id: r.exit_id for r in handover.resolve(d, ["group"], ["exit_us"], 2).collect()}
    assert got == {n: n - 1 for n in range(60)}


def test_lineage_of_long_chains(spark):
    n = 70
    parts = spark.range(n + 5).select(F.col("id").alias("track_id"))
    links = spark.range(1, n).select(F.col("id").alias("entry_id"), (F.col("id") - 1).alias("exit_id")).union(spark.createDataFrame([(n + 1, 999)], "entry_id long, exit_id long"))
    got = {r.track_id: r.global_id for r in identity.global_lineage(parts, links).collect()}
    assert got == {i: "global_0" if i < n else f"global_{i}" for i in range(n + 5)}


def test_throttle_of_many_keys_of_few_rows(spark):
    """A call per (key, slot) would take minutes; places that go on over several Arrow batches are whole."""
    d = spark.range(400_000).select((F.col("id") % 100_000).alias("key"), F.col("id").alias("n"), F.timestamp_millis(F.col("id") * 10).alias("ts"))
    begin = time.monotonic()
    kept = throttle.keep_spaced(d, ["key"], 1500.0, order="n")  # a key's rows are 1,000 seconds apart
    assert kept.agg(F.count(F.lit(1)), F.sum("n")).first() == (200_000, sum(range(100_000)) + sum(range(200_000, 300_000)))
    assert time.monotonic() - begin < 90
    log = pd.DataFrame({"key": [None, None, "a", "a", "a", "b"], "slot": [1, 1, 1, 2, 2, 2], "n": range(6)})
    whole = list(throttle._whole_places((log.iloc[i:i + 1] for i in range(6)), ["key", "slot"]))
    assert [t["n"].tolist() for t, _ in whole] == [[0, 1], [2], [3, 4], [5]]
