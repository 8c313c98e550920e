"""Boxes, polygons, vectors, quality, labels and time windows against hand-computed values."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hallwatch.functions import boxes, labels, polygons, quality, vectors
from hallwatch.functions.boxes import box
from hallwatch.functions.clock import window_length
from hallwatch.operators import overlap
from hallwatch.params import DEFAULTS

PAIRS = [  # name, first box, second box, IoU, first covered, second covered, overlapping at 0.15
    ("adult holding child", (100, 50, 300, 500), (120, 200, 280, 480), 0.497778, 0.497778, 1.0, True),
    ("adult and child side by side", (100, 50, 280, 500), (220, 150, 350, 480), 0.190202, 0.244444, 0.461538, True),
    ("two adults passing", (100, 50, 250, 450), (200, 50, 350, 450), 0.2, 0.333333, 0.333333, True),
    ("two adults apart", (50, 50, 200, 450), (300, 50, 450, 450), 0.0, 0.0, 0.0, False),
    ("child inside adult box", (100, 50, 350, 550), (150, 100, 300, 350), 0.3, 0.3, 1.0, True),
    ("two people hugging", (100, 50, 280, 500), (120, 60, 300, 510), 0.768559, 0.869136, 0.869136, True),
]
BOX = "x1 double, y1 double, x2 double, y2 double"


def test_box_pairs(spark):
    rows = [(n, *map(float, a), *map(float, b)) for n, a, b, *_ in PAIRS]
    d = spark.createDataFrame(rows, f"name string, {BOX}, ox1 double, oy1 double, ox2 double, oy2 double")
    a, b = box(), box("o")
    got = {r.name: r for r in d.select("name", boxes.iou(a, b).alias("iou"), boxes.iou(b, a).alias("back"), boxes.covered(a, b).alias("first"),
                                       boxes.covered(b, a).alias("second"), boxes.smaller_covered(a, b).alias("smaller")).collect()}
    for name, _, _, iou, first, second, _ in PAIRS:
        r = got[name]
        assert (round(r.iou, 6), round(r.first, 6), round(r.second, 6)) == (iou, first, second)
        assert r.iou == r.back and 0 <= r.iou <= 1 and r.smaller == max(r.first, r.second)


def test_degenerate_boxes_have_no_overlap(spark):
    d = spark.createDataFrame([(1.0, 1.0, 1.0, 5.0)], BOX)
    assert d.select(boxes.iou(box(), box())).first()[0] == 0.0
    assert d.select(boxes.covered(box(), box())).first()[0] == 0.0


def test_overlapping_tracks(spark):
    rows = [("cam", n, i, *map(float, b)) for n, (_, a, c, *_) in enumerate(PAIRS) for i, b in enumerate((a, c))]
    d = spark.createDataFrame(rows, f"camera_id string, frame_number long, track_id long, {BOX}")
    want = {n for n, p in enumerate(PAIRS) if p[-1]}
    for cell in (37.0, 320.0, 5000.0):
        pairs = overlap.overlapping_pairs(d, cell=cell).collect()
        assert sorted(r.frame_number for r in pairs) == sorted(want)
        assert {(r.frame_number, r.track_id) for r in overlap.crowded(d, cell=cell).collect()} == {(n, i) for n in want for i in (0, 1)}
    from dataclasses import replace
    assert overlap.crowded(d, replace(DEFAULTS, overlap_iou=0.0)).count() == 0
    assert overlap.overlapping_pairs(d, p=replace(DEFAULTS, overlap_iou=0.0)).count() == 0


def test_equal_boxes_crowd_each_other_without_pairs(spark):
    rows = [("cam", 1, i, 0.0, 0.0, 50.0, 90.0) for i in range(500)] + [("cam", 1, 900, 600.0, 0.0, 650.0, 90.0)]
    d = spark.createDataFrame(rows, f"camera_id string, frame_number long, track_id long, {BOX}")
    assert {r.track_id for r in overlap.crowded(d).collect()} == set(range(500))


def _inside(x, y, polygon):
    hit, j = False, len(polygon) - 1
    for i, (px, py) in enumerate(polygon):
        qx, qy = polygon[j]
        if (py > y) != (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px:
            hit = not hit
        j = i
    return hit


@pytest.mark.parametrize("polygon", [
    [[0.0, 0.2], [0.4, 0.2], [0.4, 1.0], [0.0, 1.0]], [[0.2, 0.1], [0.8, 0.5], [0.2, 1.0]],
    [[0.1, 0.1], [0.9, 0.1], [0.5, 0.4], [0.9, 0.9], [0.1, 0.9]], [[0.1, 0.1], [0.9, 0.9]]])
def test_point_in_polygon(spark, polygon):
    points = [(float(x), float(y)) for x in np.linspace(0, 1, 21) for y in np.linspace(0, 1, 21)]
    d = spark.createDataFrame(points, "x double, y double").withColumn("p", F.array(*[F.array(*map(F.lit, v)) for v in polygon]))
    got = {(r.x, r.y): r.hit for r in d.select("x", "y", polygons.inside(F.col("x"), F.col("y"), polygons.edges_of(F.col("p"))).alias("hit")).collect()}
    for x, y in points:
        assert got[x, y] == (len(polygon) >= 3 and _inside(x, y, polygon))


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [([float(v) for v in rng.normal(size=8)], [float(v) for v in rng.normal(size=8)]) for _ in range(20)] + [([0.0] * 8, [1.0] * 8)]
    d = spark.createDataFrame(rows, "a array<float>, b array<float>")
    out = d.select("a", "b", vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.unit(F.col("a")).alias("u")).collect()
    for r in out:
        a, b = np.array(r.a), np.array(r.b)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        assert math.isclose(r.c, a @ b / n if n else 0.0, abs_tol=1e-12)
        assert math.isclose(np.linalg.norm(r.u), 1.0 if n else 0.0, abs_tol=1e-12)


def test_median(spark):
    d = spark.createDataFrame([([3.0, 1.0, 2.0],), ([4.0, 1.0, 2.0, 3.0],), ([7.0],), ([],)], "v array<double>")
    assert [r[0] for r in d.select(vectors.median_of(F.col("v"))).collect()] == [2.0, 2.5, 7.0, None]


def test_blob_round_trip(spark):
    d = spark.createDataFrame([([1.5, -2.25],), (None,)], "v array<float>")
    out = d.withColumn("b", vectors.to_blob("v")).withColumn("w", vectors.from_blob("b")).collect()
    assert out[0].b == np.array([1.5, -2.25], "<f4").tobytes() and out[0].w == [1.5, -2.25] and out[1].w is None


def test_crop_quality(spark):
    d = spark.createDataFrame([(128, 256, 30.0, 500.0), (64, 128, 30.0, 0.0), (128, 99, 30.0, 500.0), (29, 256, 30.0, 500.0), (128, 256, 14.9, 500.0), (128, 256, None, 500.0)],
                              "w int, h int, s double, l double")
    got = [r[0] for r in d.select(quality.gated_score(*(F.col(c) for c in "whsl"))).collect()]
    assert math.isclose(got[0], 1.0, abs_tol=1e-6)
    assert math.isclose(got[1], 0.4 * 0.25 + 0.3, abs_tol=1e-6)
    assert got[2:] == [0.0, 0.0, 0.0, 0.0]


def test_labels(spark):
    none, no = F.lit(None).cast("string"), F.lit(None).cast("double")
    d = spark.range(1)

    def label(**given):
        base = dict(track_id=F.lit("global_7"), person_name=none, by_reid=F.lit(False), confidence=no, closest_name=none, closest_score=no,
                    reid_score=F.lit(-1.0), zone=none, cameras_seen=F.lit(1), stationary_sec=F.lit(None).cast("int"))
        return d.select(labels.track_label(**{**base, **given})).first()[0]

    assert label() == "#7"
    assert label(person_name=F.lit("Ann"), confidence=F.lit(0.854)) == "Ann (F:0.85)"
    assert label(person_name=F.lit("Ann"), by_reid=F.lit(True), confidence=F.lit(0.7), zone=F.lit("hall")) == "Ann (R:0.70) [hall]"
    assert label(closest_name=F.lit("Bob"), closest_score=F.lit(0.41), reid_score=F.lit(0.45), zone=F.lit("hall"), cameras_seen=F.lit(2),
                 stationary_sec=F.lit(12)) == "#7 ~Bob(0.41) R:0.45 [hall] * S:12s"


@pytest.mark.parametrize("text,hours", [("1h", 1), ("24h", 24), ("7d", 168), ("", 24), ("week", 24), ("3m", 24)])
def test_window_text(text, hours):
    assert window_length(text) == dt.timedelta(hours=hours)


def test_fixed_defaults():
    assert (DEFAULTS.multi_face_min_size, DEFAULTS.min_face_size) == (20, 80)
    assert DEFAULTS.face_check_sec == 2.0
