"""Dimensions from JSON, tables, event store, enrolment, scoring."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hallwatch import schemas
from hallwatch.operators import state_tables, zones
from hallwatch.sources import dimensions, frames, scoring, stores

from conftest import ts


def _json(folder, name, rows):
    path = f"{folder}/{name}.json"
    with open(path, "w") as out:
        out.writelines(json.dumps(r) + "\n" for r in rows)
    return path


def test_cameras(spark, folder):
    path = _json(folder, "cameras", [
        {"camera_id": "a", "name": "Door", "url": "rtsp://user:pw@host", "exclusion_zones": [{"x1": 0.92, "y1": 0, "x2": 1, "y2": 0.6}]}, {"camera_id": "b", "fps": 10}])
    d = dimensions.read_cameras(spark, path)
    assert "url" not in d.columns
    assert {(r.camera_id, r.name, r.fps, len(r.exclusion_zones)) for r in d.collect()} == {("a", "Door", 5, 1), ("b", "b", 10, 0)}
    assert dimensions.exclusion_areas(d).first().asDict() == {"camera_id": "a", "x1": 0.92, "y1": 0.0, "x2": 1.0, "y2": 0.6}


def test_zones_and_edges(spark, folder):
    square = [[0, 0], [0.5, 0], [0.5, 1], [0, 1]]
    z = dimensions.read_zones(spark, _json(folder, "zones", [{"zone_ord": 0, "name": "hallway", "cameras": {"a": {"polygon": square}, "b": {"polygon": square}}}]))
    assert {(r.name, r.camera_id, r.max_handover_sec, len(r.polygon)) for r in z.collect()} == {("hallway", "a", 5.0, 4), ("hallway", "b", 5.0, 4)}
    e = dimensions.read_edges(spark, _json(folder, "edges", [{"cameras": ["a", "b"], "cam1_exit_zone": [0.8, 0, 1, 1], "cam2_entry_zone": [0, 0, 0.2, 1]}]))
    rows = sorted(e.collect(), key=lambda r: r.edge_ord)
    assert [(r.from_camera, r.to_camera, r.exit_zone[0], r.entry_zone[0], r.max_handover_sec) for r in rows] == [("a", "b", 0.8, 0.0, 3.0), ("b", "a", 0.0, 0.8, 3.0)]
    pairs = spark.createDataFrame([("a", "b"), ("a", "z")], "from_camera string, to_camera string")
    assert {(r.to_camera, r.limit_sec) for r in zones.handover_limit(pairs, e).collect()} == {("b", 3.0), ("z", 3.0)}


def test_first_zone_wins(spark):
    z = spark.createDataFrame([(1, "late", "a", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]), (0, "early", "a", [[0.0, 0.0], [0.5, 0.0], [0.5, 1.0], [0.0, 1.0]])],
                              "zone_ord int, name string, camera_id string, polygon array<array<double>>")
    d = spark.createDataFrame([("a", 0.0, 0.0, 20.0, 50.0), ("a", 70.0, 0.0, 90.0, 50.0), ("b", 0.0, 0.0, 20.0, 50.0)],
                              "camera_id string, x1 double, y1 double, x2 double, y2 double").withColumns({"frame_w": F.lit(100), "frame_h": F.lit(100)})
    assert [r.zone for r in zones.assign_zone(d, z).orderBy("camera_id", "x1").collect()] == ["early", "late", None]


def test_frame_table_keeps_its_schema(spark, folder):
    d = ts(spark.createDataFrame([("a", 1, 5, 1280, 720, 0.5)], "camera_id string, frame_number long, ms long, frame_w int, frame_h int, motion_ratio double"))
    d.select(*schemas.FRAMES.names).write.parquet(f"{folder}/f")
    assert frames.read_frames(spark, f"{folder}/f").schema == schemas.FRAMES
    assert frames.stream_frames(spark, f"{folder}/f").isStreaming


def test_event_store_and_retention(spark, folder):
    rows = ts(spark.createDataFrame([("a", 2 * i + h, int(dt.datetime(2024, 1, 1 + i, 18 * h, tzinfo=dt.timezone.utc).timestamp() * 1000)) for i in range(10) for h in (0, 1)],
                                    "camera_id string, event_id long, ms long"))
    stores.append_events(stores.as_events(rows, "track_created"), f"{folder}/e")
    stored = spark.read.parquet(f"{folder}/e")
    recent = stored.filter(F.col("day") >= F.lit(dt.date(2024, 1, 8)))
    assert "PartitionFilters: [isnotnull(day" in recent._jdf.queryExecution().toString()

    name = "house_" + folder.rsplit("-", 1)[1].lower()
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}/db'")
    stored.write.partitionBy("day").saveAsTable(f"{name}.events")
    stores.expire_events(spark, f"{name}.events", dt.datetime(2024, 2, 4, 12))  # limit: noon of January 5
    left = spark.table(f"{name}.events")
    assert {r.event_id for r in left.collect()} == set(range(9, 20))
    assert left.select("day").distinct().count() == 6
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_enrolment(spark, folder):
    faces = spark.createDataFrame([(1, [1.0], "a.jpg", None), (1, None, "b.jpg", None), (2, [2.0], "c.jpg", None)], "person_id long, embedding array<float>, source_image string, created_at timestamp")
    stores.append_enrolment(faces.repartition(2), f"{folder}/emb", first_id=100)
    got = spark.read.parquet(f"{folder}/emb").collect()
    assert {(r.person_id, r.source_image) for r in got} == {(1, "a.jpg"), (2, "c.jpg")}
    assert len({r.emb_id for r in got}) == 2 and min(r.emb_id for r in got) >= 100


def test_upsert_keeps_what_is_not_changed(spark):
    old = ts(spark.createDataFrame([("t", 5, "cam", "active", 100)], "track_id string, person_id long, last_camera_id string, status string, ms long"), name="first_seen")
    old = old.withColumn("last_seen", F.col("first_seen"))
    changes = ts(spark.createDataFrame([("t", 1, 300, None, "lost"), ("t", 2, 300, None, "active"), ("u", 3, 200, 9, None)], "track_id string, seq long, ms long, person_id long, status string"))
    got = {r.track_id: (r.person_id, r.last_camera_id, r.status) for r in stores.upsert_tracks(old, changes).collect()}
    assert got == {"t": (5, "cam", "active"), "u": (9, None, "active")}


def test_scoring_separates_failing_crops(spark):
    d = spark.createDataFrame([(1, 128, 256, 30.0, 500.0, [1.0, 2.0]), (2, 128, 50, 30.0, 500.0, [1.0, 2.0]), (3, 128, 256, None, 500.0, [1.0, 2.0])],
                              "crop_id long, width int, height int, mean_saturation double, laplacian_var double, pixels array<float>")

    def load():
        return lambda pixels: np.asarray(pixels) * 2

    got = {r.crop_id: (r.embedding, r.quality > 0) for r in scoring.score_crops(d, load, "pixels", 2, [2]).collect()}
    assert got == {1: ([2.0, 4.0], True), 2: ([0.0, 0.0], False), 3: ([0.0, 0.0], False)}


def test_a_cluster_must_name_its_checkpoint_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        state_tables.shared_folder(Session())
