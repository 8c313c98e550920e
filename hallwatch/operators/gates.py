"""Row filters and gates on frames, detections, faces and crops."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from hallwatch.functions import boxes, quality
from hallwatch.functions.boxes import box
from hallwatch.functions.clock import before, micros, to_micros, window_length
from hallwatch.operators import timeline
from hallwatch.params import DEFAULTS, Params


# ---- detections -----------------------------------------------------------------------------

def person_filter(detections: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Persons at or above the confidence threshold; both predicates reach the scan."""
    return detections.filter((F.col("class_id") == p.person_class) & (F.col("confidence") >= p.detection_confidence))


def min_height_filter(detections: DataFrame, pixels: float) -> DataFrame:
    """O15."""
    return detections.filter(boxes.height(box()) >= pixels)


def crop_windows(rows: DataFrame) -> DataFrame:
    """Whole-pixel crop of each box inside its frame; empty crops are dropped."""
    c = boxes.clip(box(), F.col("frame_w"), F.col("frame_h"))
    out = rows.withColumns({"crop_x1": c.x1, "crop_y1": c.y1, "crop_x2": c.x2, "crop_y2": c.y2})
    return out.filter((F.col("crop_x2") > F.col("crop_x1")) & (F.col("crop_y2") > F.col("crop_y1")))


def exclusion_filter(detections: DataFrame, cameras: DataFrame) -> DataFrame:
    """Drop a detection whose normalised center is in any exclusion rectangle of its camera.

    Rectangles stay an array on the one row per camera, so the join keeps one output row per
    detection and nothing is regrouped afterwards.
    """
    areas = cameras.select("camera_id", F.col("exclusion_zones").alias("_areas"))
    cx = boxes.center_x(box()) / F.col("frame_w")
    cy = boxes.center_y(box()) / F.col("frame_h")
    hit = F.exists(
        "_areas", lambda a: (a["x1"] <= cx) & (cx <= a["x2"]) & (a["y1"] <= cy) & (cy <= a["y2"])
    )
    return (detections.join(areas, "camera_id", "left")
            .filter(~F.coalesce(hit, F.lit(False))).drop("_areas"))


def static_filter(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Flag ``is_static`` where a track moved less than ``static_shift`` over ``static_sec``.

    Needs camera_id, track_id, ts and the normalised center cx, cy. A track younger than the span
    is never static.
    """
    track = ["camera_id", "track_id"]
    us = micros(F.col("ts"))
    born = rows.groupBy(*track).agg(F.min(us).alias("_born"))
    d = timeline.with_lookback(rows.withColumn("_us", us), F.col("_us"), p.chunk_sec, p.static_sec)
    w = (Window.partitionBy(*track, "slot").orderBy("_us")
         .rangeBetween(-to_micros(p.static_sec), Window.currentRow))

    def moved(c):
        return F.max(c).over(w) - F.min(c).over(w)

    still = (moved("cx") < p.static_shift) & (moved("cy") < p.static_shift)
    old = F.col("_us") - F.col("_born") >= to_micros(p.static_sec)
    return (d.withColumn("_still", still).filter(~F.col("is_copy"))
            .join(born, track).withColumn("is_static", F.col("_still") & old)
            .drop("_still", "_born", "_us", "slot", "is_copy"))


# ---- faces ----------------------------------------------------------------------------------

def face_size_filter(faces: DataFrame, pixels: int) -> DataFrame:
    """The shorter side of the face reaches ``pixels``."""
    return faces.filter(F.least(boxes.width(box()), boxes.height(box())) >= pixels)


def upper_half_faces(faces: DataFrame) -> DataFrame:
    """Faces whose center lies in the upper half of the person box ``person_x1 .. person_y2``."""
    person = boxes.Box(*(c.cast("int") for c in box("person_")))
    bottom = person.y1 + (boxes.height(person) * F.lit(0.5)).cast("int")
    cx, cy = boxes.center_x(box()), boxes.center_y(box())
    return faces.withColumn("region_y2", bottom).filter(
        (cx >= person.x1) & (cx <= person.x2) & (cy >= person.y1) & (cy <= bottom)
    )


def multi_face_crops(faces: DataFrame, crop_key: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Per crop the faces found at both sizes, and what they forbid."""
    side = F.least(boxes.width(box()), boxes.height(box()))
    large = F.count_if(side >= p.min_face_size)
    small = F.count_if(side >= p.multi_face_min_size)
    return (faces.groupBy(*crop_key).agg(large.alias("large_faces"), small.alias("small_faces"))
            .withColumn("blocks_appearance", F.col("small_faces") > 1)
            .withColumn("blocks_recognition", F.col("large_faces") > 1))


def without_multi_face(crops: DataFrame, faces: DataFrame, crop_key: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Crops usable for appearance work: no second face of the small size in them."""
    blocked = multi_face_crops(faces, crop_key, p).filter("blocks_appearance").select(*crop_key)
    return crops.join(blocked, crop_key, "left_anti")


# ---- crops ----------------------------------------------------------------------------------

def crop_quality(crops: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """O19 + O20 + O21: gates as flags and the resulting quality (0 when a gate fails)."""
    w, h, sat, lap = (F.col(c) for c in ("width", "height", "mean_saturation", "laplacian_var"))
    return crops.withColumns({
        "size_ok": quality.usable_size(w, h, p),
        "colour_ok": quality.in_colour(sat, p),
        "raw_quality": quality.crop_score(w, h, lap),
        "quality": quality.gated_score(w, h, sat, lap, p),
    })


def gallery_grade(crops: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """O22, lower gate: good enough to enter or query a gallery."""
    return crops.filter(F.col("quality") >= p.min_gallery_quality)


def handover_grade(crops: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """O22, upper gate: good enough to compare across cameras."""
    return crops.filter(F.col("quality") >= p.min_visibility)


def single_person_rows(rows: DataFrame, key: list[str], crowded: DataFrame) -> DataFrame:
    """Rows whose track (``key``) is not among the overlapping ones."""
    return rows.join(crowded.select(*key).distinct(), key, "left_anti")


def single_person_frames(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """O23, frame form: rows of frames that show exactly one person.

    A frame with one row is its own representative, so the count needs no join back.
    """
    keep = [c for c in rows.columns if c not in ("camera_id", "frame_number")]
    whole = F.struct(*keep)
    return (rows.groupBy("camera_id", "frame_number")
            .agg(F.count(F.lit(1)).alias("_n"), F.first(whole).alias("_row"))
            .filter("_n = 1").select("camera_id", "frame_number", "_row.*"))


# ---- frames ---------------------------------------------------------------------------------

def motion_gate(frames: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Add ``has_motion``: motion now, or less than the cool-down since the last such frame.

    A disabled gate reports motion everywhere with ratio 1.
    """
    if not p.motion_enabled:
        return frames.withColumns({"has_motion": F.lit(True), "motion_ratio": F.lit(1.0)})
    raw = F.col("motion_ratio") > p.motion_min_ratio
    d = timeline.with_lookback(frames.withColumn("_us", micros(F.col("ts"))), F.col("_us"),
                               p.chunk_sec, p.motion_cooldown_sec)
    w = Window.partitionBy("camera_id", "slot").orderBy("_us").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(raw, F.col("_us")), ignorenulls=True).over(w)
    cooling = F.coalesce(F.col("_us") - last < to_micros(p.motion_cooldown_sec), F.lit(False))
    return (d.withColumn("has_motion", raw | cooling).filter(~F.col("is_copy"))
            .drop("_us", "slot", "is_copy"))


def in_warmup(p: Params = DEFAULTS) -> Column:
    return F.col("frame_number") <= p.warmup_frames


def detection_schedule(frames: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Add ``process`` (frame is looked at) and ``detect`` (the detector runs on it).

    Needs has_motion and active (tracks alive on the camera before this frame).
    """
    warm, active = in_warmup(p), F.col("active")
    process = F.col("has_motion") | active | warm
    due = warm | (F.col("frame_number") % F.lit(max(1, p.frame_skip)) == 0) | active
    return frames.withColumns({"process": process, "detect": process & due})


def carry_detections(schedule: DataFrame, detections: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """On processed frames without detection, the detections of the latest frame that had one.

    Output: frame columns + ``source_frame``, joined with the detections of that frame (outer, so
    frames with nothing to show stay as one row without a box).
    """
    looked_at = schedule.filter("process")
    with_source = timeline.running_last(
        looked_at, ["camera_id"], ["frame_number"], micros(F.col("ts")),
        F.when(F.col("detect"), F.col("frame_number")), "source_frame", p.chunk_sec,
    )
    found = detections.drop("ts").withColumnRenamed("frame_number", "source_frame")
    return with_source.join(found, ["camera_id", "source_frame"], "left")


# ---- time window ----------------------------------------------------------------------------

def recent(rows: DataFrame, now: dt.datetime, window: str = "24h", ts: str = "ts") -> DataFrame:
    """Rows not older than a window given as text, seen from ``now``."""
    return rows.filter(F.col(ts) >= before(now, window_length(window)))
