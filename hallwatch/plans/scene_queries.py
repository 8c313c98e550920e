"""Queries over cameras, frames, detections, faces and crops."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from hallwatch.functions import boxes, labels
from hallwatch.functions.boxes import Box, box
from hallwatch.operators import gates, overlap, zones
from hallwatch.params import DEFAULTS
from hallwatch.plans.oracle_views import B, sql
from hallwatch.plans.registry import query, r6, whole
from hallwatch.plans.views import EXCLUSION, NOW, Views, t_ms
from hallwatch.sources import dimensions

DET = ["camera_id", "frame_number", "det_id"]


# ---- dimensions -----------------------------------------------------------------------------

@query("O01", check=sql("""SELECT concat('cam_', s_suppkey) AS camera_id, CASE WHEN s_suppkey%2=0 THEN s_name ELSE concat('cam_', s_suppkey) END AS name,
    CASE WHEN s_suppkey%4 <> 0 THEN CAST(s_suppkey%30 AS BIGINT) ELSE 5 END AS fps,
    CASE WHEN s_suppkey%6 = 0 THEN 0 ELSE s_suppkey%3 END AS areas FROM supplier"""))
def camera_dimension(v: Views) -> DataFrame:
    return dimensions.camera_dimension(v.camera_config()).select("camera_id", "name", *whole("fps"), F.size("exclusion_zones").cast("long").alias("areas"))


@query("O01", check=sql("""SELECT concat('cam_', s_suppkey) AS camera_id, round((s_suppkey%5)/10.0::DOUBLE, 6) AS x1, 0.0::DOUBLE AS y1,
    round((s_suppkey%5)/10.0::DOUBLE + 0.2::DOUBLE, 6) AS x2, 0.5::DOUBLE AS y2 FROM supplier, range(2) r(i) WHERE s_suppkey%6 <> 0 AND i < s_suppkey%3"""))
def exclusion_areas(v: Views) -> DataFrame:
    return dimensions.exclusion_areas(dimensions.camera_dimension(v.camera_config())).select("camera_id", *[r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("O02", check=sql("SELECT zone_ord, name, camera_id, max_handover_sec, 3::BIGINT AS points, round(px + 0.4::DOUBLE, 6) AS right_x FROM zone_dim", "zone_dim"))
def zone_dimension(v: Views) -> DataFrame:
    z = dimensions.zone_dimension(v.zone_config())
    return z.select(*whole("zone_ord"), "name", "camera_id", "max_handover_sec", F.size("polygon").cast("long").alias("points"), r6(F.col("polygon")[1][0]).alias("right_x"))


@query("O03", check=sql("SELECT edge_ord, from_camera, to_camera, exit_x1, exit_x2, entry_x1, entry_x2, max_handover_sec FROM overlap_edges", "overlap_edges"))
def camera_topology(v: Views) -> DataFrame:
    e = dimensions.edge_dimension(v.overlap_config())
    return e.select("edge_ord", "from_camera", "to_camera", F.col("exit_zone")[0].alias("exit_x1"), F.col("exit_zone")[2].alias("exit_x2"),
                    F.col("entry_zone")[0].alias("entry_x1"), F.col("entry_zone")[2].alias("entry_x2"), "max_handover_sec")


@query("O43", check=sql("""SELECT DISTINCT from_camera AS camera_id, to_camera AS connected FROM overlap_edges
    UNION SELECT DISTINCT to_camera, from_camera FROM overlap_edges""", "overlap_edges"))
def connected_cameras(v: Views) -> DataFrame:
    return zones.connected_cameras(dimensions.edge_dimension(v.overlap_config()))


@query("O43", check=sql("""SELECT a.name, a.camera_id, b.camera_id AS other FROM zone_dim a JOIN zone_dim b ON a.name = b.name AND a.camera_id <> b.camera_id""", "zone_dim"))
def other_cameras_of_zone(v: Views) -> DataFrame:
    return zones.cameras_of_zone(dimensions.zone_dimension(v.zone_config())).select("name", "camera_id", F.explode("others").alias("other"))


@query("O43", check=sql("SELECT camera_id, zone_ord, name, max_handover_sec FROM zone_dim", "zone_dim"))
def zones_of_camera(v: Views) -> DataFrame:
    return zones.zones_of_camera(dimensions.zone_dimension(v.zone_config())).select("camera_id", *whole("zone_ord"), "name", "max_handover_sec")


@query("O43", check=sql("""SELECT 'exit' AS kind, from_camera AS camera_id, to_camera AS other, edge_ord, exit_x1 AS x1, exit_x2 AS x2 FROM overlap_edges
    UNION ALL SELECT 'entry', to_camera, from_camera, edge_ord, entry_x1, entry_x2 FROM overlap_edges""", "overlap_edges"))
def exit_and_entry_zones(v: Views) -> DataFrame:
    e = dimensions.edge_dimension(v.overlap_config())
    both = zones.exit_zones(e).withColumn("kind", F.lit("exit")).unionByName(zones.entry_zones(e).withColumn("kind", F.lit("entry")))
    return both.select("kind", "camera_id", "other", "edge_ord", F.col("rect")[0].alias("x1"), F.col("rect")[2].alias("x2"))


@query("O43", check=sql("""SELECT c_custkey, from_camera, to_camera, coalesce(e.max_handover_sec, 3.0::DOUBLE) AS limit_sec FROM (
    SELECT c_custkey, concat('cam_', c_nationkey) AS from_camera, concat('cam_', c_custkey % 25) AS to_camera FROM customer) c
    LEFT JOIN (SELECT from_camera, to_camera, min_by(max_handover_sec, edge_ord) AS max_handover_sec FROM overlap_edges GROUP BY ALL) e USING (from_camera, to_camera)""", "overlap_edges"))
def handover_limits(v: Views) -> DataFrame:
    pairs = v.table("customer").select("c_custkey", F.concat(F.lit("cam_"), F.col("c_nationkey").cast("string")).alias("from_camera"),
                                       F.concat(F.lit("cam_"), (F.col("c_custkey") % 25).cast("string")).alias("to_camera"))
    return zones.handover_limit(pairs, dimensions.edge_dimension(v.overlap_config())).select("c_custkey", "from_camera", "to_camera", "limit_sec")


# ---- boxes ----------------------------------------------------------------------------------

@query("O11", check=sql("""SELECT camera_id, frame_number, det_id, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, x2-x1 AS w, y2-y1 AS h, (x2-x1)*(y2-y1) AS area,
    x1 AS left_x, y1 AS top_y FROM detections""", "detections"))
def box_scalars(v: Views) -> DataFrame:
    center, corner = boxes.to_xywh(box()), boxes.to_tlwh(box())
    return v.detections().select(*DET, center[0].alias("cx"), center[1].alias("cy"), center[2].alias("w"), corner[3].alias("h"),
                                 boxes.area(box()).alias("area"), corner[0].alias("left_x"), corner[1].alias("top_y"))


@query("O12", check=sql("""SELECT camera_id, frame_number, det_id, round(x1/1280, 9) AS nx1, round(y2/720, 9) AS ny2,
    CAST(trunc((x1/1280) * 640) AS BIGINT) AS px1, CAST(trunc((y2/720) * 333) AS BIGINT) AS py2 FROM detections""", "detections"))
def box_normalise(v: Views) -> DataFrame:
    n = boxes.normalise(box(), F.col("frame_w"), F.col("frame_h"))
    px = boxes.denormalise(n, F.lit(640), F.lit(333))
    return v.detections().select(*DET, r6(n.x1, 9).alias("nx1"), r6(n.y2, 9).alias("ny2"), px.x1.cast("long").alias("px1"), px.y2.cast("long").alias("py2"))


@query("O13", check=sql("""SELECT * FROM (SELECT camera_id, frame_number, det_id,
    greatest(0, CAST(trunc(x1-200.5::DOUBLE) AS BIGINT)) AS crop_x1, greatest(0, CAST(trunc(y1+150.5::DOUBLE) AS BIGINT)) AS crop_y1,
    least(1280, CAST(trunc(x2-200.5::DOUBLE) AS BIGINT)) AS crop_x2, least(720, CAST(trunc(y2+150.5::DOUBLE) AS BIGINT)) AS crop_y2 FROM detections)
    WHERE crop_x2 > crop_x1 AND crop_y2 > crop_y1""", "detections"))
def crop_windows(v: Views) -> DataFrame:
    moved = v.detections().withColumns({"x1": F.col("x1") - 200.5, "x2": F.col("x2") - 200.5, "y1": F.col("y1") + 150.5, "y2": F.col("y2") + 150.5})
    return gates.crop_windows(moved).select(*DET, *whole("crop_x1", "crop_y1", "crop_x2", "crop_y2"))


_OTHER = "x1 + 20*ln AS ox1, y1 + 15*ln AS oy1, x1 + 20*ln + 90 AS ox2, y1 + 15*ln + 200 AS oy2"
_PAIR = f"""SELECT *, greatest(0.0::DOUBLE, least(x2,ox2)-greatest(x1,ox1)) * greatest(0.0::DOUBLE, least(y2,oy2)-greatest(y1,oy1)) AS inter,
    (x2-x1)*(y2-y1) AS aa, (ox2-ox1)*(oy2-oy1) AS ab FROM (SELECT *, {_OTHER} FROM (SELECT *, det_id // 100 % 10 AS ln FROM detections))"""


def _pairs(v: Views) -> DataFrame:
    """Each detection next to a second box shifted by its line number."""
    n = (F.expr("det_id div 100") % 10)
    return v.detections().withColumns({
        "ox1": F.col("x1") + 20 * n, "oy1": F.col("y1") + 15 * n, "ox2": F.col("x1") + 20 * n + 90, "oy2": F.col("y1") + 15 * n + 200})


@query("O27", check=sql(f"SELECT camera_id, frame_number, det_id, round(CASE WHEN inter > 0 THEN inter/(aa+ab-inter) ELSE 0 END, 6) AS iou FROM ({_PAIR})", "detections"))
def box_iou(v: Views) -> DataFrame:
    return _pairs(v).select(*DET, r6(boxes.iou(box(), box("o"))).alias("iou"))


@query("O28", check=sql(f"""SELECT camera_id, frame_number, det_id, round(inter/aa, 6) AS first_covered, round(inter/ab, 6) AS second_covered,
    round(greatest(inter/aa, inter/ab), 6) AS smaller_covered FROM ({_PAIR})""", "detections"))
def box_containment(v: Views) -> DataFrame:
    a, b = box(), box("o")
    return _pairs(v).select(*DET, r6(boxes.covered(a, b)).alias("first_covered"), r6(boxes.covered(b, a)).alias("second_covered"),
                            r6(boxes.smaller_covered(a, b)).alias("smaller_covered"))


@query("O29", check=sql("""SELECT camera_id, frame_number, det_id, round(greatest(0.0::DOUBLE, least(x2/1280, 0.75::DOUBLE)-greatest(x1/1280, 0.5::DOUBLE))
    * greatest(0.0::DOUBLE, least(y2/720, 0.6::DOUBLE)-y1/720) / ((x2/1280-x1/1280)*(y2/720-y1/720)), 6) AS ratio FROM detections""", "detections"))
def zone_overlap_ratio(v: Views) -> DataFrame:
    n = boxes.normalise(box(), F.col("frame_w"), F.col("frame_h"))
    return v.detections().select(*DET, r6(boxes.covered(n, Box(*map(F.lit, EXCLUSION)))).alias("ratio"))


# ---- detection filters ----------------------------------------------------------------------

@query("O14", check=sql("SELECT camera_id, frame_number, det_id, round(confidence, 6) AS confidence FROM persons_seen", "persons_seen"))
def class_confidence_filter(v: Views) -> DataFrame:
    return gates.person_filter(v.detections()).select(*DET, r6("confidence").alias("confidence"))


@query("O15", check=sql("SELECT camera_id, frame_number, det_id, y2-y1 AS height FROM detections WHERE y2-y1 >= 300", "detections"))
def min_height_filter(v: Views) -> DataFrame:
    return gates.min_height_filter(v.detections(), 300).select(*DET, boxes.height(box()).alias("height"))


@query("O16", check=sql("SELECT camera_id, frame_number, det_id FROM kept", "kept"))
def exclusion_filter(v: Views) -> DataFrame:
    return gates.exclusion_filter(gates.person_filter(v.detections()), v.cameras()).select(*DET)


@query("O30", check=sql("SELECT camera_id, frame_number, id_a, id_b, round(iou, 6) AS iou FROM pairs", "pairs"))
def overlapping_pairs(v: Views) -> DataFrame:
    d = overlap.overlapping_pairs(gates.person_filter(v.detections()), "det_id")
    return d.select("camera_id", "frame_number", "id_a", "id_b", r6("iou").alias("iou"))


@query("O30", "O61", check=sql("""SELECT DISTINCT camera_id, frame_number, det_id FROM (SELECT camera_id, frame_number, id_a AS det_id FROM pairs
    UNION SELECT camera_id, frame_number, id_b FROM pairs)""", "pairs"))
def overlapping_ids(v: Views) -> DataFrame:
    return overlap.crowded(gates.person_filter(v.detections())).select(*DET)


@query("O14", "O16", "O30", "A06", check=sql("""SELECT k.camera_id, k.frame_number, count(*) AS persons, count(o.det_id) AS overlapping FROM kept k LEFT JOIN (
    SELECT DISTINCT camera_id, frame_number, det_id FROM (
        SELECT p.camera_id, p.frame_number, unnest([id_a, id_b]) AS det_id FROM pairs p
        JOIN kept a ON a.camera_id = p.camera_id AND a.frame_number = p.frame_number AND a.det_id = id_a
        JOIN kept b ON b.camera_id = p.camera_id AND b.frame_number = p.frame_number AND b.det_id = id_b)) o
    ON o.camera_id = k.camera_id AND o.frame_number = k.frame_number AND o.det_id = k.det_id GROUP BY ALL""", "kept", "pairs"))
def frame_overlap_summary(v: Views) -> DataFrame:
    """Flagship: per camera and frame, persons left after all detection filters and how many overlap."""
    kept = gates.exclusion_filter(gates.person_filter(v.detections()), v.cameras())
    return overlap.frame_overlap_summary(kept)


@query("O23", check=sql("""SELECT camera_id, frame_number, min(det_id) AS det_id FROM persons_seen GROUP BY ALL HAVING count(*) = 1""", "persons_seen"))
def single_person_frames(v: Views) -> DataFrame:
    return gates.single_person_frames(gates.person_filter(v.detections())).select(*DET)


@query("O23", check=sql("""SELECT camera_id, frame_number, det_id FROM persons_seen s WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.camera_id = s.camera_id
    AND p.frame_number = s.frame_number AND s.det_id IN (p.id_a, p.id_b))""", "persons_seen", "pairs"))
def not_overlapping(v: Views) -> DataFrame:
    seen = gates.person_filter(v.detections())
    return gates.single_person_rows(seen, DET, overlap.crowded(seen)).select(*DET)


# ---- zones ----------------------------------------------------------------------------------

_ZONED = """SELECT camera_id, frame_number, det_id, min_by(name, zone_ord) AS zone FROM (
    SELECT d.camera_id, d.frame_number, d.det_id, z.name, z.zone_ord FROM (SELECT *, ((x1+x2)/2.0::DOUBLE)/1280 AS px_, y2/720 AS py_ FROM persons_seen) d, zone_edges z
    GROUP BY ALL HAVING count(*) FILTER (WHERE (z.py > d.py_) <> (z.qy > d.py_) AND d.px_ < (z.qx-z.px)*(d.py_-z.py)/nullif(z.qy-z.py,0)+z.px) % 2 = 1) GROUP BY ALL"""
_ZONED = _ZONED.replace("GROUP BY ALL HAVING", "GROUP BY d.camera_id, d.frame_number, d.det_id, z.name, z.zone_ord HAVING")


@query("O31", check=sql(f"SELECT p.camera_id, p.frame_number, p.det_id, zone FROM persons_seen p LEFT JOIN ({_ZONED}) USING (camera_id, frame_number, det_id)", "persons_seen", "zone_edges"))
def polygon_zone(v: Views) -> DataFrame:
    return zones.assign_zone(gates.person_filter(v.detections()), v.zones()).select(*DET, "zone")


@query("O39", check=sql(f"""SELECT camera_id, frame_number, zone, count(*) AS persons, CASE WHEN count(*) = 1 THEN min(det_id) END AS alone_id
    FROM ({_ZONED}) GROUP BY camera_id, frame_number, zone""", "persons_seen", "zone_edges"))
def persons_in_zone(v: Views) -> DataFrame:
    return zones.persons_in_zone(zones.assign_zone(gates.person_filter(v.detections()), v.zones()), "det_id")


def _edge_check(camera: str, zone: str, other: str) -> str:
    return sql(f"""SELECT camera_id, frame_number, det_id, min_by(other, rank) AS {other}, round(max(ratio), 6) AS overlap FROM (
        SELECT *, row_number() OVER (PARTITION BY camera_id, frame_number, det_id ORDER BY ratio DESC, edge_ord) AS rank FROM (
        SELECT d.camera_id, d.frame_number, d.det_id, e.edge_ord, e.{other} AS other,
        greatest(0.0::DOUBLE, least(x2/1280, e.{zone}[3])-greatest(x1/1280, e.{zone}[1])) * greatest(0.0::DOUBLE, least(y2/720, e.{zone}[4])-greatest(y1/720, e.{zone}[2]))
        / ((x2/1280-x1/1280)*(y2/720-y1/720)) AS ratio FROM persons_seen d JOIN edges e ON e.{camera} = d.camera_id) WHERE ratio > 0.3::DOUBLE)
        GROUP BY camera_id, frame_number, det_id""", "persons_seen", "edges")


@query("O32", check=_edge_check("from_camera", "exit_zone", "to_camera"))
def edge_exit_check(v: Views) -> DataFrame:
    return zones.check_exit(gates.person_filter(v.detections()), v.edges()).select(*DET, "to_camera", r6("overlap").alias("overlap"))


@query("O32", check=_edge_check("to_camera", "entry_zone", "from_camera"))
def edge_entry_check(v: Views) -> DataFrame:
    return zones.check_entry(gates.person_filter(v.detections()), v.edges()).select(*DET, "from_camera", r6("overlap").alias("overlap"))


# ---- faces ----------------------------------------------------------------------------------

FACE = ["camera_id", "frame_number", "track_id", "face_id"]
CROP_KEY = ["camera_id", "frame_number", "track_id"]


@query("O17", check=sql("SELECT camera_id, frame_number, track_id, face_id FROM faces WHERE least(x2-x1, y2-y1) >= 80", "faces"))
def face_size_filter(v: Views) -> DataFrame:
    return gates.face_size_filter(v.faces(), DEFAULTS.min_face_size).select(*FACE)


@query("O18", check=sql("""SELECT camera_id, frame_number, track_id, face_id, CAST(trunc(person_y1) + trunc((trunc(person_y2)-trunc(person_y1))*0.5::DOUBLE) AS BIGINT) AS region_y2
    FROM faces WHERE (x1+x2)/2 BETWEEN trunc(person_x1) AND trunc(person_x2)
    AND (y1+y2)/2 BETWEEN trunc(person_y1) AND trunc(person_y1) + trunc((trunc(person_y2)-trunc(person_y1))*0.5::DOUBLE)""", "faces"))
def upper_half_faces(v: Views) -> DataFrame:
    return gates.upper_half_faces(v.faces()).select(*FACE, *whole("region_y2"))


@query("A04", "O17", check=sql("""SELECT camera_id, frame_number, track_id, count(*) FILTER (WHERE least(x2-x1, y2-y1) >= 80) AS large_faces,
    count(*) FILTER (WHERE least(x2-x1, y2-y1) >= 20) AS small_faces, count(*) FILTER (WHERE least(x2-x1, y2-y1) >= 20) > 1 AS blocks_appearance,
    count(*) FILTER (WHERE least(x2-x1, y2-y1) >= 80) > 1 AS blocks_recognition FROM faces GROUP BY ALL""", "faces"))
def multi_face_crops(v: Views) -> DataFrame:
    return gates.multi_face_crops(v.faces(), CROP_KEY)


# ---- crops ----------------------------------------------------------------------------------

CROP = ["camera_id", "frame_number", "track_id", "crop_id"]


@query("O19", check=sql("SELECT camera_id, frame_number, track_id, crop_id, size_ok FROM graded", "graded"))
def crop_validity_gate(v: Views) -> DataFrame:
    return gates.crop_quality(v.crops()).select(*CROP, "size_ok")


@query("O20", check=sql("SELECT camera_id, frame_number, track_id, crop_id, colour_ok FROM graded", "graded"))
def grayscale_gate(v: Views) -> DataFrame:
    return gates.crop_quality(v.crops()).select(*CROP, "colour_ok")


@query("O21", check=sql("SELECT camera_id, frame_number, track_id, crop_id, round(raw_quality, 6) AS raw_quality, round(quality, 6) AS quality FROM graded", "graded"))
def crop_quality(v: Views) -> DataFrame:
    return gates.crop_quality(v.crops()).select(*CROP, r6("raw_quality").alias("raw_quality"), r6("quality").alias("quality"))


@query("O22", check=sql("""SELECT camera_id, frame_number, track_id, crop_id, quality >= 0.5::DOUBLE AS for_handover FROM graded WHERE quality >= 0.3::DOUBLE""", "graded"))
def quality_gates(v: Views) -> DataFrame:
    good = gates.gallery_grade(gates.crop_quality(v.crops()))
    return good.select(*CROP, (F.col("quality") >= DEFAULTS.min_visibility).alias("for_handover"))


# ---- frames ---------------------------------------------------------------------------------

_MOTION = """SELECT *, raw OR coalesce(t - last_t < 5000, false) AS has_motion FROM (SELECT *, max(CASE WHEN raw THEN t END)
    OVER (PARTITION BY camera_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS last_t FROM (SELECT *, motion_ratio > 0.01::DOUBLE AS raw FROM frames))"""
MOTION_CHECK = sql(f"SELECT camera_id, frame_number, t AS t_ms, has_motion FROM ({_MOTION})", "frames")
_SCHEDULE = f"""SELECT *, process AND (frame_number <= 2 OR frame_number % 3 = 0 OR active) AS detect FROM (
    SELECT *, has_motion OR active OR frame_number <= 2 AS process FROM ({_MOTION}))"""


@query("O04", check=sql("SELECT camera_id, frame_number, t AS t_ms, round(motion_ratio, 6) AS motion_ratio FROM frames", "frames"))
def frame_source(v: Views) -> DataFrame:
    return v.frames().select("camera_id", "frame_number", t_ms("ts").alias("t_ms"), r6("motion_ratio").alias("motion_ratio"))


@query("O45", check=MOTION_CHECK)
def motion_gate(v: Views) -> DataFrame:
    return gates.motion_gate(v.frames()).select("camera_id", "frame_number", t_ms("ts").alias("t_ms"), "has_motion")


_SKIP3 = replace(DEFAULTS, frame_skip=3)


@query("O24", check=sql(f"SELECT camera_id, frame_number, process, detect FROM ({_SCHEDULE})", "frames"))
def detection_schedule(v: Views) -> DataFrame:
    return gates.detection_schedule(gates.motion_gate(v.frames()), _SKIP3).select("camera_id", "frame_number", "process", "detect")


@query("O44", check=sql(f"""SELECT s.camera_id, s.frame_number, s.source_frame, d.det_id FROM (
    SELECT camera_id, frame_number, max(CASE WHEN detect THEN frame_number END) OVER (PARTITION BY camera_id ORDER BY frame_number ROWS UNBOUNDED PRECEDING) AS source_frame
    FROM ({_SCHEDULE}) WHERE process) s LEFT JOIN persons_seen d ON d.camera_id = s.camera_id AND d.frame_number = s.source_frame""", "frames", "persons_seen"))
def carried_detections(v: Views) -> DataFrame:
    schedule = gates.detection_schedule(gates.motion_gate(v.frames().drop("frame_w", "frame_h")), _SKIP3)
    return gates.carry_detections(schedule, gates.person_filter(v.detections())).select("camera_id", "frame_number", "source_frame", "det_id")


@query("O26", check=sql("SELECT event_id, t AS t_ms FROM event_log WHERE ts >= TIMESTAMP '2024-02-10' - INTERVAL 15 DAY", "event_log"))
def recent_window(v: Views) -> DataFrame:
    return gates.recent(v.event_log(), NOW, "15d").select("event_id", t_ms("ts").alias("t_ms"))


_STATIC = f"""SELECT event_id, concat('cam_', event_id % 4) AS camera_id, user_id % 8 AS track_id, {B} + event_id*200 AS t,
    ((user_id % 8)*37 % 100)/100.0::DOUBLE + value/2000.0::DOUBLE AS cx, ((user_id % 8)*53 % 100)/100.0::DOUBLE + value/4000.0::DOUBLE AS cy FROM events"""


@query("O54", check=sql(f"""SELECT event_id, camera_id, track_id, max(cx) OVER w - min(cx) OVER w < 0.02::DOUBLE AND max(cy) OVER w - min(cy) OVER w < 0.02::DOUBLE
    AND t - min(t) OVER (PARTITION BY camera_id, track_id) >= 10000 AS is_static FROM ({_STATIC})
    WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY t RANGE BETWEEN 10000 PRECEDING AND CURRENT ROW)"""))
def static_objects(v: Views) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id") % 8
    rows = v.table("events").select(
        "event_id", F.concat(F.lit("cam_"), (e % 4).cast("string")).alias("camera_id"), u.alias("track_id"), F.timestamp_millis(F.lit(B) + e * 200).alias("ts"),
        (u * 37 % 100 / 100.0 + F.col("value") / 2000.0).alias("cx"), (u * 53 % 100 / 100.0 + F.col("value") / 4000.0).alias("cy"))
    return gates.static_filter(rows).select("event_id", "camera_id", "track_id", "is_static")


@query("O25", check=sql("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN concat('person_', user_id % 10, ' (', CASE WHEN user_id % 2 = 0 THEN 'R' ELSE 'F' END, ':', printf('%.2f', value/600.0::DOUBLE), ')')
    ELSE concat('#', user_id, CASE WHEN event_type = 'view' THEN concat(' ~person_', event_id % 5, '(', printf('%.2f', value/900.0::DOUBLE), ')') ELSE '' END,
    CASE WHEN value >= 20 THEN concat(' R:', printf('%.2f', value/700.0::DOUBLE)) ELSE '' END) END
    || CASE WHEN event_id % 4 <> 0 THEN concat(' [zone_', event_id % 4, ']') ELSE '' END || CASE WHEN event_id % 3 > 1 THEN ' *' ELSE '' END
    || CASE WHEN event_type = 'error' THEN concat(' S:', event_id % 60, 's') ELSE '' END AS label FROM events"""))
def track_labels(v: Views) -> DataFrame:
    e, u, val = F.col("event_id"), F.col("user_id"), F.col("value")

    def text(prefix, number):
        return F.concat(F.lit(prefix), number.cast("string"))

    return v.table("events").select("event_id", labels.track_label(
        track_id=text("global_", u), person_name=F.when(u % 3 == 0, text("person_", u % 10)), by_reid=u % 2 == 0, confidence=val / 600.0,
        closest_name=F.when(F.col("event_type") == "view", text("person_", e % 5)), closest_score=val / 900.0,
        reid_score=F.when(val >= 20, val / 700.0).otherwise(-1.0), zone=F.when(e % 4 != 0, text("zone_", e % 4)), cameras_seen=e % 3,
        stationary_sec=F.when(F.col("event_type") == "error", e % 60)).alias("label"))
