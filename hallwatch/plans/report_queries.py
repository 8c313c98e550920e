"""Queries of the stores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hallwatch.functions.vectors import from_blob
from hallwatch.operators import reports, tracker
from hallwatch.params import DEFAULTS
from hallwatch.plans.oracle_views import B, sql
from hallwatch.plans.registry import query, r6, whole
from hallwatch.plans.views import NOW, TRACK_NOW, Views, at_ms, t_ms
from hallwatch.sources import stores
from hallwatch.sources.scoring import score_crops

_NOW = "TIMESTAMP '2024-02-10'"
_TRACK_NOW_MS = B + 96_400_000


# ---- events ---------------------------------------------------------------------------------

@query("O56", check=sql(f"""SELECT event_id, t AS t_ms, camera_id, event_type, person_id, round(confidence, 6) AS confidence FROM event_log
    WHERE camera_id = 'cam_0' AND event_type = 'view' AND person_id = 0 AND ts >= {_NOW} - INTERVAL 35 DAY ORDER BY ts DESC, event_id DESC LIMIT 100""", "event_log"))
def event_query(v: Views) -> DataFrame:
    import datetime as dt
    found = reports.query_events(v.event_log(), camera_id="cam_0", person_id=0, event_type="view", since=NOW - dt.timedelta(days=35))
    return found.select("event_id", t_ms("ts").alias("t_ms"), "camera_id", "event_type", "person_id", r6("confidence").alias("confidence"))


@query("O56", check=sql("SELECT event_id, t AS t_ms, camera_id, event_type FROM event_log ORDER BY ts DESC, event_id DESC LIMIT 50", "event_log"))
def latest_events(v: Views) -> DataFrame:
    return reports.query_events(v.event_log(), limit=DEFAULTS.event_report_limit).select("event_id", t_ms("ts").alias("t_ms"), "camera_id", "event_type")


@query("O57", check=sql("""SELECT p.person_id, p.name, p.is_active, (SELECT count(*) FROM vecs WHERE person_id = 3) AS faces, e.event_id, e.t AS t_ms, e.event_type, e.camera_id
    FROM persons p LEFT JOIN (SELECT * FROM event_log WHERE person_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 10) e ON true WHERE p.person_id = 3""", "persons", "vecs", "event_log"))
def person_profile(v: Views) -> DataFrame:
    return reports.person_profile(v.persons(), v.face_embeddings(), v.event_log(), 3).select(
        "person_id", "name", "is_active", "faces", "event_id", t_ms("ts").alias("t_ms"), "event_type", "camera_id")


@query("O62", check=sql(f"SELECT event_id, t AS t_ms FROM event_log WHERE ts >= {_NOW} - INTERVAL 30 DAY", "event_log"))
def event_retention(v: Views) -> DataFrame:
    return reports.apply_retention(v.event_log(), NOW).select("event_id", t_ms("ts").alias("t_ms"))


@query("A09", check=sql("SELECT event_type, count(*) AS events FROM event_log GROUP BY 1", "event_log"))
def event_totals(v: Views) -> DataFrame:
    return reports.event_totals(v.event_log())


@query("A09", check=sql("""SELECT (SELECT count(*) FROM stored_tracks) AS tracks, (SELECT count(person_id) FROM stored_tracks) AS identified, (SELECT count(*) FROM stored_tracks WHERE status = 'lost') AS pending,
    (SELECT count(*) FROM events WHERE event_type = 'click') AS handovers, (SELECT count(*) - count(person_id) FROM stored_tracks) AS unknown""", "stored_tracks"))
def session_status(v: Views) -> DataFrame:
    """Clicks stand for handover events."""
    t = v.stored_tracks()
    log = v.event_log().select(F.when(F.col("event_type") == "click", "track_handover").otherwise(F.col("event_type")).alias("event_type"))
    return reports.session_status(t, t.filter("status = 'lost'"), log)


@query("O08", check=sql("""SELECT event_id, epoch_us(ts) // 1000 AS t_ms, concat('cam_', user_id % 4) AS camera_id, 'track_created' AS event_type, CAST(user_id AS VARCHAR) AS track_id,
    user_id % 10 AS person_id, round(value/600.0::DOUBLE, 6) AS confidence, concat('{"person_id":', user_id % 10, ',"track_id":"', user_id, '"}') AS extra_data FROM events"""))
def event_rows(v: Views) -> DataFrame:
    rows = stores.as_events(v.event_log().drop("event_type", "extra_data"), "track_created", extra=["person_id", "track_id"])
    return rows.select("event_id", t_ms("ts").alias("t_ms"), "camera_id", "event_type", "track_id", "person_id", r6("confidence").alias("confidence"), "extra_data")


# ---- tracks ---------------------------------------------------------------------------------

@query("A01", check=sql("""SELECT count(*) > 0 AS home, string_agg(DISTINCT name, ',' ORDER BY name) AS persons, count(*) FILTER (WHERE t.person_id IS NULL) AS unknown_count, count(*) AS total_tracks
    FROM stored_tracks t LEFT JOIN persons p ON p.person_id = t.person_id WHERE status = 'active'""", "stored_tracks", "persons"))
def occupancy(v: Views) -> DataFrame:
    active = v.stored_tracks().filter("status = 'active'")
    return reports.occupancy(active, v.persons()).select("home", F.array_join("persons", ",").alias("persons"), *whole("unknown_count", "total_tracks"))


@query("A02", check=sql("""WITH act AS (SELECT t.person_id, name FROM stored_tracks t LEFT JOIN persons p ON p.person_id = t.person_id WHERE status = 'active')
    SELECT 'active' AS line, NULL::VARCHAR AS person_name, count(*) AS tracks FROM act UNION ALL SELECT 'unknown', NULL, count(*) FROM act WHERE person_id IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'identified', name, count(*) FROM act WHERE name IS NOT NULL GROUP BY name""", "stored_tracks", "persons"))
def occupancy_report(v: Views) -> DataFrame:
    active = v.stored_tracks().filter("status = 'active'")
    return reports.occupancy_report(active, v.persons())


@query("O58", check=sql(f"""SELECT track_id, t.person_id, name AS person_name, last_camera_id, status, t_last AS last_seen_ms FROM stored_tracks t LEFT JOIN persons p ON p.person_id = t.person_id
    WHERE t_last >= {_TRACK_NOW_MS} - 24*3600000""", "stored_tracks", "persons"))
def recent_tracks(v: Views) -> DataFrame:
    d = reports.list_tracks(v.stored_tracks(), v.persons(), now=TRACK_NOW, hours=24)
    return d.select("track_id", "person_id", "person_name", "last_camera_id", "status", t_ms("last_seen").alias("last_seen_ms"))


@query("O58", "O42", check=sql("""SELECT track_id, t.person_id, name AS person_name, last_camera_id FROM stored_tracks t LEFT JOIN persons p ON p.person_id = t.person_id
    WHERE status = 'active'""", "stored_tracks", "persons"))
def active_track_list(v: Views) -> DataFrame:
    return reports.list_tracks(v.stored_tracks(), v.persons()).select("track_id", "person_id", "person_name", "last_camera_id")


@query("O42", check=sql("SELECT event_id, e.person_id, name AS person_name FROM event_log e LEFT JOIN persons p ON p.person_id = e.person_id", "event_log", "persons"))
def event_person_names(v: Views) -> DataFrame:
    return reports.with_person_name(v.event_log(), v.persons()).select("event_id", "person_id", "person_name")


@query("O42", check=sql("SELECT person_id, name, is_active FROM persons WHERE lower(name) = 'person_4'", "persons"))
def person_lookup(v: Views) -> DataFrame:
    return reports.person_by_name(v.persons(), "PERSON_4", ignore_case=True).select("person_id", "name", "is_active")


@query("O63", check=sql(f"""SELECT track_id, CASE WHEN status = 'active' AND t_last < {_TRACK_NOW_MS} - 24*3600000 THEN 'archived' ELSE status END AS status,
    status = 'active' AND t_last < {_TRACK_NOW_MS} - 24*3600000 AS archived_now FROM stored_tracks""", "stored_tracks"))
def track_archive(v: Views) -> DataFrame:
    return reports.archive_tracks(v.stored_tracks(), TRACK_NOW).select("track_id", "status", "archived_now")


@query("O63", check=sql(f"SELECT count(*) AS archived FROM stored_tracks WHERE status = 'active' AND t_last < {_TRACK_NOW_MS} - 24*3600000", "stored_tracks"))
def track_archive_count(v: Views) -> DataFrame:
    return reports.archived_count(reports.archive_tracks(v.stored_tracks(), TRACK_NOW))


@query("O64", check=sql(f"""SELECT track_id, state FROM stored_tracks WHERE state <> 'removed' AND NOT (state = 'lost' AND t_last < {_TRACK_NOW_MS} - 24*3600000)""", "stored_tracks"))
def track_state_expiry(v: Views) -> DataFrame:
    return reports.live_track_state(v.stored_tracks(), TRACK_NOW).select("track_id", "state")


@query("O64", check=sql(f"SELECT track_id, t_first AS first_seen_ms FROM stored_tracks WHERE t_first >= {B} + 13600*1000 - 3600*1000", "stored_tracks"))
def identity_state_expiry(v: Views) -> DataFrame:
    import datetime as dt
    now = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=13600)
    return reports.live_identity_state(v.stored_tracks(), now).select("track_id", t_ms("first_seen").alias("first_seen_ms"))


@query("A11", check=sql("SELECT last_camera_id AS camera_id, bool_or(state IN ('tracked', 'new')) AS active FROM stored_tracks GROUP BY 1", "stored_tracks"))
def camera_activity(v: Views) -> DataFrame:
    return tracker.camera_activity(v.stored_tracks().withColumnRenamed("last_camera_id", "camera_id"))


@query("A11", check=sql("SELECT track_id, last_camera_id AS camera_id FROM stored_tracks WHERE state IN ('tracked', 'new') AND last_camera_id = 'cam_2'", "stored_tracks"))
def active_tracks_of_camera(v: Views) -> DataFrame:
    return tracker.active_tracks(v.stored_tracks().withColumnRenamed("last_camera_id", "camera_id"), "cam_2").select("track_id", "camera_id")


_SIGHT = f"""SELECT o_custkey AS track_id, concat('cam_', o_orderkey % 4) AS camera_id, {B} + o_orderkey*2000 AS t, 'entry' AS kind, concat('zone_', o_orderkey % 3) AS zone, 2*o_orderkey AS seq FROM orders
    UNION ALL SELECT o_custkey, concat('cam_', o_orderkey % 4), {B} + o_orderkey*2000 + (o_custkey % 20)*1000, 'exit', concat('zone_', o_orderkey % 3), 2*o_orderkey + 1 FROM orders WHERE o_orderstatus <> 'P'"""


@query("A10", check=sql(f"""SELECT track_id, camera_id, t AS entered_ms, CASE WHEN nk = 'exit' THEN nt END AS exited_ms, zone AS entry_zone, CASE WHEN nk = 'exit' THEN nz END AS exit_zone FROM (
    SELECT *, lead(kind) OVER w AS nk, lead(t) OVER w AS nt, lead(zone) OVER w AS nz FROM ({_SIGHT}) WINDOW w AS (PARTITION BY track_id, camera_id ORDER BY t, seq)) WHERE kind = 'entry'"""))
def sightings(v: Views) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    zone, cam = F.concat(F.lit("zone_"), (o % 3).cast("string")).alias("zone"), F.concat(F.lit("cam_"), (o % 4).cast("string")).alias("camera_id")
    t = v.table("orders")
    into = t.select(c.alias("track_id"), cam, at_ms(o * 2000).alias("ts"), F.lit("entry").alias("kind"), zone, (o * 2).alias("seq"))
    out = t.filter("o_orderstatus <> 'P'").select(c.alias("track_id"), cam, at_ms(o * 2000 + (c % 20) * 1000).alias("ts"), F.lit("exit").alias("kind"), zone, (o * 2 + 1).alias("seq"))
    s = reports.sightings(into.unionByName(out))
    return s.select("track_id", "camera_id", t_ms("entered_at").alias("entered_ms"), t_ms("exited_at").alias("exited_ms"), "entry_zone", "exit_zone")


@query("O10", check=sql(f"""SELECT concat('global_', user_id) AS track_id, arg_max(CASE WHEN event_type <> 'error' THEN user_id % 10 END, event_id) FILTER (WHERE event_type <> 'error') AS person_id,
    arg_max(concat('cam_', event_id % 4), event_id) FILTER (WHERE event_type = 'view') AS last_camera_id, arg_max(event_type, event_id) FILTER (WHERE event_type IN ('signup', 'click')) AS status,
    {B} + min(event_id)*200 AS first_ms, {B} + max(event_id)*200 AS last_ms FROM events GROUP BY user_id"""))
def track_changes(v: Views) -> DataFrame:
    return _folded(v).select("track_id", "person_id", "last_camera_id", "status", t_ms("first_seen").alias("first_ms"), t_ms("last_seen").alias("last_ms"))


def _changes(v: Views) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    return v.table("events").select(
        F.concat(F.lit("global_"), F.col("user_id").cast("string")).alias("track_id"), at_ms(e * 200).alias("ts"), e.alias("seq"),
        F.when(kind != "error", F.col("user_id") % 10).alias("person_id"), F.when(kind == "view", F.concat(F.lit("cam_"), (e % 4).cast("string"))).alias("last_camera_id"),
        F.when(kind.isin("signup", "click"), kind).alias("status"))


def _folded(v: Views) -> DataFrame:
    return stores.fold_track_changes(_changes(v))


@query("O10", check=sql(f"""SELECT coalesce(t.track_id, u.track_id) AS track_id, coalesce(u.status, t.status, 'active') AS status, coalesce(u.person_id, t.person_id) AS person_id,
    coalesce(t.t_first, u.first_ms) AS first_ms, greatest(t.t_last, u.last_ms) AS last_ms FROM stored_tracks t FULL JOIN (
    SELECT concat('global_', user_id) AS track_id, arg_max(user_id % 10, event_id) FILTER (WHERE event_type <> 'error') AS person_id,
    arg_max(event_type, event_id) FILTER (WHERE event_type IN ('signup', 'click')) AS status, {B} + min(event_id)*200 AS first_ms, {B} + max(event_id)*200 AS last_ms
    FROM events GROUP BY user_id) u ON t.track_id = u.track_id""", "stored_tracks"))
def track_upsert(v: Views) -> DataFrame:
    d = stores.upsert_tracks(v.stored_tracks().drop("state"), _changes(v))
    return d.select("track_id", "status", "person_id", t_ms("first_seen").alias("first_ms"), t_ms("last_seen").alias("last_ms"))


# ---- persons --------------------------------------------------------------------------------

@query("A03", check=sql("SELECT p.person_id, name, count(vec_id) AS faces FROM persons p LEFT JOIN vecs v ON v.person_id = p.person_id WHERE is_active GROUP BY 1, 2", "persons", "vecs"))
def faces_per_person(v: Views) -> DataFrame:
    return reports.faces_per_person(v.persons(), v.face_embeddings()).select("person_id", "name", "faces")


_GONE = "SELECT DISTINCT user_id % 10 AS person_id FROM events WHERE event_type = 'error' AND value > 300"


def _after_deletion(v: Views) -> DataFrame:
    gone = v.table("events").filter("event_type = 'error' and value > 300").select((F.col("user_id") % 10).alias("person_id"))
    return reports.apply_deletions(v.persons(), gone)


@query("O60", check=sql(f"SELECT person_id, name, is_active AND person_id NOT IN ({_GONE}) AS is_active FROM persons", "persons"))
def soft_delete(v: Views) -> DataFrame:
    return _after_deletion(v).select("person_id", "name", "is_active")


@query("O60", check=sql(f"SELECT vec_id AS emb_id, person_id FROM vecs WHERE person_id <> 9 AND person_id NOT IN ({_GONE})", "vecs"))
def purge_embeddings(v: Views) -> DataFrame:
    return reports.purge_embeddings(v.face_embeddings(), _after_deletion(v)).select("emb_id", "person_id")


@query("A06", check=sql("""SELECT camera_id, frame_number, count(*) AS track_count, count(*) FILTER (WHERE track_id < 7) AS identified_count FROM observations GROUP BY 1, 2""", "observations"))
def frame_summary(v: Views) -> DataFrame:
    named = v.observations().withColumn("person_name", F.when(F.col("track_id") < 7, F.concat(F.lit("p_"), F.col("track_id").cast("string"))))
    return reports.frame_summary(named)


@query("O61", check=sql("SELECT DISTINCT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 60"))
def set_difference(v: Views) -> DataFrame:
    e = v.table("events")
    return reports.set_difference(e.filter("event_type = 'view'"), e.filter("event_type = 'error' and value > 60"), ["user_id"])


# ---- ingest ---------------------------------------------------------------------------------

@query("O07", check=sql("SELECT vec_id, 64::BIGINT AS dims, round(v[1], 6) AS first_value, round(v[64], 6) AS last_value, '1.0,-2.5' AS known FROM vecs", "vecs"))
def blob_ingest(v: Views) -> DataFrame:
    d = stores.decode_blobs(stores.encode_blobs(v.vectors()))
    first, last = F.col("embedding")[0].cast("double"), F.element_at("embedding", -1).cast("double")
    known = from_blob(F.unhex(F.lit("0000803F000020C0")))  # 1 and -2.5 in float32, lowest byte first
    return d.select("vec_id", F.size("embedding").cast("long").alias("dims"), r6(first).alias("first_value"), r6(last).alias("last_value"), F.array_join(known, ",").alias("known"))


@query("O09", check=sql("SELECT person_id, concat('img_', vec_id) AS source_image, true AS has_id FROM vecs WHERE person_id <> 4", "vecs"))
def enrolment_rows(v: Views) -> DataFrame:
    """The images of person 4 show faces without a vector and are not enrolled."""
    i = F.col("emb_id")
    faces = v.face_embeddings().select("person_id", F.when(F.col("person_id") != 4, F.col("embedding")).alias("embedding"),
                                       F.concat(F.lit("img_"), i.cast("string")).alias("source_image"), at_ms(i).alias("created_at"))
    return stores.enrolment_rows(faces).select("person_id", "source_image", (F.col("emb_id") > 0).alias("has_id"))


@query("O06", check=sql("""SELECT camera_id, frame_number, track_id, crop_id, round(quality, 6) AS quality, CASE WHEN quality > 0 THEN round(CAST(CAST(laplacian_var AS FLOAT) * CAST(1/800.0::DOUBLE AS FLOAT) AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS first_value
    FROM graded""", "graded"))
def batch_scoring(v: Views) -> DataFrame:
    """Scored with a stand-in model that returns scaled inputs; users pass their own."""
    crops = v.crops().withColumn("pixels", F.array(F.col("laplacian_var").cast("float"), F.col("mean_saturation").cast("float")))
    out = score_crops(crops, _stand_in_model, "pixels", vector_size=2, input_shape=[2])
    value = r6(F.col("embedding")[0].cast("double"))
    return out.select("camera_id", "frame_number", "track_id", "crop_id", r6("quality").alias("quality"), value.alias("first_value"))


def _stand_in_model():
    import numpy as np

    scale = np.array([1 / 800.0, 1 / 60.0], dtype=np.float32)
    return lambda pixels: pixels * scale
