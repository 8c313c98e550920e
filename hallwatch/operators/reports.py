"""Reports and housekeeping over persons, tracks, sightings and events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from hallwatch.functions.clock import before, micros
from hallwatch.operators import timeline
from hallwatch.params import DEFAULTS, Params


def _days(n: float) -> dt.timedelta:
    return dt.timedelta(days=n)


# ---- events ---------------------------------------------------------------------------------

def query_events(events: DataFrame, camera_id: str | None = None, person_id: int | None = None,
                 event_type: str | None = None, since: dt.datetime | None = None,
                 limit: int | None = DEFAULTS.event_limit) -> DataFrame:
    """Newest events first under optional filters; ``None`` means no filter, 0 is a value.

    Filters reach the scan; order and limit run as a per-task top-n followed by a merge.
    """
    tests = {"camera_id": camera_id, "person_id": person_id, "event_type": event_type}
    for column, wanted in tests.items():
        if wanted is not None:
            events = events.filter(F.col(column) == wanted)
    if since is not None:
        events = events.filter(F.col("ts") >= F.lit(since))
    events = events.orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return events if limit is None else events.limit(limit)


def person_profile(persons: DataFrame, embeddings: DataFrame, events: DataFrame, person_id: int,
                   p: Params = DEFAULTS) -> DataFrame:
    """One person with number of enrolled faces and the latest events (one row per event)."""
    faces = embeddings.filter(F.col("person_id") == person_id).select(F.count("emb_id"))
    latest = query_events(events, person_id=person_id, limit=p.profile_events)
    listed = latest.select(F.collect_list(F.struct("event_id", "ts", "event_type", "camera_id")))  # at most ten
    return (persons.filter(F.col("person_id") == person_id)
            .select("*", faces.scalar().alias("faces"), F.explode_outer(listed.scalar()).alias("_e")).select("*", "_e.*").drop("_e"))


def apply_retention(events: DataFrame, now: dt.datetime, p: Params = DEFAULTS) -> DataFrame:
    """Events to keep; everything older than the retention period goes."""
    return events.filter(F.col("ts") >= before(now, _days(p.event_retention_days)))


def event_totals(events: DataFrame) -> DataFrame:
    """Events per type."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def session_status(tracks: DataFrame, pending: DataFrame, events: DataFrame) -> DataFrame:
    """Tracks, identified and unknown ones, handovers still pending and handovers done."""
    handovers = events.filter("event_type = 'track_handover'").select(F.count(F.lit(1)))
    return (tracks.agg(F.count(F.lit(1)).alias("tracks"), F.count("person_id").alias("identified"))
            .select("tracks", "identified", (F.col("tracks") - F.col("identified")).alias("unknown"),
                    pending.select(F.count(F.lit(1))).scalar().alias("pending"), handovers.scalar().alias("handovers")))


# ---- tracks ---------------------------------------------------------------------------------

def with_person_name(rows: DataFrame, persons: DataFrame) -> DataFrame:
    """Person name where the id is known; the persons side is broadcast while it is small."""
    return rows.join(persons.select("person_id", F.col("name").alias("person_name")), "person_id", "left")


def person_by_name(persons: DataFrame, name: str, ignore_case: bool = False) -> DataFrame:
    if ignore_case:
        return persons.filter(F.lower("name") == name.lower())
    return persons.filter(F.col("name") == name)


def track_by_id(tracks: DataFrame, track_id) -> DataFrame:
    return tracks.filter(F.col("track_id") == track_id)


def list_tracks(tracks: DataFrame, persons: DataFrame, now: dt.datetime | None = None, hours: float | None = None) -> DataFrame:
    """Active tracks, or with ``hours`` all tracks seen in the last hours, with person name."""
    if hours is None:
        chosen = tracks.filter("status = 'active'")
    else:
        chosen = tracks.filter(F.col("last_seen") >= before(now, dt.timedelta(hours=hours)))
    return with_person_name(chosen, persons)


def archive_tracks(tracks: DataFrame, now: dt.datetime, p: Params = DEFAULTS) -> DataFrame:
    """Active tracks not seen for ``archive_hours`` become archived; ``archived_now`` marks them."""
    old = (F.col("status") == "active") & (F.col("last_seen") < before(now, dt.timedelta(hours=p.archive_hours)))
    return tracks.withColumn("archived_now", old).withColumn("status", F.when(old, "archived").otherwise(F.col("status")))


def archived_count(archived: DataFrame) -> DataFrame:
    return archived.agg(F.count_if("archived_now").alias("archived"))


def live_track_state(tracks: DataFrame, now: dt.datetime, p: Params = DEFAULTS) -> DataFrame:
    """Global tracks still worth keeping: not removed, and not lost for more than a day."""
    stale = (F.col("state") == "lost") & (F.col("last_seen") < before(now, dt.timedelta(hours=p.archive_hours)))
    return tracks.filter((F.col("state") != "removed") & ~stale)


def live_identity_state(identities: DataFrame, now: dt.datetime, p: Params = DEFAULTS) -> DataFrame:
    """Identity state is dropped once the track was first seen too long ago."""
    return identities.filter(F.col("first_seen") >= before(now, dt.timedelta(seconds=p.identity_max_age_sec)))


def _per_person(tracks: DataFrame, persons: DataFrame, by: list[str]) -> DataFrame:
    """Active tracks folded by person before names are joined or listed."""
    return with_person_name(tracks.groupBy(*by, "person_id").agg(F.count(F.lit(1)).alias("n")), persons)


def _total(condition: Column | None = None) -> Column:
    n = F.col("n") if condition is None else F.when(condition, F.col("n"))
    return F.coalesce(F.sum(n), F.lit(0))


def occupancy(active: DataFrame, persons: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Is anyone home, who, how many unknown; an id without person row counts as neither.

    With many homes in one table ``by`` names the home columns, and each list is one household.
    """
    return _per_person(active, persons, by or []).groupBy(*(by or [])).agg(
        (_total() > 0).alias("home"), F.array_sort(F.collect_set("person_name")).alias("persons"),
        _total(F.col("person_id").isNull()).alias("unknown_count"), _total().alias("total_tracks"))


def occupancy_report(active: DataFrame, persons: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The printed report as rows: ``active`` and ``unknown`` tracks, and each identified name
    with how often it would be printed. An id without person row is active only."""
    kind = F.when(F.col("person_id").isNull(), "unknown").when(F.col("person_name").isNotNull(), "identified")
    lines = F.array(F.struct(F.lit("active").alias("line"), F.lit(None).cast("string").alias("person_name")),
                    F.struct(kind.alias("line"), F.col("person_name").alias("person_name")))
    folded = _per_person(active, persons, by or []).select(*(by or []), "n", F.explode(lines).alias("l"))
    return (folded.filter("l.line is not null").groupBy(*(by or []), "l.line", "l.person_name").agg(F.sum("n").alias("tracks")))


def sightings(log: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """A10: one row per entry with its exit, or without one while the track is still there.

    log: track_id, camera_id, ts, kind ('entry' / 'exit'), zone, seq. An entry is closed by the exit
    that comes next for the same track and camera; looking ahead is a running "last" over reversed
    time, cut into slots.
    """
    us = micros(F.col("ts"))
    d = log.withColumn("_back", -us).withColumn("_seq", -F.col("seq"))
    what = F.struct("kind", F.col("ts").alias("at"), F.col("zone").alias("left_by"))
    d = timeline.running_last(d, ["track_id", "camera_id"], ["_back", "_seq"], F.col("_back"), what, "_next", p.chunk_sec, inclusive=False)
    closed = F.col("_next.kind") == "exit"
    return d.filter("kind = 'entry'").select(
        "track_id", "camera_id", F.col("ts").alias("entered_at"), F.when(closed, F.col("_next.at")).alias("exited_at"),
        F.col("zone").alias("entry_zone"), F.when(closed, F.col("_next.left_by")).alias("exit_zone"))


# ---- persons --------------------------------------------------------------------------------

def faces_per_person(persons: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Active persons with the number of their enrolled faces (counted before the join)."""
    counts = embeddings.groupBy("person_id").agg(F.count("emb_id").alias("faces"))
    return (persons.filter("is_active").join(counts, "person_id", "left")
            .withColumn("faces", F.coalesce("faces", F.lit(0)).cast("long")))


def apply_deletions(persons: DataFrame, deletions: DataFrame) -> DataFrame:
    """Soft delete; deleted persons stay as rows with is_active = false."""
    gone = deletions.select("person_id").distinct().withColumn("_gone", F.lit(True))
    return (persons.join(gone, "person_id", "left")
            .withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone"))


def active_persons(persons: DataFrame) -> DataFrame:
    return persons.filter("is_active")


def purge_embeddings(embeddings: DataFrame, persons: DataFrame) -> DataFrame:
    """Vectors of deleted persons leave with them, from galleries as from reports."""
    return embeddings.join(active_persons(persons).select("person_id"), "person_id", "left_semi")


def frame_summary(tracks: DataFrame) -> DataFrame:
    """Tracks and identified tracks per camera and frame."""
    return tracks.groupBy("camera_id", "frame_number").agg(
        F.count(F.lit(1)).alias("track_count"), F.count("person_name").alias("identified_count"))


def set_difference(previous: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Ids of ``previous`` that are gone in ``current``, each once."""
    return previous.select(*key).distinct().join(current.select(*key), key, "left_anti")


def set_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
