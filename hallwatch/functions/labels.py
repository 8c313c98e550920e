"""On-screen label of a track as one string column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _two(score: Column) -> Column:
    """Two decimals of the exact binary value (ties to even), unlike ``%.2f`` in Java."""
    return F.format_number(score, 2)


def track_label(track_id: Column, person_name: Column, by_reid: Column, confidence: Column,
                closest_name: Column, closest_score: Column, reid_score: Column, zone: Column,
                cameras_seen: Column, stationary_sec: Column) -> Column:
    """``Name (F:0.85)`` when known, else ``#id ~closest(0.41) R:0.45``; then zone, ``*`` and ``S:12s``.

    ``concat_ws`` skips the parts that do not apply because they are null.
    """
    known = F.format_string("%s (%s:%s)", person_name, F.when(by_reid, "R").otherwise("F"), _two(confidence))
    guess = F.when(closest_name.isNotNull(), F.format_string("~%s(%s)", closest_name, _two(closest_score)))
    score = F.when(reid_score >= 0, F.format_string("R:%s", _two(reid_score)))
    unknown = F.concat_ws(" ", F.concat(F.lit("#"), F.replace(track_id, F.lit("global_"), F.lit(""))), guess, score)
    return F.concat_ws(
        " ",
        F.when(person_name.isNotNull(), known).otherwise(unknown),
        F.when(zone.isNotNull(), F.format_string("[%s]", zone)),
        F.when(cameras_seen > 1, F.lit("*")),
        F.when(stationary_sec.isNotNull(), F.format_string("S:%ds", stationary_sec)),
    )
