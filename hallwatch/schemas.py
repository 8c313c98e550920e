"""Explicit schemas of the tables the operators read and write; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _L, _I, _S, _B, _TS = (
    T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.TimestampType(),
)
VECTOR = T.ArrayType(T.FloatType())
POLYGON = T.ArrayType(T.ArrayType(_D))
RECTANGLE = T.StructType([T.StructField(n, _D) for n in ("x1", "y1", "x2", "y2")])


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


_BOX = dict(x1=_D, y1=_D, x2=_D, y2=_D)
_SEEN = dict(camera_id=_S, frame_number=_L, ts=_TS)

FRAMES = _table(**_SEEN, frame_w=_I, frame_h=_I, motion_ratio=_D)
DETECTIONS = _table(**_SEEN, det_id=_L, **_BOX, confidence=_D, class_id=_I)
LOCAL_TRACKS = _table(**_SEEN, track_id=_L, **_BOX, confidence=_D, state=_S, hits=_I, time_since_update=_I)
FACES = _table(**_SEEN, track_id=_L, face_id=_I, **_BOX, confidence=_D, embedding=VECTOR)
CROPS = _table(**_SEEN, track_id=_L, width=_I, height=_I, mean_saturation=_D, laplacian_var=_D, embedding=VECTOR)

CAMERAS = _table(camera_id=_S, name=_S, fps=_I, exclusion_zones=T.ArrayType(RECTANGLE))
ZONE_CONFIG = _table(
    zone_ord=_I, name=_S, max_handover_sec=_D, cameras=T.MapType(_S, _table(polygon=POLYGON)),
)
OVERLAP_CONFIG = _table(
    cameras=T.ArrayType(_S), cam1_exit_zone=T.ArrayType(_D), cam2_entry_zone=T.ArrayType(_D),
    max_handover_sec=_D, overlap_ord=_L,
)

PERSONS = _table(person_id=_L, name=_S, created_at=_TS, is_active=_B)
FACE_EMBEDDINGS = _table(emb_id=_L, person_id=_L, embedding=VECTOR, source_image=_S, created_at=_TS)
TRACKS = _table(
    track_id=_S, person_id=_L, first_seen=_TS, last_seen=_TS, last_camera_id=_S, status=_S,
    reid_embedding=VECTOR, face_embedding=VECTOR, extra_data=_S,
)
SIGHTINGS = _table(
    track_id=_S, camera_id=_S, entered_at=_TS, exited_at=_TS, entry_zone=_S, exit_zone=_S, snapshot_path=_S,
)
EVENTS = _table(
    event_id=_L, ts=_TS, camera_id=_S, event_type=_S, track_id=_S, person_id=_L, confidence=_D,
    snapshot_path=_S, extra_data=_S,
)
