"""Tunable values of every operator, gathered in one immutable record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Defaults that decide results, stated as they are documented.
    # motion gate
    motion_enabled: bool = True
    motion_min_ratio: float = 0.01
    motion_cooldown_sec: float = 5.0
    # person detection
    detection_confidence: float = 0.5
    person_class: int = 0
    frame_skip: int = 1
    warmup_frames: int = 2
    default_fps: int = 5
    # tracking inside one camera
    track_confidence: float = 0.5
    track_buffer: int = 30
    match_iou: float = 0.3
    confirm_hits: int = 3
    stationary_timeout_sec: float = 60.0
    # appearance matching
    reid_similarity: float = 0.65
    reappear_sec: float = 300.0
    gallery_size: int = 10
    min_crop_height: int = 100
    min_crop_width: int = 30
    min_visibility: float = 0.5
    min_gallery_quality: float = 0.3
    overlap_iou: float = 0.15
    grayscale_saturation: float = 15.0
    reid_confirm_frames: int = 30
    embedding_update_frames: int = 30
    # face matching
    face_similarity: float = 0.6
    min_face_size: int = 80
    multi_face_min_size: int = 20
    face_check_frames: int = 10
    face_consecutive: int = 2
    gallery_reload_sec: int = 60
    # topology
    zone_handover_sec: float = 5.0
    edge_handover_sec: float = 3.0
    edge_overlap: float = 0.3
    # housekeeping
    event_retention_days: int = 30
    archive_hours: int = 24
    identity_max_age_sec: float = 3600.0
    event_limit: int = 100
    event_report_limit: int = 50
    profile_events: int = 10
    # documented only
    static_shift: float = 0.02
    static_sec: float = 10.0

    # Physical layout: how finely time is cut so that no key stays whole in one task.
    chunk_sec: int = 3600
    watermark: str = "10 seconds"

    @property
    def face_check_sec(self) -> float:
        """Face checks are counted in frames of a nominal five-per-second stream."""
        return self.face_check_frames / float(self.default_fps)


DEFAULTS = Params()
