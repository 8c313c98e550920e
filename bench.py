"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores) choose data and size.
Every result is consumed in full by a no-op sink, so no column can be pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "frame_overlap_summary", "exclusion_filter", "overlapping_pairs", "overlapping_ids", "polygon_zone", "persons_in_zone", "edge_exit_check",
    "crop_quality", "multi_face_crops", "best_face", "motion_gate", "detection_schedule", "carried_detections", "frame_rate_limit", "static_objects",
    "face_match", "person_gallery_match", "track_gallery_match", "gallery_cap_quality", "mean_embedding",
    "zone_handover_candidates", "zone_handover_resolved", "reappearance_candidates", "global_tracks", "identity_linking", "face_confirmation",
    "stationary_time", "lost_between_frames", "camera_tracker", "event_query", "recent_tracks", "occupancy", "sightings", "track_upsert",
    "observed_identities", "live_gallery_matches", "reid_schedule", "reappearance_stream", "identity_stream", "motion_gate_stream", "frame_rate_limit_stream", "event_sink_stream", "track_upsert_stream", "gallery_reload_stream",
    "gallery_expiry_stream", "zone_handover_stream", "camera_tracker_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 4)
    names = sys.argv[1:] or HEADLINE

    from hallwatch.plans.catalog import all_queries
    from hallwatch.session import local_session

    spark = local_session(cpus, partitions=max(8, int(cpus)))
    spark.sparkContext.setLogLevel("OFF")
    known, seconds = all_queries(), {}
    # start the JIT and the Python workers before the first timed query
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_suppkey").sum("l_quantity").orderBy("l_suppkey").collect()
    spark.range(64).groupBy("id").applyInPandas(lambda pdf: pdf, "id long").count()
    for name in names:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
