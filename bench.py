"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from treadline.session import local_session  # noqa: E402

HEADLINE = (
    "gait_basics", "gait_basics_corrected", "contact_runs", "gap_interpolation", "stride_summary", "traversals", "step_metrics",
    "limb_contact_metrics", "joint_stance", "support_patterns", "coordination", "step_sequence_shares", "phase_dispersion", "contact_cycles",
    "pressure_centre_path", "union_projection", "detection_statistics", "median_filter", "rolling_background", "box_intensity", "limb_assignment",
    "nearest_track_to_truth", "detector_evaluation", "iou_tracks", "triangulation", "joint_angles", "gait_suite", "store_round_trip",
    "stream_traversals")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4)), "bench")
    from treadline.catalog import load
    queries = load().QUERIES
    # One untimed query starts the JVM's code paths and the Python workers.
    queries["gait_basics"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        t = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


main()
