"""Headline queries at one scale; prints a single JSON line.

Every query writes to the noop sink, so that all rows and columns are computed and none
are moved to the driver. JVM and Python workers are warmed up first; each query is timed once.
"""

from __future__ import annotations

import json
import os
import time

from gridspark.plans import QUERIES
from gridspark.plans.inputs import read_table
from gridspark.session import local_session

HEADLINE = [
    "accuracy_summary", "accuracy_per_image", "error_taxonomy", "confusion_matrix", "calibration",
    "threshold_sweep", "accuracy_distribution", "frames_summary", "by_device", "scored_by_join",
    "samples_per_class", "detection_summary", "latency_frames", "ranked_table", "early_stopping",
    "greedy_min_gap", "best_quad", "top_quads", "rank_disagreement", "component_consistency",
    "warp_deviation", "validate_units", "violation_report", "candidates", "solve_batch",
    "solve_distinct", "solve_gate", "distribution_profile", "glyph_quality", "group_disjoint_split",
    "leakage_check", "recognize", "stream_score", "windowed_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores))
    run = lambda name, where: QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
    small = "/root/testdata/sf0.001"
    for name in ("accuracy_summary", "solve_batch", "recognize"):
        run(name, small if os.path.isdir(small) else sf_dir)
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name, sf_dir)
        times[name] = round(time.perf_counter() - start, 3)
    images = read_table(spark, sf_dir, "orders").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "puzzles_per_sec": round(images / times["solve_distinct"], 1),
        "cells_per_sec": round(81 * images / times["accuracy_summary"]),
    }))


if __name__ == "__main__":
    main()
