"""Wall time of the headline queries over the benchmark tables, as one JSON line.

Arguments are name prefixes of other queries to time instead; `all` times every one.

The session is warmed with one small query; each figure is one full run, the result
written to the engine's no-op sink so that every row is produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

from kerbline.plans import catalog
from kerbline.session import build_session

HEADLINE = [
    "A2_similarity_vote", "A13_quality_metrics", "J1_knn_topk", "J2_nearest_centroid", "A12_silhouette",
    "P7_applicability_gate", "A5_frame_rollup", "A7_defect_signals", "R3_assessment_record", "R5_problem_rule", "A8_condition_summary", "A17_pixel_confusion",
    "W3_track_finalisation", "J3_track_interpolation", "J4_heading_interpolation", "W7_chainage", "W8_gap_detection", "X2_auto_pause_states", "K1_geojson_route", "S9_track_json",
    "W1_stratified_split", "T6_stratified_negatives", "A1_manifest_statistics", "J7_effective_labels", "T3_review_queue", "U4_label_edit_fold",
    "A14_binary_metrics", "A15_per_label_metrics", "A16_threshold_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:]
    spark = build_session("bench", master=f"local[{cpus}]", **{"spark__sql__shuffle__partitions": cpus, "spark__driver__memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = HEADLINE
    if wanted:
        names = [n for n in catalog.QUERIES if wanted == ["all"] or n.startswith(tuple(wanted))]
    catalog.QUERIES["A1_manifest_statistics"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds, failed = {}, []
    for name in names:
        start = time.perf_counter()
        try:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as exc:  # noqa: BLE001
            failed.append(name)
            print(f"{name}: {exc}", file=sys.stderr)
        spark.catalog.clearCache()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total query wall time", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1], "failed": failed}))


if __name__ == "__main__":
    main()
