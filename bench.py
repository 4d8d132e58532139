"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.registry import load  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "flagship_feature_auroc", "P6_category_flags", "P14_unit_conversion", "J6_as_of", "J7_trailing_range", "A4_exact_quantiles", "A11_baseline_table", "W3_lookback_rise",
    "C9_event_axis", "C12_stage_labels", "C14_window_features", "C14_wide_table", "E1_auroc", "E2_average_precision", "E8_calibration_error",
    "E10_calibration_slope", "E12_cluster_bootstrap", "E15_paired_difference", "E17_delong", "E18_calibration_replicates", "E20_proximity_replicates", "E24_site_distribution",
    "L1_group_split", "L19_leave_site_out", "D1_deployment", "D2_threshold_sweep", "D4_four_view", "D11_outcome_gradient",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", "16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    for name in ("A1_basic", "flagship_feature_auroc", "D1_deployment"):  # let the JVM compile the common paths
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
