"""Seconds per headline query: one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES are read."""

from __future__ import annotations

import json
import os
import sys
import time

from sievemark.plans import catalog
from sievemark.session import build_session

HEADLINES = (
    "duplicate_status status_precedence near_document_links leakage_groups nearest_benchmark similar_vectors"
    " similar_components group_split cv_fold_counts collection_fingerprint describe_measures boxplot_stats"
    " balance_table pattern_crosstab rank_bins data_profile core_metrics macro_auroc selective_curve"
    " poisson_bootstrap calibration_summary prediction_sets label_issues foreign_test_report decisions"
    " corruption_sweep severity_terciles running_best log_monitor gated_stream"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES
    spark = build_session("bench", cores)
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        # every row and column is produced; nothing is brought to the driver
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("/", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
