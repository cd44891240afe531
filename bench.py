"""Time the headline queries: one warm-up each, then the median of three runs, in wall seconds.

Prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the local cores;
``BENCH_ALL=1`` times every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from driftwarden.plans.registry import QUERIES
from driftwarden.session import build_session

HEADLINE = (
    "table_health", "row_recon", "row_recon_by_content", "key_checksum_exact", "row_fingerprint", "bucket_fingerprint",
    "diff_type_summary", "row_status_counts", "classify_diff", "sample_diff_values", "ts_offset_profile", "missing_keys",
    "cdc_gap", "cdc_gap_windowed", "cdc_pattern_detail", "schema_diff", "root_causes", "health_score_findings",
    "report_summary", "load_upsert", "transform_metrics", "etl_summary", "parse_task_log", "task_log_status",
    "duplicate_keys", "orphan_keys",
)


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else list(HEADLINE)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    seconds = {}
    for name in names:
        # the noop sink computes every row and column without collecting them in the driver
        run = lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()
        seconds[name] = round(statistics.median(timed(run) for _ in range(3)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
