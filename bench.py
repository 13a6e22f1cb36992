"""Time the headline queries on one scale factor and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402
from custodia.session import build_session  # noqa: E402

HEADLINE = [
    "a4_cost_analysis", "a6_performance", "a9_trend_hourly", "a12_breakdown", "a22_kpi_summary", "a26_top_families",
    "a32_top_customers", "a34_monthly_revenue_by_region", "a37_cohorts", "g_percentiles", "w3_last_n", "m10_redact_analyst",
    "m33_governed_breakdown", "f8_purpose_filter_analytics", "n7_impact_analysis", "t12_trace_tree", "p6_scan_sensitive_values",
    "p8_column_statistics", "d1_detect_path_partition", "d2_partition_cardinality", "j5_uncatalogued_prefixes", "q1_scan_security",
    "y1_authorize_batch", "r4_retention_report", "t1_request_metrics", "t2_dedupe_requests_hot_key", "t3_health_transitions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # start-up, code generation and the Python workers are paid once, outside the timings
    for name in ("a12_breakdown", "t2_dedupe_requests_hot_key"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
