"""Times the table builds and the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Reads run on the written tables, as the dashboard does; jobs run from the stored events.
HEADLINE = (
    "B9_hourly_rollup", "B11_groups", "B13_hourly_cap", "C1_normalize_documents",
    "C20_fingerprint_v2", "C23_replay_coverage", "D2_regressions", "E6_shadow_evaluation",
    "E11_hindsight", "E13_scorecard", "E15_backtest", "F5_alert_feed", "G2_retention_survivors",
    "H1_group_page", "H1_orders_page", "H2_counts_by_status", "H3_overview_trend",
    "H6_sparklines", "H8_group_series_days", "H9_similar_to_one", "H10_similar_groups",
    "H13_trend_summary", "I3_drift", "F1_cooldown", "F2_alerts", "D1_status_intervals",
    "H7_group_detail", "G2_bounded_delete", "B11_groups_in_three_parts",
)
BUILDS = ("raw", "events", "rollups", "stored", "groups", "intervals", "comebacks", "states",
          "observations", "alerts")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from faultsift.plans.registry import QUERIES
    from faultsift.plans.warehouse import Warehouse
    from faultsift.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-shared-"),
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    warehouse = Warehouse(spark, sf_dir)
    timings: dict[str, float] = {}
    for name in BUILDS:
        started = time.perf_counter()
        getattr(warehouse, name)()
        timings[f"build_{name}"] = round(time.perf_counter() - started, 3)
    stored = warehouse.events().count()
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run pays for code generation
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            best = took if best is None else min(best, took)
        timings[name] = round(best, 3)
    total = round(sum(timings.values()), 3)
    print(json.dumps({
        "metric": "total time of table builds and headline queries", "value": total,
        "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")),
        "stored_events": stored,
        "ingest_ms_per_event": round(1000 * timings["build_events"] / max(stored, 1), 4)}))
    spark.stop()


if __name__ == "__main__":
    main()
