"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
Every query runs twice; the better time counts, so that JVM warm-up does not.
"""

from __future__ import annotations

import json
import os
import time

from demandspark.plans.registry import load_all
from demandspark.session import build_session

HEADLINE = (
    "hourly_counts", "monthly_partial_final", "min_volume_stations", "entity_rollup", "dense_panel", "lag_features",
    "rolling_features", "feature_panel", "calendar_features", "solar_features", "chronological_split",
    "naive_baseline_metrics", "naive_baseline_by_station", "sequences", "predictions_vs_actual",
    "interval_departures", "interval_departures_sliced", "hourly_proxy", "proxy_quality", "upsert_merge",
    "label_precedence", "latest_window", "json_payload_roundtrip", "psi_by_feature", "two_sample_by_feature",
    "retrain_decision", "freshness", "champion_challenger", "stream_interval_diff", "stream_hourly",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    times: dict[str, float] = {}
    for name in wanted:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
