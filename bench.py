"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from redwatch.plans import catalog, fixture

HEADLINE = (
    "red_features", "red_features_exact", "histogram_quantile", "counter_rate", "seasonal_baseline",
    "baseline_global", "derived_features", "score_replay", "alert_state_machine", "alert_episodes",
    "fault_attribution", "deploy_attribution", "service_graph", "detection_stats", "threshold_sweep",
    "iforest_score", "ks_cdf", "binary_metrics", "tumbling_red", "explanation_rubric",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("redwatch-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds: dict[str, float] = {}
    for key in HEADLINE:
        run = catalog.QUERIES[key]
        for attempt in ("warm-up", "timed"):
            # no stage table of an earlier query is reused: every query starts from the raw events
            fixture.forget()
            start = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            if attempt == "timed":
                seconds[key] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
