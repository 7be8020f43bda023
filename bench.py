"""Times headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS."""

import json
import os
import time

from pyspark.sql import SparkSession

from runlens import catalog

HEADLINE = ["o03_job_summary", "o04_dataflow_summary", "o05_status_trend_day", "p01_phase_summary", "p02_duration_distribution", "p05_endpoint_health", "x09_failure_summary", "x11_repeated_signatures", "r03_freshness_registry", "e05_performance_summary", "v04_volume_summary", "v09_volume_registry", "m02_registry", "q01_job_linkage", "q08_investigation_queue", "i06_plan_incremental", "l13_resolve_references", "l22_asset_inventory"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made, seconds = catalog.queries(), {}
    # the first query of a session publishes the facts that all others read: a headline of its own
    start = time.perf_counter()
    made["o04_dataflow_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds["publication"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        made[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
