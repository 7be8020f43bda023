"""Performance candidates, profiles and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import PHASES, bucket, derived_overhead, dominant, has_id, known, latest_values, maintenance_bytes, maintenance_files, mean, rate, rows_processed, status_is, total, with_percentiles


def measures(df: DataFrame) -> DataFrame:
    """Executable runs that have a duration, with phase times, their sum and largest, and workload."""
    ran = df.filter(status_is("succeeded", "failed") & F.col("duration_seconds").isNotNull())
    phase = {f"{p}_phase": F.greatest(F.lit(0.0), F.coalesce(F.col(f"{p}_duration_seconds"), F.lit(0.0))) for p in PHASES[:3]} | {"overhead_phase": F.greatest(F.lit(0.0), derived_overhead())}
    ran = ran.withColumns(phase | {"operation_group": F.coalesce(F.nullif("operation_type", F.lit("")), F.lit("unknown")), "rows_processed": rows_processed(), "maintenance_bytes": maintenance_bytes(), "maintenance_files": maintenance_files()})
    largest, out = F.greatest(*phase), None
    for p in PHASES:
        test = F.col(f"{p}_phase") == largest
        out = F.when(test, p) if out is None else out.when(test, p)
    return ran.withColumns({"phase_total": sum((F.col(c) for c in phase), F.lit(0.0)), "largest_phase": largest, "bottleneck_phase": out})


def thresholds(m: DataFrame) -> DataFrame:
    """p75 and p95 of durations and medians of positive workloads for each operation type."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    groups = m.select("operation_group").distinct()
    return with_percentiles(groups, m, ["operation_group"], {"duration_p75": (F.col("duration_seconds"), 0.75), "duration_p95": (F.col("duration_seconds"), 0.95), "rows_p50": (positive("rows_processed"), 0.5), "bytes_p50": (positive("maintenance_bytes"), 0.5), "files_p50": (positive("maintenance_files"), 0.5)})


def optimization_candidates(df: DataFrame) -> DataFrame:
    """Measured runs with the first reason that applies: slow though small, much overhead, or one phase alone."""
    m = measures(df)
    m = m.join(thresholds(m), "operation_group")
    upkeep = F.col("operation_group") == "maintenance"
    slow = (F.col("duration_p95") > 0) & (F.col("duration_seconds") >= F.col("duration_p95"))
    longish = (F.col("duration_p75") > 0) & (F.col("duration_seconds") >= F.col("duration_p75"))
    small = lambda c, p: (F.col(p) > 0) & (F.col(c) > 0) & (F.col(c) <= F.col(p))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("phase_total")), F.lit(0.0))
    flags = {
        "slow_small_workload": ~upkeep & slow & small("rows_processed", "rows_p50"),
        "slow_small_maintenance": upkeep & slow & (small("maintenance_bytes", "bytes_p50") | ((F.col("maintenance_bytes") <= 0) & small("maintenance_files", "files_p50"))),
        "high_overhead": longish & (share("overhead_phase") >= 0.2),
        "phase_skew": ~upkeep & longish & (share("largest_phase") >= 0.9),
    }
    m = m.withColumns(flags)
    code, priority = None, None
    for name, p in zip(flags, (300, 300, 200, 100), strict=True):
        code = F.when(F.col(name), name) if code is None else code.when(F.col(name), name)
        priority = F.when(F.col(name), p) if priority is None else priority.when(F.col(name), p)
    return m.withColumns({"candidate_code": code, "candidate_priority": priority.otherwise(0)})


def candidate_count():
    return F.count("candidate_code").alias("candidates")


#: What is told of the slowest run (fixed values).
SLOWEST = {"duration_seconds": "duration_seconds", "dataflow_name": "dataflow_name", "dataflow_id": "dataflow_id", "dataflow_run_id": "dataflow_run_id", "job_id": "job_id", "start_time": "start_time", "end_time": "end_time", "stage": "stage", "operation_type": "operation_group", "status": "normalized_status"}


def record_counts(df: DataFrame, jf: DataFrame) -> DataFrame:
    """One row: records of both logs, first and last date of the dataflows, newest times, different engines and metadata providers."""
    different = lambda c: F.count_distinct(F.nullif(c, F.lit("unknown")))
    flows = df.agg(F.count(F.lit(1)).alias("dataflow_records"), F.min("run_date").alias("date_min"), F.max("run_date").alias("date_max"), F.max("event_time").alias("latest_dataflow_log_at"), different("engine_name").alias("active_engines"), different("metadata_provider_name").alias("active_metadata_providers"))
    jobs = jf.agg(F.count(F.lit(1)).alias("job_records"), F.max("event_time").alias("latest_job_log_at"))
    return flows.join(jobs).withColumn("latest_log_at", F.greatest("latest_dataflow_log_at", "latest_job_log_at"))


def performance_summary(df: DataFrame, jf: DataFrame) -> DataFrame:
    """One row of the measured runs: durations, the slowest run (of equal ones that of the last run id), the phase that takes most time, shares of phases, totals and
    candidates, with the records, dates and newest times of both logs. The slowest run's start and end are null if the runs don't have them.
    """
    c = optimization_candidates(df)
    slowest = F.max_by(F.struct(*[(F.col(x) if x in c.columns else F.lit(None).cast("timestamp")).alias(n) for n, x in SLOWEST.items()]), F.struct("duration_seconds", "dataflow_run_id")).alias("s")
    sums = [F.sum(f"{p}_phase").alias(f"__{p}") for p in PHASES]
    shares = [rate(F.sum(f"{p}_phase"), F.sum("phase_total")).alias(f"{p}_duration_percent") for p in PHASES]
    numbers = [F.count(F.lit(1)).alias("run_count"), mean("duration_seconds").alias("avg_duration_seconds"), F.coalesce(F.max("duration_seconds"), F.lit(0.0)).alias("max_duration_seconds")]
    totals = [F.coalesce(F.round(F.try_divide(F.sum("source_rows_read"), F.sum("duration_seconds")), 3), F.lit(0.0)).alias("rows_read_per_second"), total("source_rows_read").alias("total_rows_read"), total("destination_rows_written").alias("total_rows_written"), F.count("candidate_code").alias("optimization_candidate_count")]
    base = c.agg(*numbers, slowest, *sums, *shares, *totals, *[F.count_if(n).alias(f"{n}_count") for n in ("slow_small_workload", "slow_small_maintenance", "high_overhead", "phase_skew")])
    most, phase = F.greatest(*[f"__{p}" for p in PHASES]), F.lit("unknown")
    for p in reversed(PHASES):
        phase = F.when((F.col(f"__{p}") >= most) & ((F.col(f"__{p}") > 0) if p == "overhead" else F.lit(True)), p).otherwise(phase)
    told = base.withColumns({"bottleneck_phase": phase} | {f"slowest_run_{n}": F.coalesce(f"s.{n}", F.lit(0.0)) if n == "duration_seconds" else F.col(f"s.{n}") for n in SLOWEST}).drop("s", *[f"__{p}" for p in PHASES])
    out = with_percentiles(told, measures(df), [], {f"p{n}_duration_seconds": (F.col("duration_seconds"), n / 100) for n in (50, 75, 95, 99)})
    return out.join(record_counts(df, jf))


def efficiency_points(df: DataFrame, top: int = 200) -> DataFrame:
    out = optimization_candidates(df).orderBy(F.desc("candidate_priority"), F.desc("duration_seconds"), F.desc_nulls_last("event_time"), "dataflow_run_id").limit(top)
    return out.select("dataflow_run_id", "operation_group", "duration_seconds", "rows_processed", "maintenance_bytes", "maintenance_files", "bottleneck_phase", "candidate_code", "candidate_priority")


def stratified_points(df: DataFrame, top: int = 200) -> DataFrame:
    """Three quarters pipeline runs and one quarter maintenance runs; what one lacks the other fills."""
    from pyspark.sql import Window

    c = optimization_candidates(df).withColumn("is_maintenance", F.col("operation_group") == "maintenance")
    rank = Window.partitionBy("is_maintenance").orderBy(F.desc("candidate_priority"), F.desc("duration_seconds"), "dataflow_run_id")
    ranked = c.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= top)  # limited before the shuffle
    quota = F.when(F.col("is_maintenance"), top // 4).otherwise(top - top // 4)
    return ranked.withColumn("extra", F.col("r") > quota).orderBy("extra", "r", "dataflow_run_id").limit(top).select("dataflow_run_id", "is_maintenance", "duration_seconds", "candidate_priority")


def profiles(df: DataFrame, top: int = 40) -> DataFrame:
    """Durations and candidates of each dataflow, slowest first. Only candidates need thresholds, so only they are counted in the join with these."""
    m, c = measures(df).filter(has_id()), optimization_candidates(df).filter(has_id())
    base = m.groupBy("dataflow_id").agg(dominant("operation_group").alias("operation_type"), F.count(F.lit(1)).alias("runs"), mean("duration_seconds").alias("avg_duration"), F.max("duration_seconds").alias("max_duration"), dominant("bottleneck_phase").alias("bottleneck_phase"))
    names = latest_values(m, "dataflow_id", {"dataflow_name": F.nullif("dataflow_name", F.lit(""))})
    base = base.join(names, "dataflow_id", "left").join(c.groupBy("dataflow_id").agg(candidate_count()), "dataflow_id")
    out = with_percentiles(base.withColumn("dataflow_name", F.coalesce("dataflow_name", "dataflow_id")), m, ["dataflow_id"], {"p50_duration": (F.col("duration_seconds"), 0.5), "p95_duration": (F.col("duration_seconds"), 0.95)})
    return out.orderBy(F.desc("p95_duration"), F.desc("runs"), "dataflow_id").limit(top)


def context_profiles(df: DataFrame, top: int = 30) -> DataFrame:
    keys = ["platform_name", "engine_name", "metadata_provider_name"]
    c = optimization_candidates(df).withColumns({k: known(k) for k in keys})
    base = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.count_if(status_is("failed")).alias("failed"), mean("duration_seconds").alias("avg_duration"), F.round(F.try_divide(F.sum("source_rows_read"), F.sum("duration_seconds")), 3).alias("rows_per_second"), candidate_count())
    out = with_percentiles(base, c, keys, {"p95_duration": (F.col("duration_seconds"), 0.95)})
    return out.orderBy(F.desc("candidates"), F.desc("p95_duration"), F.desc("runs"), *keys).limit(top)


def performance_trend(df: DataFrame, grain: str = "day", tz: str = "UTC") -> DataFrame:
    c = optimization_candidates(df).filter("event_time is not null").withColumn("bucket_start", bucket("event_time", grain, tz))
    base = c.groupBy("bucket_start").agg(F.count(F.lit(1)).alias("runs"), candidate_count())
    return with_percentiles(base, c, ["bucket_start"], {"p50_duration": (F.col("duration_seconds"), 0.5), "p95_duration": (F.col("duration_seconds"), 0.95)})


def evidence_page(df: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    out = optimization_candidates(df).filter("candidate_code is not null").orderBy(F.desc("candidate_priority"), F.desc("duration_seconds"), "dataflow_run_id").limit(limit + offset).offset(offset)
    return out.select("dataflow_run_id", "candidate_code", "candidate_priority", "duration_seconds", "bottleneck_phase")


def duration_breakdown(df: DataFrame, top: int = 30) -> DataFrame:
    return measures(df).orderBy(F.desc("duration_seconds"), "dataflow_run_id").limit(top).select("dataflow_run_id", "duration_seconds", *[f"{p}_phase" for p in PHASES])


def duration_vs_rows(df: DataFrame, top: int = 200) -> DataFrame:
    return measures(df).filter("rows_processed > 0").orderBy(F.desc("duration_seconds"), F.desc("rows_processed"), "dataflow_run_id").limit(top).select("dataflow_run_id", "duration_seconds", "rows_processed")


def totals(df: DataFrame) -> DataFrame:
    """One row for the attention queue: candidates, p95 and median of durations and their ratio (0 without durations)."""
    c = optimization_candidates(df)
    base = c.agg(F.count("candidate_code").alias("optimization_candidate_count"), total("rows_processed").alias("rows_processed"))
    out = with_percentiles(base, c, [], {"p50_duration_seconds": (F.col("duration_seconds"), 0.5), "p95_duration_seconds": (F.col("duration_seconds"), 0.95)})
    return out.withColumn("duration_pressure_ratio", F.coalesce(F.try_divide("p95_duration_seconds", "p50_duration_seconds"), F.lit(0.0)))
