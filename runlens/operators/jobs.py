"""Job metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import known, rate, status_counts, status_is, zero

KEYS = ["_source_id", "job_id"]


def latest_jobs(jf: DataFrame) -> DataFrame:
    """Newest row of each job; of rows of one time that with the longest duration, then the last status in alphabetical order."""
    newest = Window.partitionBy(*KEYS).orderBy(F.desc_nulls_last("event_time"), F.desc_nulls_last("duration_seconds"), F.desc_nulls_last("normalized_status"))
    return jf.withColumn("__r", F.row_number().over(newest)).filter("__r = 1").drop("__r")


def job_workload_efficiency(df: DataFrame, jf: DataFrame, top: int = 500) -> DataFrame:
    """Work of each job and operation type with its throughput."""
    kind = F.coalesce(F.nullif("operation_type", F.lit("")), F.lit("unknown"))
    work = df.filter("job_id is not null").groupBy(*KEYS, kind.alias("operation_type")).agg(F.sum(F.coalesce("duration_seconds", F.lit(0.0))).alias("duration_seconds"), F.count(F.lit(1)).alias("child_runs"), F.count_if(status_is("failed")).alias("failed_children"), F.count_if(status_is("skipped")).alias("skipped_children"), *[F.sum(zero(c)).alias(n) for n, c in (("rows_read", "source_rows_read"), ("rows_written", "destination_rows_written"), ("bytes_added", "destination_bytes_added"))])
    jobs = latest_jobs(jf).select(*KEYS, "normalized_status", known("engine_name").alias("engine_name"), known("platform_name").alias("platform_name"))
    out = work.filter("duration_seconds > 0").join(jobs, KEYS, "left")
    status = F.coalesce("normalized_status", F.when(F.col("failed_children") > 0, "failed").otherwise("unknown"))
    out = out.select("job_id", "_source_id", status.alias("status"), "operation_type", known("engine_name").alias("engine_name"), known("platform_name").alias("platform_name"), "duration_seconds", "child_runs", "failed_children", "skipped_children", "rows_read", "rows_written", "bytes_added", F.round(F.col("rows_read") / F.col("duration_seconds"), 3).alias("rows_per_second"))
    return out.orderBy(F.desc("duration_seconds"), F.desc("child_runs"), "job_id", "operation_type").limit(top)


def child_fanout(jf: DataFrame) -> DataFrame:
    return jf.filter("total_dataflows > 0").groupBy("total_dataflows").agg(F.count(F.lit(1)).alias("jobs"), *status_counts())


def job_status_by_stage(df: DataFrame, jf: DataFrame) -> DataFrame:
    """Jobs that touched a stage by their latest status."""
    touched = df.filter("job_id is not null").select(*KEYS, F.coalesce(F.nullif("stage", F.lit("")), F.lit("unknown")).alias("stage")).distinct()
    both = touched.join(latest_jobs(jf).select(*KEYS, "normalized_status"), KEYS, "left").fillna("unknown", ["normalized_status"])
    return both.groupBy("stage").agg(F.count(F.lit(1)).alias("touched_jobs"), *status_counts())


def latest_failed_job(jf: DataFrame) -> DataFrame:
    return jf.filter(status_is("failed") & F.col("event_time").isNotNull()).orderBy(F.desc("event_time"), "job_id").limit(1).select("job_id", "event_time", "duration_seconds", "engine_name", "stages", "operation_types")


METRICS = ("dataflows", "failed", "skipped", "succeeded")


def job_comparisons(jf: DataFrame, df: DataFrame) -> DataFrame:
    """(source, job, metric, expected, observed) wherever a job counts its children otherwise than they are."""
    counts = {"dataflows": F.count(F.lit(1)), **{m: F.count_if(status_is(m)) for m in METRICS[1:]}}
    kids = df.filter("job_id is not null").groupBy(*KEYS).agg(*[c.alias(f"seen_{m}") for m, c in counts.items()])
    pairs = F.array(*[F.struct(F.lit(f"total_{m}").alias("metric"), F.col(f"total_{m}").cast("long").alias("expected"), F.coalesce(f"seen_{m}", F.lit(0)).alias("observed")) for m in METRICS])
    return jf.join(kids, KEYS, "left").select(*KEYS, F.inline(pairs)).filter("expected <> observed").withColumn("difference", F.col("observed") - F.col("expected"))


def reconcile_jobs(jf: DataFrame, df: DataFrame, top: int = 50) -> DataFrame:
    return job_comparisons(jf, df).orderBy("job_id", "metric").limit(top)


def enrich_job_runs(jf: DataFrame, df: DataFrame) -> DataFrame:
    """Jobs with reconciliation status, shape key and an error preview."""
    from ..functions.columns import compact_text, job_key

    bad = job_comparisons(jf, df).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("mismatches"))
    state = F.when(F.coalesce(*[F.col(f"total_{m}") for m in METRICS]).isNull(), "not_available").when(F.col("mismatches") > 0, "mismatch").otherwise("matched")
    return jf.join(bad, KEYS, "left").select(*KEYS, "normalized_status", state.alias("reconciliation"), job_key().alias("job_key"), compact_text("error_message", 40).alias("error_preview"))


def slowest_jobs(jf: DataFrame, top: int = 20) -> DataFrame:
    return jf.filter("duration_seconds is not null").orderBy(F.desc("duration_seconds"), "job_id").limit(top).select("job_id", "duration_seconds", "normalized_status")


def child_rollup(jf: DataFrame, df: DataFrame) -> DataFrame:
    """jf with the number of its dataflow runs, of failed and skipped ones, their interpolated 95th percentile of seconds, and its mismatches."""
    kids = df.filter("job_id is not null").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("kids"), F.count_if(status_is("failed")).alias("child_failed_count"), F.count_if(status_is("skipped")).alias("child_skipped_count"), F.percentile("duration_seconds", 0.95).alias("child_p95_duration_seconds"))
    bad = job_comparisons(jf, df).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("reconciliation_mismatch_count"))
    return jf.join(kids, KEYS, "left").join(bad, KEYS, "left").fillna(0, ["kids", "child_failed_count", "child_skipped_count", "child_p95_duration_seconds", "reconciliation_mismatch_count"])


def jobs_by_child_impact(jf: DataFrame, df: DataFrame, top: int = 20) -> DataFrame:
    """Jobs with children by failed ones, mismatches, skipped ones, number and 95th percentile of seconds, the largest first; ties by job id.

    Where a job has no dataflow runs, the number that it told itself counts.
    """
    rows = child_rollup(jf, df).withColumn("child_dataflow_count", F.when(F.col("kids") > 0, F.col("kids")).otherwise(zero("total_dataflows")).cast("long"))
    order = ["child_failed_count", "reconciliation_mismatch_count", "child_skipped_count", "child_dataflow_count", "child_p95_duration_seconds"]
    some = rows.filter("child_dataflow_count > 0 or child_failed_count > 0 or child_skipped_count > 0 or child_p95_duration_seconds > 0")
    wanted = some.select("job_id", F.col("normalized_status").alias("status"), *order, zero("duration_seconds").alias("duration_seconds"))
    return wanted.orderBy(*[F.desc(c) for c in order], "job_id").limit(top)


#: Code, severity, title and base of the score of what makes a job worth a look (fixed values).
ATTENTION = (
    ("job_failed", "bad", "Failed job", 5000),
    ("child_dataflow_failed", "bad", "Child dataflows failed", 4000),
    ("job_reconciliation_mismatch", "warning", "Reconciliation mismatch", 3000),
    ("job_duration_p99", "warning", "P99 duration job", 2000),
    ("job_duration_p95", "info", "P95 duration job", 1000),
)


def job_attention_items(jf: DataFrame, df: DataFrame, top: int = 8) -> DataFrame:
    """One item for each reason that a job gives: failed, failed children, mismatched counts, a duration at the 99th or else the 95th percentile.

    The score is the reason's base and, in this order, the seconds of the failure's time, the failed children, the mismatches or the duration; the highest
    come first, ties by job and code.
    """
    from ..functions.columns import nearest_percentiles

    limits = nearest_percentiles(jf.filter(status_is("succeeded", "failed")), [], {"p95": (F.col("duration_seconds"), 0.95), "p99": (F.col("duration_seconds"), 0.99)})
    rows = child_rollup(jf, df).join(F.broadcast(limits), how="left").withColumn("seconds", zero("duration_seconds"))
    at_p99 = (F.col("p99") > 0) & (F.col("seconds") >= F.col("p99"))
    at_p95 = (F.col("p95") > 0) & (F.col("seconds") >= F.col("p95")) & ~F.coalesce(at_p99, F.lit(False))
    failed_at = F.coalesce(F.unix_micros("event_time") / 1e6, F.lit(0.0))
    tests = (status_is("failed"), F.col("child_failed_count") > 0, F.col("reconciliation_mismatch_count") > 0, at_p99, at_p95)
    extra = (failed_at, F.col("child_failed_count"), F.col("reconciliation_mismatch_count"), F.col("seconds"), F.col("seconds"))
    items = [F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), (F.lit(float(base)) + more).alias("score"))) for (code, severity, title, base), test, more in zip(ATTENTION, tests, extra, strict=True)]
    found = rows.select(known("job_id").alias("job_id"), F.inline(F.array_compact(F.array(*items))))
    return found.orderBy(F.desc("score"), "job_id", "code").limit(top).select("job_id", "code", "severity", "title", F.round("score", 3).alias("score"))
