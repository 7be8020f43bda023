"""Environment and overview metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EXECUTABLE, STATUSES, bucket, estimated_rows_written, is_maintenance, known, listish, rate, status_counts, status_is, success_rate, total, with_percentiles, zero
from ..functions.failure_rules import failure_category
from .failures import failure_message
from .jobs import job_comparisons

DURATIONS = {"q1": 0.25, "p50": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}


def _duration_stats(df: DataFrame, counts: list) -> DataFrame:
    ran = F.when(status_is(*EXECUTABLE), F.col("duration_seconds"))
    base = df.agg(*counts, F.count(ran).alias("duration_count"), F.coalesce(F.round(F.avg(ran), 3), F.lit(0.0)).alias("avg_duration_seconds"), F.coalesce(F.round(F.max(ran), 3), F.lit(0.0)).alias("max_duration_seconds"))
    return with_percentiles(base, df, [], {f"{k}_duration_seconds": (ran, p) for k, p in DURATIONS.items()})


def rates() -> list:
    n = F.count(F.lit(1))
    ran = [rate(F.count_if(status_is(s)), F.count_if(status_is(*EXECUTABLE))).alias(f"{a}_rate") for s, a in (("succeeded", "success"), ("failed", "failure"))]
    return ran + [rate(F.count_if(status_is(s)), n).alias(f"{a}_rate") for s, a in (("skipped", "skip"), ("running", "running"), ("pending", "pending"))]


def job_summary(jf: DataFrame) -> DataFrame:
    """Counts, rates over executable runs, sums of children and duration statistics of jobs."""
    sums = [total(c).alias(c) for c in ("total_skipped", "total_pending", "total_running")] + [(total("total_rows_read") + total("total_rows_written")).alias("total_rows_processed")]
    distinct = [F.countDistinct(F.nullif(c, F.lit(""))).alias(f"distinct_{c}") for c in ("engine_name", "metadata_provider_name")]
    return _duration_stats(jf, [F.count(F.lit(1)).alias("total_jobs"), *status_counts(), *rates(), *sums, *distinct])


def dataflow_summary(df: DataFrame) -> DataFrame:
    sums = [total(c).alias(f"sum_{c}") for c in ("source_rows_read", "destination_rows_written", "destination_bytes_added")]
    net = (total("destination_bytes_added") - total("destination_bytes_removed")).alias("net_bytes_change")
    return _duration_stats(df, [F.count(F.lit(1)).alias("total_dataflows"), *status_counts(), *rates(), *sums, net])


def status_trend(df: DataFrame, grain: str = "day", tz: str = "UTC") -> DataFrame:
    """Long form: bucket, status, count."""
    return df.filter("event_time is not null").groupBy(bucket("event_time", grain, tz).alias("bucket_start"), F.col("normalized_status").alias("status")).agg(F.count(F.lit(1)).alias("count"))


def status_trend_wide(df: DataFrame, grain: str = "day", tz: str = "UTC") -> DataFrame:
    """A column for each status, the executable total, and rates that are null without executable runs."""
    folded = F.when(status_is(*STATUSES), F.col("normalized_status")).otherwise("unknown")
    wide = df.filter("event_time is not null").withColumn("s", folded).groupBy(bucket("event_time", grain, tz).alias("bucket_start")).pivot("s", [*STATUSES, "unknown"]).count().fillna(0)
    ran = F.col("succeeded") + F.col("failed")
    return wide.withColumns({"executable": ran, "success_rate": rate(F.col("succeeded"), ran), "failure_rate": rate(F.col("failed"), ran)})


def operation_windows(df: DataFrame, jf: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """Runs of today, the last 24 hours and the last 7 days, for jobs and dataflows. A job's running, pending and skipped come from its children."""
    now = F.to_timestamp(F.lit(as_of))
    local, today = F.from_utc_timestamp("event_time", tz), F.to_date(F.from_utc_timestamp(now, tz))
    hit = F.array_compact(F.array(F.when(F.to_date(local) == today, F.lit("today")), F.when((F.col("event_time") > now - F.expr("INTERVAL 24 HOURS")) & (F.col("event_time") <= now), F.lit("last_24h")), F.when((F.col("event_time") > now - F.expr("INTERVAL 7 DAYS")) & (F.col("event_time") <= now), F.lit("last_7d"))))
    one = lambda s: F.when(status_is(s), 1).otherwise(0)
    flows = df.select(F.lit("dataflow").alias("record_type"), F.explode(hit).alias("window"), *[one(s).alias(s) for s in STATUSES])
    jobs = jf.select(F.lit("job").alias("record_type"), F.explode(hit).alias("window"), one("succeeded").alias("succeeded"), one("failed").alias("failed"), *[zero(f"total_{s}").alias(s) for s in ("skipped", "running", "pending")])
    return flows.unionByName(jobs).groupBy("record_type", "window").agg(F.count(F.lit(1)).alias("runs"), *[F.sum(s).cast("long").alias(s) for s in STATUSES])


def runtime_contexts(jf: DataFrame, top: int = 30) -> DataFrame:
    keys = ["engine_name", "metadata_provider_name", "platform_name"]
    jf = jf.withColumns({k: known(k) for k in keys})
    ran = F.when(status_is(*EXECUTABLE), F.col("duration_seconds"))
    base = jf.groupBy(*keys).agg(F.count(F.lit(1)).alias("jobs"), *status_counts(False), success_rate().alias("success_rate"), F.coalesce(F.round(F.avg(ran), 3), F.lit(0.0)).alias("avg_duration_seconds"))
    return with_percentiles(base, jf, keys, {"p95_duration_seconds": (ran, 0.95)}).orderBy(F.desc("failed"), F.desc("jobs"), *keys).limit(top)


def operation_health(df: DataFrame, jf: DataFrame) -> DataFrame:
    jobs = jf.select("_source_id", "job_id", "normalized_status", F.explode(listish("operation_types")).alias("operation_type")).withColumn("operation_type", known("operation_type")).distinct()
    both = jobs.select(F.lit("job").alias("record_type"), "operation_type", "normalized_status").unionByName(df.select(F.lit("dataflow").alias("record_type"), F.coalesce(F.nullif("operation_type", F.lit("")), F.lit("unknown")).alias("operation_type"), "normalized_status"))
    return both.groupBy("record_type", "operation_type").agg(F.count(F.lit(1)).alias("count"), *status_counts(False))


def workload_trend(df: DataFrame, grain: str = "day", tz: str = "UTC") -> DataFrame:
    """Rows, bytes and files by bucket, with estimates where a sink doesn't count rows."""
    columns = ["source_rows_read", "destination_rows_written", "destination_rows_inserted", "destination_rows_updated", "destination_rows_deleted", "destination_bytes_added", "destination_bytes_removed", "destination_bytes_saved", "destination_files_added", "destination_files_removed"]
    return df.filter("event_time is not null").withColumn("est", estimated_rows_written()).groupBy(bucket("event_time", grain, tz).alias("bucket_start")).agg(F.count(F.lit(1)).alias("runs"), *[total(c).alias(c) for c in columns], F.sum("est").alias("estimated_rows_written"), (total("destination_bytes_added") - total("destination_bytes_removed")).alias("net_bytes"))


def failure_category_counts(df: DataFrame) -> DataFrame:
    return df.filter(status_is("failed")).groupBy(failure_category(failure_message()).alias("category")).agg(F.count(F.lit(1)).alias("count"))


def top_failing_dataflow(df: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("dataflow_name", F.lit("")), F.nullif("dataflow_id", F.lit("")), F.lit("unknown"))
    return df.filter(status_is("failed")).groupBy(name.alias("dataflow_name"), "dataflow_id").agg(F.count(F.lit(1)).alias("error_count")).orderBy(F.desc("error_count"), "dataflow_name", "dataflow_id").limit(1)


def log_coverage(df: DataFrame, jf: DataFrame, read_errors: DataFrame | None = None, sources: int | None = None) -> DataFrame:
    """One row: coverage_status (missing_sources, no_records, error, partial or complete) and the number of read errors.

    read_errors: a row for each log that couldn't be read. sources: number of configured log sources, if known.
    """
    failed = df.sparkSession.range(0) if read_errors is None else read_errors
    errors = failed.agg(F.count(F.lit(1)).alias("read_errors"))
    records = df.select(F.lit(1).alias("x")).limit(1).unionAll(jf.select(F.lit(1).alias("x")).limit(1)).agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("read_errors") > 0, F.when(F.col("n") > 0, "partial").otherwise("error")).when(F.lit(sources == 0), "missing_sources").when(F.col("n") == 0, "no_records").otherwise("complete")
    return records.join(errors).select(status.alias("coverage_status"), "read_errors")


def health_inputs(df: DataFrame, jf: DataFrame, as_of: str) -> DataFrame:
    """One row: newest logs, recent failures of jobs, dataflows and maintenance, jobs whose totals differ from their children, and linkage gaps."""
    now = F.to_timestamp(F.lit(as_of))
    since = lambda d: F.col("event_time") >= now - F.expr(f"INTERVAL {d} DAYS")
    failed, upkeep = status_is("failed"), is_maintenance()
    flows = df.agg(
        F.max("event_time").alias("latest_dataflow_log_at"),
        *[F.count_if(failed & since(d)).alias(f"failed_dataflows_last_{d}_days") for d in (3, 7)],
        *[F.count_if(failed & upkeep & since(d)).alias(f"maintenance_failed_last_{d}_days") for d in (7, 14)],
        F.count_if(status_is("skipped") & upkeep & since(7)).alias("maintenance_skipped_last_7_days"),
    )
    jobs = jf.agg(F.max("event_time").alias("latest_job_log_at"), F.count(F.lit(1)).alias("total_jobs"), *[F.count_if(failed & since(d)).alias(f"failed_jobs_last_{d}_days") for d in (3, 7)])
    differ = job_comparisons(jf, df).agg(F.countDistinct("_source_id", "job_id").alias("mismatch_count"))
    keys = ["_source_id", "job_id"]
    own, kids = (x.filter("job_id is not null").select(*keys).distinct() for x in (jf, df))
    gaps = kids.withColumn("kid", F.lit(1)).join(own.withColumn("own", F.lit(1)), keys, "full_outer")
    # one job id may be missing in several sources
    gaps = gaps.agg(F.countDistinct(F.when(F.col("own").isNull(), F.col("job_id"))).alias("orphan_dataflow_job_ids"), F.countDistinct(F.when(F.col("kid").isNull(), F.col("job_id"))).alias("jobs_without_dataflow_records"))
    newest = F.greatest("latest_job_log_at", "latest_dataflow_log_at")
    age = F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(newest.cast("timestamp"))) / 86400))
    return flows.join(jobs).join(differ).join(gaps).withColumns({"latest_log_at": newest, "latest_log_age_days": age})


#: Ranks of health; the worst that applies is the status.
HEALTH = ("healthy", "no_log_evidence", "warning", "has_issues")


def environment_health(inputs: DataFrame) -> DataFrame:
    """Status and reasons from one row of health inputs with coverage_status.

    A rule with a narrower window hides the wider one of its kind, so each kind gives at most one reason, in a fixed order.
    """
    age = F.col("latest_log_age_days")
    some = lambda *names: F.greatest(*[F.col(n) > 0 for n in names], F.lit(False))
    aged = F.format_string("Latest log is %d days old.", age)
    # kinds of rules: (condition, status, reason), of which the first that holds counts; reasons are fixed values
    steps = [
        [(F.col("coverage_status").isin("missing_sources", "no_records"), "no_log_evidence", F.lit("No complete ETL log evidence is available."))],
        [(F.col("coverage_status").isin("error", "partial"), "warning", F.lit("Log coverage is partial or has read errors."))],
        [(age > 30, "has_issues", aged), (age > 7, "warning", aged)],
        [(some("failed_jobs_last_3_days", "failed_dataflows_last_3_days"), "has_issues", F.lit("Recent failures were found in the last 3 days.")), (some("failed_jobs_last_7_days", "failed_dataflows_last_7_days"), "warning", F.lit("Failures were found in the last 7 days."))],
        [(some("maintenance_failed_last_7_days"), "has_issues", F.lit("Maintenance failures were found in the last 7 days.")), (some("maintenance_failed_last_14_days"), "warning", F.lit("Maintenance failures were found in the last 14 days."))],
        [(some("maintenance_skipped_last_7_days"), "warning", F.lit("Skipped maintenance operations were found in the last 7 days."))],
        [(some("mismatch_count"), "warning", F.lit("Job and dataflow log totals do not fully reconcile."))],
    ]
    found = []
    for kind in steps:
        hit = None
        for condition, status, reason in kind:
            said = F.struct(F.lit(HEALTH.index(status)).alias("rank"), reason.alias("reason"))
            hit = F.when(condition, said) if hit is None else hit.when(condition, said)
        found.append(hit)
    out = inputs.withColumn("__found", F.array_compact(F.array(*found)))
    worst = F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform("__found", lambda x: x["rank"])), F.lit(0)))
    reasons = F.when((F.size("__found") == 0) & (F.col("total_jobs") > 0), F.array(F.lit("No immediate monitoring issues detected."))).otherwise(F.transform("__found", lambda x: x["reason"]))
    names = F.array(*map(F.lit, HEALTH))
    return out.select(F.get(names, worst).alias("status"), reasons.alias("reasons"), *inputs.columns)


SEVERITY = ("bad", "warning", "info")


def attention_queue(inputs: DataFrame, top: int = 8) -> DataFrame:
    """What to look at first: one item a code, its worst, by severity, impact and title.

    inputs: one row with the columns that rules name; a rule whose columns are missing isn't asked. Rules of a code come worst first.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    n = lambda c: F.col(c).cast("long").cast("string")
    one = lambda c: F.round(c, 1).cast("string")
    pressure, p95 = F.coalesce("duration_pressure_ratio", F.lit(0.0)), F.coalesce("p95_duration_seconds", F.lit(0.0))
    bad_pressure = (pressure >= 10) & (p95 >= 60)
    warn_pressure = (pressure >= 5) & (p95 >= 30)
    says = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    # code, severity, title, page, condition, detail, impact, columns; codes, titles and texts are fixed values
    rules = [
        ("log_read_errors", "bad", "Review log read errors", "diagnostics", has("read_errors"), says(n("read_errors"), " read errors were found."), "read_errors", ["read_errors"]),
        *[
            (f"recent_failed_{kind}", severity, f"Review recent failed {kind}", page, has(f"failed_{kind}_last_{days}_days"), says(n(f"failed_{kind}_last_{days}_days"), f" {noun} failed in the last {days} days."), f"failed_{kind}_last_{days}_days", [f"failed_{kind}_last_{days}_days"])
            for kind, page, noun in (("jobs", "jobs", "jobs"), ("dataflows", "failures", "dataflow runs"))
            for severity, days in (("bad", 3), ("warning", 7))
        ],
        ("repeated_failure", "bad", "Repeated dataflow failure", "failures", F.col("error_count") >= 3, says(F.col("top_failing_dataflow"), " failed ", n("error_count"), " times."), "error_count", ["error_count", "top_failing_dataflow"]),
        ("no_log_evidence", "warning", "No log evidence", "overview", F.col("status") == "no_log_evidence", says("No monitoring logs were found in current filters."), None, ["status"]),
        ("stale_logs", "warning", "Check log freshness", "overview", F.col("latest_log_age_days") > 7, says("Latest log is ", n("latest_log_age_days"), " days old."), None, ["latest_log_age_days"]),
        *[
            ("maintenance_failed", severity, "Review failed maintenance", "maintenance", has(f"maintenance_failed_last_{days}_days"), says(n(f"maintenance_failed_last_{days}_days"), f" maintenance operations failed in the last {days} days."), None, [f"maintenance_failed_last_{days}_days"])
            for severity, days in (("bad", 7), ("warning", 14))
        ],
        ("maintenance_skipped", "warning", "Review skipped maintenance", "maintenance", has("maintenance_skipped_last_7_days"), says(n("maintenance_skipped_last_7_days"), " maintenance operations were skipped in the last 7 days."), None, ["maintenance_skipped_last_7_days"]),
        ("maintenance_coverage", "warning", "Review maintenance coverage", "maintenance", has("coverage_missing_tables"), says(n("coverage_missing_tables"), " active lakehouse tables have no maintenance evidence."), "coverage_missing_tables", ["coverage_missing_tables"]),
        ("maintenance_lag", "warning", "Review maintenance lag", "maintenance", has("lagged_tables"), says(n("lagged_tables"), " tables exceed the maintenance lag threshold."), "lagged_tables", ["lagged_tables"]),
        ("maintenance_active", "info", "Inspect active maintenance", "maintenance", has("latest_active_tables"), says(n("latest_active_tables"), " table maintenance targets are running or pending."), "latest_active_tables", ["latest_active_tables"]),
        ("stale_dataflows", "warning", "Review stale dataflows", "freshness", has("stale_candidates"), says(n("stale_candidates"), " stale dataflow candidates were detected."), None, ["stale_candidates"]),
        ("watermark_not_advanced", "warning", "Review unchanged watermarks", "freshness", has("watermark_unchanged_runs"), says(n("watermark_unchanged_runs"), " runs did not advance watermark values."), None, ["watermark_unchanged_runs"]),
        *[("performance_pressure", severity, "Review performance pressure", "performance", condition, says("P95 is ", one(pressure), "x P50 at ", seconds_text(p95), "."), "duration_pressure_ratio", ["duration_pressure_ratio", "p95_duration_seconds"]) for severity, condition in (("bad", bad_pressure), ("warning", warn_pressure))],
        ("optimization_candidates", "warning", "Review optimization candidates", "performance", has("optimization_candidate_count"), says(n("optimization_candidate_count"), " dataflow runs match performance optimization rules."), "optimization_candidate_count", ["optimization_candidate_count"]),
        ("slowest_stage", "info", "Inspect slowest stage", "performance", ~bad_pressure & ~warn_pressure & (F.col("slowest_stage_p95") >= 60), says(F.col("slowest_stage"), " has p95 duration ", seconds_text(F.col("slowest_stage_p95")), "."), None, ["slowest_stage", "slowest_stage_p95", "duration_pressure_ratio", "p95_duration_seconds"]),
        ("log_reconciliation", "warning", "Review log consistency", "diagnostics", has("mismatch_count"), says(n("mismatch_count"), " job totals differ from dataflow rollups."), None, ["mismatch_count"]),
        ("job_linkage_gaps", "bad", "Review job linkage gaps", "diagnostics", has("linkage_gaps"), says(n("linkage_gaps"), " job IDs are not linked across job and dataflow logs."), "linkage_gaps", ["linkage_gaps"]),
        ("log_cache_warnings", "warning", "Review log cache warnings", "diagnostics", has("cache_warning_count"), says(n("cache_warning_count"), " log sources have partial cache or read coverage."), "cache_warning_count", ["cache_warning_count"]),
        ("active_dataflows", "info", "Inspect active dataflows", "dataflows", has("active_dataflow_runs"), says(n("active_dataflow_runs"), " dataflow runs are running or pending in the current filters."), "active_dataflow_runs", ["active_dataflow_runs"]),
        ("runtime_context_health", "warning", "Review runtime context health", "jobs", F.col("context_name").isNotNull(), says(F.col("context_name"), " is at ", one(F.col("context_success_rate")), "% success."), "context_failed", ["context_name", "context_success_rate", "context_failed"]),
    ]
    asked = [r for r in rules if set(r[7]) <= set(inputs.columns)]
    items = [
        F.when(
            condition,
            F.struct(F.lit(SEVERITY.index(severity)).alias("rank"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), detail.alias("detail"), F.lit(page).alias("target"), (F.lit(0.0) if impact is None else F.coalesce(F.col(impact).cast("double"), F.lit(0.0))).alias("impact")),
        )
        for code, severity, title, page, condition, detail, impact, _ in asked
    ]
    open_ = inputs.select(F.inline(F.array_compact(F.array(*items))))
    worst = Window.partitionBy("code").orderBy("rank")
    kept = open_.withColumn("r", F.row_number().over(worst)).filter("r = 1")
    return kept.orderBy("rank", F.desc("impact"), "title").limit(top).select("code", "severity", "title", "detail", "target", "impact")


def seconds_text(seconds: Column) -> Column:
    """A duration with two digits, in seconds below a minute, else in minutes."""
    return F.when(seconds < 60, F.format_string("%.2fs", seconds)).otherwise(F.format_string("%.2fm", seconds / 60))


def worst_context(contexts: DataFrame) -> DataFrame:
    """The runtime context with failures and the lowest success rate below 95 %: of one row from runtime_contexts, none if all are fine."""
    poor = contexts.filter((F.col("failed") > 0) & (F.coalesce("success_rate", F.lit(0.0)) < 95))
    name = F.concat_ws(" / ", known("engine_name"), known("metadata_provider_name"))
    order = F.struct(F.coalesce("success_rate", F.lit(0.0)), -F.col("failed"), name, "platform_name")
    return poor.agg(F.min_by(name, order).alias("context_name"), F.min_by("success_rate", order).alias("context_success_rate"), F.min_by("failed", order).alias("context_failed"))
