"""Table maintenance: coverage, lag, reclaimed space and upstream writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import STATUSES, bucket, is_maintenance, lakehouse, latest_values, maintenance_target, nearest_percentiles, rate, status_counts, status_is, total, zero
from .performance import record_counts

LAG_DAYS = 7


def classify(df: DataFrame) -> DataFrame:
    """Runs with their target, whether they maintain it or write to a lakehouse table, and whether maintenance changed nothing."""
    wrote = F.greatest(*[zero(f"destination_{c}").cast("double") for c in ("files_added", "bytes_added", "rows_written", "rows_inserted", "rows_updated", "rows_deleted")]) > 0
    idle = status_is("succeeded") & (zero("destination_bytes_removed") == 0) & (zero("destination_files_removed") == 0)
    return df.withColumns({"target": maintenance_target(), "is_maintenance": is_maintenance(), "is_active": (F.lower(F.coalesce("operation_type", F.lit(""))) == "etl") & lakehouse() & wrote, "is_no_op": idle})


#: What a registry row tells of the table from its newest run that has it.
NEWEST = ["destination_table", "destination_full_table", "destination_path", "destination_name", "destination_connection_type"]


def _ladder(name: str, steps: list[tuple], last: object) -> Column:
    """The value of the first step that holds."""
    out = F.when(steps[0][0], steps[0][1][name])
    for condition, values in steps[1:]:
        out = out.when(condition, values[name])
    return out.otherwise(last)


def registry(df: DataFrame) -> DataFrame:
    """One row for each target: endpoint, maintenance counts, newest status and times, reclaimed space and its rate, lag, health, reason, priority and writers.

    latest_status is `missing` for a table without maintenance. upstream_dataflows is an array of `upstream_dataflows`' rows by name and id, empty without writers.
    """
    own, idle = F.col("is_maintenance"), F.col("is_maintenance") & F.col("is_no_op")
    when = lambda c: F.when(own, F.col(c))
    rows = classify(df).filter("is_maintenance or is_active")
    out = rows.groupBy("target").agg(
        F.bool_or("is_active").alias("active_lakehouse_table"),
        F.bool_or("is_maintenance").alias("maintained_table"),
        F.count_if(own).alias("run_count"),
        *[F.count_if(own & status_is(s)).alias(s) for s in STATUSES],
        F.count_if(own & ~status_is(*STATUSES)).alias("unknown"),
        F.max(when("event_time")).alias("latest_maintenance_time"),
        F.max(F.when(F.col("is_active"), F.col("event_time"))).alias("latest_etl_write_time"),
        *[total(when(c)).alias(n) for n, c in (("files_removed", "destination_files_removed"), ("bytes_reclaimed", "destination_bytes_removed"), ("bytes_saved", "destination_bytes_saved"))],
        F.coalesce(F.sum(when("duration_seconds")), F.lit(0.0)).alias("duration_seconds"),
        F.count_if(idle).alias("no_op_runs"),
        F.coalesce(F.sum(F.when(idle, F.col("duration_seconds"))), F.lit(0.0)).alias("no_op_duration_seconds"),
        F.count_if("is_active").alias("upstream_run_count"),
    )
    newest = latest_values(rows, "target", {"latest_status": when("normalized_status"), "destination_format": F.nullif("destination_format", F.lit("")), **{c: F.col(c) for c in NEWEST}})
    out = out.join(newest, "target", "left").fillna("unknown", ["destination_format"])
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    lag = F.greatest(F.lit(0), F.coalesce(seconds("latest_etl_write_time") - seconds("latest_maintenance_time"), F.lit(0)))
    status, late = F.coalesce("latest_status", F.lit("")), F.col("maintenance_lag_seconds") > LAG_DAYS * 86400
    step = lambda health, reason, priority: {"table_health": health, "attention_reason": reason, "attention_priority": priority}
    ladder = [
        (~F.col("maintained_table") & F.col("active_lakehouse_table"), step("warning", "Missing maintenance coverage", 80)),
        (status == "failed", step("has_issues", "Latest maintenance failed", 100)),
        (status.isin("running", "pending"), step("warning", F.concat(F.lit("Latest maintenance is "), status), 90)),
        (status == "skipped", step("warning", "Latest maintenance skipped", 70)),
        (late, step("warning", f"Maintenance lag exceeds {LAG_DAYS} days", 60)),
        (F.col("maintained_table"), step("healthy", "Maintained table", 0)),
    ]
    none = step("no_evidence", "No maintenance evidence", 10)
    out = out.withColumn("maintenance_lag_seconds", lag).withColumns({name: _ladder(name, ladder, last) for name, last in none.items()})
    per_second = F.coalesce(F.round(F.try_divide("bytes_reclaimed", "duration_seconds"), 3), F.lit(0.0))
    display = F.when(F.col("target").contains("::"), F.split_part("target", F.lit("::"), F.lit(2))).otherwise(F.col("target"))
    missing = F.coalesce("latest_status", F.lit("missing"))
    out = out.withColumns({
        "target_display": display, "table": F.col("target"), "destination_connection_name": F.col("destination_name"), "format": F.col("destination_format"), "latest_status": missing, "status": missing,
        "maintenance_lag_warning": late, "maintenance_lag_warning_days": F.lit(LAG_DAYS), "bytes_removed": F.col("bytes_reclaimed"), "bytes_reclaimed_per_second": per_second,
    })
    writers = upstream_dataflows(df)
    each = F.struct(*[c for c in writers.columns if c != "target"])
    by_name = writers.groupBy("target").agg(F.sort_array(F.collect_list(F.struct(F.col("dataflow_name").alias("a"), F.col("dataflow_id").alias("b"), each.alias("it")))).alias("u"))
    return out.join(by_name.select("target", F.transform("u", lambda x: x["it"]).alias("upstream_dataflows")), "target", "left").withColumn("upstream_dataflows", F.coalesce("upstream_dataflows", F.array()))


def upstream_dataflows(df: DataFrame) -> DataFrame:
    """(target, dataflow_id) for each dataflow that writes a target: newest name, stage, operations, source and load type, newest status and time, runs and rows read."""
    rows = classify(df).filter("is_active").withColumn("flow", F.struct("target", "dataflow_id"))
    own = ("dataflow_name", "stage", "operation_type", "destination_operation_type", "source_name", "source_full_table", "source_table", "source_path")
    newest = latest_values(rows, "flow", {**{c: F.col(c) for c in own}, "load_type": F.col("destination_load_type"), "latest_status": F.col("normalized_status")}, 4)
    base = rows.groupBy("flow").agg(F.max("event_time").alias("latest_time"), F.count(F.lit(1)).alias("run_count"), total("source_rows_read").alias("rows_read"))
    known_or = lambda *c: F.coalesce(*c, F.lit("unknown"))
    out = base.join(newest, "flow", "left").withColumns({"target": F.col("flow.target"), "dataflow_id": F.col("flow.dataflow_id")})
    named = {"dataflow_name": known_or("dataflow_name", "dataflow_id"), "stage": known_or("stage"), "operation_type": known_or("operation_type"), "source_name": known_or("source_name"), "load_type": F.coalesce("load_type", "destination_operation_type", F.lit("-")), "latest_status": known_or("latest_status")}
    return out.withColumns(named).select("target", "dataflow_id", *own, "load_type", "latest_status", "latest_time", "run_count", "rows_read")


def summary(df: DataFrame, jf: DataFrame) -> DataFrame:
    """One row: records, dates and newest times of both logs, maintenance runs and what they did, and tables by coverage, health, lag and newest status."""
    runs = classify(df).filter("is_maintenance")
    limit = nearest_percentiles(runs, [], {"p95": (F.when(F.col("duration_seconds") > 0, F.col("duration_seconds")), 0.95)})
    slow = runs.join(F.broadcast(limit)).agg(F.count_if((F.col("p95") > 0) & (F.col("duration_seconds") >= F.col("p95"))).alias("high_duration_runs"))
    seconds = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    a = runs.agg(
        F.count(F.lit(1)).alias("total_maintenance_runs"),
        *[F.count_if(status_is(s)).alias(f"{s}_ops") for s in STATUSES],
        total("destination_files_removed").alias("files_removed"), total("destination_bytes_removed").alias("bytes_reclaimed"), total("destination_bytes_saved").alias("bytes_saved"),
        seconds("duration_seconds").alias("duration_seconds"), seconds(F.when(status_is("succeeded"), F.col("duration_seconds"))).alias("succeeded_duration_seconds"), F.count_if("is_no_op").alias("no_op_runs"),
    )
    active, kept = F.col("active_lakehouse_table"), F.col("maintained_table")
    newest = lambda *s: F.count_if(F.col("latest_status").isin(*s))
    b = registry(df).agg(
        F.count_if(F.col("no_op_runs") > 0).alias("no_op_tables"), seconds("no_op_duration_seconds").alias("no_op_duration_seconds"),
        F.count_if((F.col("bytes_reclaimed") > 0) | (F.col("files_removed") > 0)).alias("tables_with_reclaim"),
        F.count_if(F.col("table_health") == "has_issues").alias("tables_with_issues"), F.count_if(F.col("table_health") == "warning").alias("tables_with_warnings"),
        newest("failed").alias("latest_failed_tables"), newest("skipped").alias("latest_skipped_tables"), newest("running", "pending").alias("latest_active_tables"),
        F.count_if("maintenance_lag_warning").alias("lagged_tables"), F.count_if(active).alias("active_lakehouse_tables"), F.count_if(active & kept).alias("maintained_tables"),
        F.count_if(active & ~kept).alias("coverage_missing_tables"), rate(F.count_if(active & kept), F.count_if(active)).alias("coverage_rate"),
    )
    return a.join(b).join(slow).join(record_counts(df, jf))


def status_trend(df: DataFrame, grain: str = "day", tz: str = "UTC") -> DataFrame:
    return classify(df).filter("is_maintenance and event_time is not null").groupBy(bucket("event_time", grain, tz).alias("bucket_start")).agg(F.count(F.lit(1)).alias("runs"), *status_counts())


def reclaim_trend(df: DataFrame, grain: str = "day", tz: str = "UTC") -> DataFrame:
    return classify(df).filter("is_maintenance and event_time is not null").groupBy(bucket("event_time", grain, tz).alias("bucket_start")).agg(total("destination_files_removed").alias("files_removed"), total("destination_bytes_removed").alias("bytes_reclaimed"), total("destination_bytes_saved").alias("bytes_saved"))


def by_format(df: DataFrame) -> DataFrame:
    return classify(df).filter("is_maintenance").groupBy(F.coalesce(F.nullif("destination_format", F.lit("")), F.lit("unknown")).alias("format")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(status_is("failed")).alias("failed"), total("destination_files_removed").alias("files_removed"), total("destination_bytes_removed").alias("bytes_reclaimed"))


def evidence_page(df: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """A page of the registry: most urgent first, then by reclaimed space, files and newest time."""
    newest = F.coalesce("latest_maintenance_time", "latest_etl_write_time")
    return registry(df).orderBy(F.desc("attention_priority"), F.desc("bytes_reclaimed"), F.desc("files_removed"), newest.desc_nulls_last(), "target").limit(limit + offset).offset(offset)
