"""Freshness and watermark movement of ETL dataflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket, filled, has_id, latest, latest_values, rate, status_is, with_percentiles
from ..functions.graph import settled

MARKS = [f"source_watermark_{k}" for k in ("before", "after", "effective")]
STALE_DAYS, STREAK = 7, 3


def broken_json(c: str, closed: bool = False) -> Column:
    """True for text that starts like JSON, or starts and ends like it, and isn't."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return text.rlike(r"^([{].*[}]|\[.*\])$" if closed else r"^[\[{]") & F.try_parse_json(text).isNull()


def watermark_states(df: DataFrame) -> DataFrame:
    """ETL runs with watermark_enabled, movement and adjustment. The status comes before the values; values compare as trimmed text."""
    before, after, effective = (filled(c) for c in MARKS)
    enabled = F.coalesce(before, after, effective, filled("source_watermark_columns")).isNotNull()
    movement = (
        F.when(~enabled, "not_configured")
        .when(broken_json(MARKS[0]) | broken_json(MARKS[1]) | broken_json(MARKS[2]), "invalid")
        .when(status_is("running", "pending"), "incomplete")
        .when(status_is("failed", "skipped"), "unchanged")
        .when(before.isNotNull() & after.isNotNull(), F.when(before != after, "advanced").otherwise("unchanged"))
        .when(before.isNull() & after.isNotNull(), "initialized")
        .otherwise("incomplete")
    )
    adjusted = F.when(before.isNotNull() & effective.isNotNull() & (before != effective), "adjusted").otherwise("not_adjusted")
    etl = df.filter(F.lower(F.coalesce("operation_type", F.lit("unknown"))) == "etl")
    return etl.withColumns({"watermark_enabled": enabled, "movement_state": movement, "adjustment_state": adjusted})


def skip_streaks(df: DataFrame) -> DataFrame:
    """Runs numbered from the newest, with the number of runs since then that weren't skipped."""
    newest = Window.partitionBy("dataflow_id").orderBy(F.desc_nulls_last("event_time"), F.desc("dataflow_run_id"))
    seen = F.sum(F.when(status_is("skipped"), 0).otherwise(1)).over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumns({"run_rank": F.row_number().over(newest), "others_seen": seen})


#: Attributes of a dataflow of which its registry shows the newest, by type.
ATTRIBUTES = [
    "workspace_id", "dataflow_name", "dataflow_description", "stage", "processing_mode", "configure", "operation_type", "source_name",
    "destination_name", "source_format", "destination_format", "source_connection_type", "destination_connection_type", "source_id", "source_catalog",
    "source_database", "source_schema", "source_table", "source_full_table", "source_path", "source_query", "source_python_function",
    "source_watermark_columns", "source_filter_expression", "source_configure", "source_action", "transform_deduplicate_columns",
    "transform_latest_data_columns", "transform_filter_expression", "transform_additional_columns", "transform_schema_hints",
    "transform_select_columns", "transform_drop_columns", "transform_rename_columns", "transform_value_rules", "transform_hash_columns",
    "transform_masking_rules", "transform_configure", "destination_id", "destination_catalog", "destination_database", "destination_schema",
    "destination_table", "destination_full_table", "destination_path", "destination_load_type", "destination_merge_keys",
    "destination_partition_columns", "destination_configure",
]
TYPED = {"group_number": "long", "execution_order": "long", "is_active": "boolean"}
#: What stands for a missing attribute: other attributes in order, then `unknown`.
DEFAULTS = {"stage": [], "source_name": [], "destination_name": [], "source_format": ["source_connection_type"], "destination_format": ["destination_connection_type"], "source_connection_type": [], "destination_connection_type": [], "destination_load_type": []}


def freshness_registry(df: DataFrame, as_of: str) -> DataFrame:
    """One row for each dataflow: newest attributes, statuses and watermark, age of the last success or skip, current streak of skips.

    Attributes that df lacks are null. Counts and times are hashed in one pass; the runs that hold newest values, the last five
    and those since the last run that wasn't skipped are few, and only they are sorted. Counts are a table with one row a dataflow, so
    runs needn't be shuffled to meet it.
    """
    rows = watermark_states(df).filter(has_id())
    fresh, on = status_is("succeeded", "skipped"), F.col("watermark_enabled")
    mark = F.coalesce(filled(MARKS[1]), filled(MARKS[2]), filled(MARKS[0]))
    have = set(rows.columns)
    texts = {c: F.nullif(c, F.lit("")) for c in ATTRIBUTES if c in have}
    wanted = texts | {c: F.col(c) for c in TYPED if c in have}
    wanted |= {"__run": F.struct("operation_type", "normalized_status", "source_watermark_columns", *MARKS)}
    wanted |= {"latest_freshness_status": F.when(fresh, F.col("normalized_status")), "latest_success_watermark": F.when(status_is("succeeded"), mark)}
    wanted |= {m: F.when(on, F.col(m)) for m in MARKS}
    time = F.coalesce(F.col("event_time").cast("timestamp"), F.to_timestamp(F.lit("0001-01-01")))
    rows = rows.withColumn("__at", time)
    base = settled(rows.groupBy("dataflow_id").agg(
        F.max("event_time").alias("latest_run_at"),
        F.max(F.when(fresh, F.col("event_time"))).alias("latest_freshness_at"),
        F.max(F.when(on, F.col("event_time"))).alias("watermark_time"),
        F.max(F.when(~status_is("skipped"), F.col("__at"))).alias("__kept"),
        F.bool_or("watermark_enabled").alias("watermark_enabled"),
        F.count(F.lit(1)).alias("run_count"),
        *[F.count_if(status_is(s)).alias(f"{s}_count") for s in ("succeeded", "failed", "skipped", "running", "pending")],
    ))
    newest = latest_values(rows, "dataflow_id", wanted)
    # every run has a movement, so the newest one is that of the newest run, and only that is parsed
    moved = watermark_states(newest.select("dataflow_id", "__run.*")).select("dataflow_id", F.col("normalized_status").alias("latest_status"), "movement_state", "adjustment_state")
    newest = newest.drop("__run").join(moved, "dataflow_id", "left")
    order = Window.partitionBy("dataflow_id").orderBy(F.desc("__at"), F.desc("dataflow_run_id"))
    five = rows.select("dataflow_id", "__at", "dataflow_run_id", "event_time", "normalized_status", "error_message").withColumn("r", F.row_number().over(order)).filter("r <= 5")
    listed = F.array_sort(F.collect_list(F.struct("r", "normalized_status", "event_time", "dataflow_run_id")))
    last = five.groupBy("dataflow_id").agg(F.transform(listed, lambda x: F.struct(x["normalized_status"].alias("status"), x["event_time"].alias("time"), x["dataflow_run_id"].alias("dataflow_run_id"))).alias("last_statuses"), F.max(F.when(F.col("r") == 1, F.col("error_message"))).alias("latest_error_message"))
    since = rows.select("dataflow_id", "__at", "event_time", "dataflow_run_id", "normalized_status").join(base.select("dataflow_id", "__kept"), "dataflow_id").filter("__kept is null or __at >= __kept")
    streak = skip_streaks(since).groupBy("dataflow_id").agg(F.count_if(status_is("skipped") & (F.col("others_seen") == 0)).alias("skipped_streak"))
    out = base.drop("__kept").join(newest, "dataflow_id", "left").join(last, "dataflow_id").join(streak, "dataflow_id")
    missing = {c: F.lit(None).cast("string") for c in ATTRIBUTES if c not in have} | {c: F.lit(None).cast(t) for c, t in TYPED.items() if c not in have}
    out = out.withColumns(missing)
    out = out.withColumns({c: F.coalesce(c, *others, F.lit("unknown")) for c, others in DEFAULTS.items()} | {"dataflow_name": F.coalesce("dataflow_name", "dataflow_id"), "coverage_state": F.when(on, "configured").otherwise("not_configured")})
    age = F.greatest(F.lit(0), F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(F.col("latest_freshness_at").cast("timestamp")))
    out = out.withColumn("age_seconds", F.when(F.col("latest_freshness_at").isNotNull(), age))
    out = out.withColumn("age_days", F.round(F.col("age_seconds") / 86400, 6))
    return out.withColumn("is_stale", F.coalesce((F.col("age_days") > STALE_DAYS).cast("int"), F.lit(0)))


def age_by_dataflow(registry: DataFrame, top: int = 200) -> DataFrame:
    target = F.concat_ws(" -> ", "source_name", "destination_name")
    return registry.filter("age_days is not null").orderBy(F.desc("age_days"), "dataflow_name", "dataflow_id").limit(top).select("dataflow_id", "dataflow_name", target.alias("target"), "latest_freshness_at", "latest_freshness_status", "age_seconds", "age_days")


MOVES = ("advanced", "initialized", "unchanged", "incomplete", "invalid")


def freshness_summary(df: DataFrame, jf: DataFrame, as_of: str) -> DataFrame:
    """One row: records and dates of both logs, runs by status and movement, and the registry's coverage, staleness and ages."""
    registry, runs = freshness_registry(df, as_of), watermark_states(df)
    n, moved = F.count(F.lit(1)), F.col("movement_state")
    named = lambda c: F.countDistinct(F.nullif(c, F.lit("unknown")))
    logs = df.agg(n.alias("dataflow_records"), F.min("run_date").alias("date_min"), F.max("run_date").alias("date_max"), F.max("event_time").alias("latest_dataflow_log_at"), named("engine_name").alias("active_engines"), named("metadata_provider_name").alias("active_metadata_providers"))
    jobs = jf.agg(n.alias("job_records"), F.max("event_time").alias("latest_job_log_at"))
    counts = {"successful_runs": ("succeeded",), "freshness_runs": ("succeeded", "skipped"), "failed_runs": ("failed",), "skipped_runs": ("skipped",)}
    a = runs.agg(
        *[F.count_if(status_is(*s)).alias(k) for k, s in counts.items()],
        F.count_if(~F.coalesce(has_id(), F.lit(False))).alias("missing_dataflow_id_runs"),
        *[F.count_if(moved == m).alias(f"watermark_{m}_runs") for m in MOVES],
        F.count_if(F.col("adjustment_state") == "adjusted").alias("watermark_adjusted_runs"),
        rate(F.count_if(moved == "advanced"), F.count_if(moved.isin("advanced", "unchanged"))).alias("watermark_advanced_rate"),
    )
    b = registry.agg(
        n.alias("observed_dataflows"),
        F.count("latest_freshness_at").alias("dataflows_with_freshness_evidence"),
        F.count_if(~F.col("latest_status").isin("succeeded", "skipped")).alias("latest_status_issue_dataflows"),
        F.count_if(moved == "invalid").alias("latest_watermark_invalid_dataflows"),
        F.count_if(moved == "incomplete").alias("latest_watermark_incomplete_dataflows"),
        F.count_if("watermark_enabled").alias("watermark_enabled_dataflows"),
        rate(F.count_if("watermark_enabled"), n).alias("watermark_coverage_rate"),
        F.count_if(F.col("skipped_streak") >= STREAK).alias("skipped_streak_dataflows"),
        F.coalesce(F.sum("is_stale"), F.lit(0)).alias("stale_dataflows"),
        rate(F.sum("is_stale"), n).alias("stale_dataflow_rate"),
        *[F.coalesce(f(c).cast("double"), F.lit(0.0)).alias(f"{k}_{c}") for c in ("age_days", "age_seconds") for k, f in (("min", F.min), ("max", F.max))],
    )
    ages = {f"{k}_{c}": (F.col(c), p) for c in ("age_days", "age_seconds") for k, p in (("p50", 0.5), ("p95", 0.95))}
    out = with_percentiles(b, registry, [], ages).join(a).join(logs).join(jobs)
    return out.withColumns({"latest_log_at": F.greatest("latest_dataflow_log_at", "latest_job_log_at"), "latest_watermark_issue_dataflows": F.col("latest_watermark_invalid_dataflows") + F.col("latest_watermark_incomplete_dataflows")})


def watermark_trend(df: DataFrame, grain: str = "day", tz: str = "UTC") -> DataFrame:
    runs = watermark_states(df).filter("watermark_enabled and event_time is not null")
    return runs.groupBy(bucket("event_time", grain, tz).alias("bucket_start")).agg(*[F.count_if(F.col("movement_state") == m).alias(m) for m in ("advanced", "initialized", "unchanged", "incomplete", "invalid")], F.count_if(F.col("adjustment_state") == "adjusted").alias("adjusted"), F.count(F.lit(1)).alias("runs"), rate(F.count_if(F.col("movement_state") == "advanced"), F.count_if(F.col("movement_state").isin("advanced", "unchanged"))).alias("advanced_rate"))


def age_distribution(registry: DataFrame) -> DataFrame:
    d = F.col("age_days")
    name = F.when(d.isNull(), "Unknown").when(d <= 1, "<=1d").when(d <= 3, "1-3d").when(d <= 7, "3-7d").when(d <= 30, "7-30d").otherwise(">30d")
    return registry.groupBy(name.alias("bucket")).agg(F.count(F.lit(1)).alias("dataflows"))


def coverage_by_stage(df: DataFrame) -> DataFrame:
    rows = watermark_states(df).filter("dataflow_id is not null")
    on = F.countDistinct(F.when(F.col("watermark_enabled"), F.col("dataflow_id")))
    return rows.groupBy(F.coalesce(F.nullif("stage", F.lit("")), F.lit("unknown")).alias("stage")).agg(F.countDistinct("dataflow_id").alias("dataflows"), on.alias("watermark_enabled"), rate(on, F.countDistinct("dataflow_id")).alias("coverage_rate"))


def streak_distribution(registry: DataFrame) -> DataFrame:
    s = F.col("skipped_streak")
    return registry.filter("skipped_streak > 0").groupBy(F.when(s == 1, "1").when(s <= 3, "2-3").when(s <= 7, "4-7").otherwise(">7").alias("bucket")).agg(F.count(F.lit(1)).alias("dataflows"))


def movement_evidence(df: DataFrame, top: int = 100) -> DataFrame:
    rows = watermark_states(df).filter("watermark_enabled and dataflow_id is not null")
    return rows.orderBy(F.desc_nulls_last("event_time"), "dataflow_run_id").limit(top).select("dataflow_run_id", "dataflow_id", "event_time", "movement_state", "adjustment_state", "normalized_status", *MARKS)


def evidence_page(registry: DataFrame, sort_by: str = "age_days", descending: bool = True, limit: int = 25, offset: int = 0) -> DataFrame:
    if sort_by not in ("age_days", "dataflow_id", "run_count", "skipped_streak", "latest_run_at"):
        raise ValueError(f"can't sort by {sort_by}")
    return registry.orderBy(F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by), "dataflow_id").limit(limit + offset).offset(offset).select("dataflow_id", "latest_status", "movement_state", "age_days", "run_count", "skipped_streak")


def skipped_patterns(registry: DataFrame, top: int = 50) -> DataFrame:
    return registry.filter(F.col("skipped_streak") >= STREAK).orderBy(F.desc("skipped_streak"), "dataflow_id").limit(top).select("dataflow_id", "skipped_streak", "latest_run_at")


def stale_candidates(registry: DataFrame, top: int = 50) -> DataFrame:
    return registry.filter("is_stale = 1").orderBy(F.desc("age_days"), "dataflow_id").limit(top).select("dataflow_id", "age_days", "latest_status")


def watermark_summary(df: DataFrame, top: int = 18) -> DataFrame:
    """Movements of each dataflow's watermark, most runs first."""
    rows = watermark_states(df).filter(has_id() & F.col("watermark_enabled"))
    out = rows.groupBy("dataflow_id").agg(F.count(F.lit(1)).alias("runs"), *[F.count_if(F.col("movement_state") == m).alias(m) for m in ("advanced", "unchanged", "initialized", "invalid", "incomplete")], latest("movement_state").alias("latest_movement"))
    return out.orderBy(F.desc("runs"), "dataflow_id").limit(top)
