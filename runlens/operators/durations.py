"""Phases, duration distributions, outliers and endpoint or dataflow health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import PHASES, compact_text, derived_overhead, dominant, endpoint_display, filled, has_id, latest, mean, rate, status_counts, status_is, success_rate, total, with_percentiles
from ..functions.failure_rules import failure_category, normalize_message
from .failures import failed_phase, failure_message, phase_failed
from .freshness import MARKS, broken_json
from .jobs import latest_jobs


def phase_rows(df: DataFrame, group_by: str) -> DataFrame:
    ran = df.filter(status_is("succeeded", "failed", "skipped"))
    fallback = F.when(status_is("failed") & ~phase_failed("source") & ~phase_failed("transform") & ~phase_failed("destination"), "failed")
    parts = [(p, F.col(f"{p}_duration_seconds"), F.lower(filled(f"{p}_status"))) for p in PHASES[:3]] + [("overhead", derived_overhead(), fallback)]
    rows = F.array(*[F.struct(F.lit(p).alias("phase"), d.cast("double").alias("duration"), s.alias("normalized_status")) for p, d, s in parts])
    return ran.select(F.coalesce(F.nullif(group_by, F.lit("")), F.lit("unknown")).alias("group_value"), F.inline(rows))


def phase_summary(df: DataFrame, group_by: str = "stage") -> DataFrame:
    """Each group's phases and the grand total's: time, mean, p95, share of the group's time and statuses.

    Rows are expanded to their group and to the total before grouping, as grouping sets do, so that percentiles see both.
    """
    rows = phase_rows(df, group_by)
    sets = rows.select(F.inline(F.array(F.struct(F.col("group_value").alias("group_value"), F.lit(0).alias("is_total")), F.struct(F.lit("Total").alias("group_value"), F.lit(1).alias("is_total")))), "phase", "duration", "normalized_status")
    keys = ["group_value", "is_total", "phase"]
    base = sets.groupBy(*keys).agg(F.round(total("duration"), 3).alias("duration_seconds"), F.count("duration").alias("run_count"), mean("duration").alias("avg_duration_seconds"), *status_counts())
    out = with_percentiles(base, sets, keys, {"p95_duration_seconds": (F.col("duration"), 0.95)})
    return out.withColumn("share_percent", rate(F.col("duration_seconds"), F.sum("duration_seconds").over(Window.partitionBy("group_value", "is_total"))))


def _ran(df: DataFrame, group: Column) -> DataFrame:
    return df.filter(status_is("succeeded", "failed") & F.col("duration_seconds").isNotNull()).withColumn("group_value", group)


QUARTILES = {"q1": 0.25, "p50": 0.5, "q3": 0.75, "p95": 0.95}


def duration_distribution(df: DataFrame, group: Column, top: int = 40) -> DataFrame:
    """Box plot of each group: quartiles, whiskers within 1.5 interquartile ranges, extremes, mean and outliers."""
    runs = _ran(df, group)
    base = runs.groupBy("group_value").agg(F.count(F.lit(1)).alias("count"), F.round(F.min("duration_seconds"), 3).alias("min_duration"), F.round(F.max("duration_seconds"), 3).alias("max_duration"), F.round(F.avg("duration_seconds"), 3).alias("avg_duration"), F.count_if(status_is("succeeded")).alias("succeeded"), F.count_if(status_is("failed")).alias("failed"), success_rate().alias("success_rate"))
    boxes = with_percentiles(base, runs, ["group_value"], {k: (F.col("duration_seconds"), p) for k, p in QUARTILES.items()})
    boxes = boxes.withColumns({"low": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "high": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    inside = F.when(F.col("duration_seconds").between(F.col("low"), F.col("high")), F.col("duration_seconds"))
    fences = runs.join(boxes.select("group_value", "low", "high"), "group_value").groupBy("group_value").agg(F.round(F.min(inside), 3).alias("whisker_min"), F.round(F.max(inside), 3).alias("whisker_max"), F.count_if(inside.isNull()).alias("outlier_count"))
    return boxes.join(fences, "group_value").drop("low", "high").orderBy(F.desc("p95"), F.desc("count"), "group_value").limit(top)


def duration_outliers(df: DataFrame, group: Column, top_groups: int = 40, top: int = 40) -> DataFrame:
    """The longest outliers of the groups that the distribution shows."""
    boxes = duration_distribution(df, group, top_groups).select("group_value", "q1", "q3")
    runs = _ran(df, group).join(F.broadcast(boxes), "group_value")  # at most top_groups rows
    wide = 1.5 * (F.col("q3") - F.col("q1"))
    out = runs.filter((F.col("duration_seconds") < F.col("q1") - wide) | (F.col("duration_seconds") > F.col("q3") + wide))
    rank = Window.partitionBy("group_value").orderBy(F.desc("duration_seconds"), "dataflow_run_id")
    out = out.withColumn("outlier_rank", F.row_number().over(rank)).filter(F.col("outlier_rank") <= top)
    return out.select("group_value", "outlier_rank", "duration_seconds", "dataflow_run_id", "dataflow_name", "normalized_status", "operation_type", "engine_name")


def operation_mix(df: DataFrame, group: Column) -> DataFrame:
    """`type: n, type: n` of each group, in alphabetical order."""
    kind = F.coalesce(F.nullif("operation_type", F.lit("")), F.lit("unknown"))
    counts = _ran(df, group).groupBy("group_value", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("group_value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["kind"], F.lit(": "), x["n"].cast("string"))), ", ").alias("operation_mix"))


def endpoint_health(df: DataFrame, top: int = 18) -> DataFrame:
    ends = ["source_name", "destination_name"]
    named = df.withColumns({c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")) for c in ends})
    base = named.groupBy(*ends).agg(*[F.coalesce(dominant(c), F.lit("unknown")).alias(c) for c in ("source_format", "destination_format", "destination_connection_type")], F.count(F.lit(1)).alias("runs"), *status_counts(False), success_rate().alias("success_rate"), mean("duration_seconds").alias("avg_duration"), total("source_rows_read").alias("rows_read"), total("destination_bytes_added").alias("bytes_added"))
    out = with_percentiles(base, named, ends, {"p95_duration": (F.col("duration_seconds"), 0.95)})
    return out.orderBy(F.desc("failed"), F.desc("p95_duration"), F.desc("runs"), *ends).limit(top)


def dataflow_health(df: DataFrame, top: int = 40) -> DataFrame:
    named = df.filter(has_id())
    base = named.groupBy("dataflow_id").agg(F.coalesce(latest(F.nullif("dataflow_name", F.lit(""))), F.first("dataflow_id")).alias("dataflow_name"), F.coalesce(latest(F.nullif("stage", F.lit(""))), F.lit("unknown")).alias("stage"), F.coalesce(dominant(F.nullif("operation_type", F.lit(""))), F.lit("unknown")).alias("operation_type"), F.count(F.lit(1)).alias("runs"), *status_counts(), success_rate().alias("success_rate"), mean("duration_seconds").alias("avg_duration"), F.coalesce(F.max("duration_seconds"), F.lit(0.0)).alias("max_duration"), total("source_rows_read").alias("rows_read"), F.max("event_time").alias("latest_time"))
    out = with_percentiles(base, named, ["dataflow_id"], {"p95_duration": (F.col("duration_seconds"), 0.95)})
    return out.orderBy(F.desc("runs"), F.desc("failed"), F.desc(F.col("running") + F.col("pending")), F.desc("p95_duration"), "dataflow_name", "dataflow_id").limit(top)


def run_phase_health() -> Column:
    """`<phase>_failed`, else `<slowest phase>_bottleneck`, else ok, or unknown for a run of unknown status."""
    spent = {p: F.greatest(F.lit(0.0), F.coalesce(F.col(f"{p}_duration_seconds"), F.lit(0.0))) for p in PHASES[:3]}
    spent["overhead"] = F.greatest(F.lit(0.0), F.coalesce(derived_overhead(), F.lit(0.0)))
    slow = F.array_max(F.array(*[F.struct(d.alias("d"), F.lit(-i).alias("i"), F.lit(p).alias("p")) for i, (p, d) in enumerate(spent.items())]))
    broken = F.when(status_is("failed"), F.concat(failed_phase(), F.lit("_failed")))
    slowest = F.when(slow["d"] > 0, F.concat(slow["p"], F.lit("_bottleneck")))
    return F.coalesce(broken, slowest, F.when(status_is("unknown"), "unknown").otherwise("ok"))


def phase_health(df: DataFrame) -> DataFrame:
    """Runs by run_phase_health."""
    return df.groupBy(run_phase_health().alias("phase_health")).agg(F.count(F.lit(1)).alias("runs"))


ENDPOINT_PARTS = ("full_table", "catalog", "database", "schema", "table", "path", "python_function", "query", "name")


def enrich_dataflow_runs(df: DataFrame, jf: DataFrame) -> DataFrame:
    """Runs as an investigation shows them: displays of both ends, phase health, error phase and preview, watermark states, failure fields, and the job's status and duration.

    Columns of endpoints that df lacks count as empty. A run without watermark columns has not_configured states, one with broken JSON invalid ones.
    """
    lacking = {f"{side}_{p}": F.lit(None).cast("string") for side in ("source", "destination") for p in ENDPOINT_PARTS if f"{side}_{p}" not in df.columns}
    runs = df.withColumns(lacking)
    before, after, effective = (filled(c) for c in MARKS)
    configured = F.coalesce(before, after, effective, filled("source_watermark_columns")).isNotNull()
    invalid = configured & F.greatest(*[broken_json(c, closed=True) for c in MARKS])
    moved = F.when(~configured, "not_configured").when(invalid, "invalid").when(status_is("running", "pending"), "incomplete").when(status_is("failed", "skipped"), "unchanged").when(after.isNull(), "incomplete").when(before.isNull(), "initialized").when(before == after, "unchanged").otherwise("advanced")
    adjusted = F.when(~configured, "not_configured").when(invalid, "invalid").when(before.isNull(), "unknown").when(effective != before, "adjusted").otherwise("not_adjusted")
    covered = F.when(~configured, "not_configured").when(invalid, "invalid").otherwise("configured")
    first = [F.when(filled(f"{p}_error_message").isNotNull(), p) for p in PHASES[:3]]
    phase = F.when(status_is("failed"), failed_phase()).otherwise(F.coalesce(*first, F.when(filled("error_message").isNotNull(), "job"), F.lit("")))
    said = F.coalesce(filled("error_message"), *[filled(f"{p}_error_message") for p in PHASES[:3]], F.lit(""))
    message = failure_message()
    category = failure_category(message)
    only_failed = lambda c: F.when(status_is("failed"), c)
    signature = F.concat_ws("|", category, failed_phase(), F.coalesce(F.nullif(normalize_message(message), F.lit("")), F.lit("unknown")))
    out = runs.withColumns(
        {
            "source_display": endpoint_display("source"),
            "destination_display": endpoint_display("destination"),
            "phase_health": run_phase_health(),
            "error_phase": phase,
            "error_preview": compact_text(said, 140),
            "coverage_state": covered,
            "movement_state": moved,
            "adjustment_state": adjusted,
            "failure_phase": only_failed(failed_phase()),
            "failure_message": only_failed(message),
            "failure_category": only_failed(category),
            "failure_signature": only_failed(signature),
        }
    )
    jobs = latest_jobs(jf).filter("job_id is not null").select("_source_id", "job_id", F.col("normalized_status").alias("__status"), F.col("duration_seconds").alias("linked_job_duration_seconds"))
    out = out.join(jobs, ["_source_id", "job_id"], "left").withColumn("linked_job_status", F.coalesce("__status", F.lit("unknown")))
    return out.drop("__status", *lacking)


def status_by(df: DataFrame, column: str) -> DataFrame:
    """Status counts by stage, operation type and the like."""
    return df.groupBy(F.coalesce(F.nullif(column, F.lit("")), F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("runs"), *status_counts())


def engine_stage_matrix(df: DataFrame) -> DataFrame:
    base = df.groupBy("engine_name", F.coalesce(F.nullif("stage", F.lit("")), F.lit("unknown")).alias("stage"))
    return base.agg(F.count(F.lit(1)).alias("runs"), F.count_if(status_is("failed")).alias("failed"), mean("duration_seconds").alias("avg_duration"))


def slowest_by(df: DataFrame, column: str, top: int) -> DataFrame:
    """p95 and mean duration of executable runs by a column."""
    runs = _ran(df, F.coalesce(F.nullif(column, F.lit("")), F.lit("unknown")))
    base = runs.groupBy("group_value").agg(F.count(F.lit(1)).alias("runs"), mean("duration_seconds").alias("avg_duration"))
    return with_percentiles(base, runs, ["group_value"], {"p95": (F.col("duration_seconds"), 0.95)}).orderBy(F.desc("p95"), F.desc("runs"), "group_value").limit(top)
