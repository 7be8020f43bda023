"""Failure metrics: causal phase, message, category, signature and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import PHASES, dominant, filled, latest, rate, status_is, total
from ..functions.failure_rules import failure_category, failure_rule_id, failure_tags, normalize_message
from .performance import record_counts


def phase_failed(phase: str) -> Column:
    return F.coalesce(F.lower(filled(f"{phase}_status")), F.lit("")) == "failed"


def failed_phase() -> Column:
    """First failed phase in order of execution, else overhead, of a failed run; messages never decide it."""
    out = F.when(~status_is("failed"), "unknown")
    for p in PHASES[:3]:
        out = out.when(phase_failed(p), p)
    return out.otherwise("overhead")


def failure_message() -> Column:
    """Message of the failed phase, else of the run; empty without one."""
    root, out = filled("error_message"), F.when(~status_is("failed"), "")
    for p in PHASES[:3]:
        out = out.when(phase_failed(p), F.coalesce(filled(f"{p}_error_message"), root, F.lit("")))
    return out.otherwise(F.coalesce(root, F.lit("")))


def all_messages() -> Column:
    return F.concat_ws("\n", *[filled(f"{p}_error_message") for p in PHASES[:3]], filled("error_message"))


def failed_runs(df: DataFrame) -> DataFrame:
    """Failed dataflow runs with phase, message, category, signature and target. Persist it before several roll-ups."""
    out = df.filter(status_is("failed")).withColumns({"failure_phase": failed_phase(), "failure_message": failure_message()})
    out = out.withColumn("failure_category", failure_category(F.col("failure_message")))
    signature = F.concat_ws("|", "failure_category", "failure_phase", F.coalesce(F.nullif(normalize_message(F.col("failure_message")), F.lit("")), F.lit("unknown")))
    target = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("destination_full_table", "destination_table", "destination_name", "source_name", "dataflow_name", "dataflow_id")], F.lit("unknown"))
    return out.withColumns({"failure_signature": signature, "failure_target": target})


def failed_jobs(jf: DataFrame) -> DataFrame:
    message = F.coalesce("error_message", F.lit(""))
    return jf.filter(status_is("failed")).withColumns({"failure_message": message, "failure_category": failure_category(message), "failure_phase": F.lit("job")})


def by_phase() -> list[Column]:
    return [F.count_if(F.col("failure_phase") == p).alias(p) for p in PHASES] + [F.count_if(~F.col("failure_phase").isin(*PHASES)).alias("unknown")]


def distinct_jobs(name: str = "affected_jobs") -> Column:
    return F.countDistinct(F.nullif("job_id", F.lit(""))).alias(name)


def failure_summary(df: DataFrame, jf: DataFrame) -> DataFrame:
    """One row: records, dates and newest times of both logs, failed runs and jobs, what they touch, repeated signatures, and the top one's runs, share, category and phase.

    The top signature has most failed runs, then most jobs, then the newest failure, then comes first by text. active_engines and active_metadata_providers count those of the jobs.
    """
    runs, jobs = failed_runs(df), failed_jobs(jf)
    route = F.concat_ws("|", F.coalesce("source_name", F.lit("unknown")), F.coalesce("destination_name", F.lit("unknown")))
    shape = F.concat_ws("|", F.coalesce("operation_types", F.lit("")), F.coalesce("stages", F.lit("")))
    name = F.coalesce(F.nullif("dataflow_name", F.lit("")), "job_id")
    a = runs.agg(F.count(F.lit(1)).alias("failed_dataflows"), distinct_jobs("affected_dataflow_jobs"), F.countDistinct(F.nullif("dataflow_id", F.lit(""))).alias("affected_dataflows"), F.countDistinct(route).alias("affected_routes"), F.max("event_time").alias("latest_failure_at"), latest(name).alias("latest_failure_name"))
    signs = runs.groupBy("failure_signature").agg(F.count(F.lit(1)).alias("n"), distinct_jobs("jobs"), F.max("event_time").alias("at"), F.max("failure_category").alias("category"), F.max("failure_phase").alias("phase"))
    first = F.struct(-F.col("n"), -F.col("jobs"), F.col("at").isNull(), -F.unix_micros(F.col("at").cast("timestamp")), "failure_signature")
    top = F.min_by(F.struct("n", "category", "phase", "failure_signature"), first).alias("top")
    repeated = F.col("n") >= 2
    b = signs.agg(F.count(F.lit(1)).alias("unique_signatures"), F.count_if(repeated).alias("repeated_signatures"), total(F.when(repeated, F.col("n"))).alias("repeated_failure_runs"), top)
    c = jobs.agg(F.count(F.lit(1)).alias("failed_jobs"), distinct_jobs(), F.countDistinct(shape).alias("affected_job_shapes"))
    different = lambda c: F.countDistinct(F.nullif(c, F.lit("")))
    d = jf.agg(F.count_if(status_is("succeeded")).alias("succeeded_jobs"), F.min("run_date").alias("first_job"), F.max("run_date").alias("last_job"), different("engine_name").alias("active_engines"), different("metadata_provider_name").alias("active_metadata_providers"))
    e = record_counts(df, jf).drop("active_engines", "active_metadata_providers").join(df.agg(F.count_if(status_is("succeeded")).alias("succeeded_dataflows")))
    out = a.join(b).join(c).join(d).join(e)
    share = lambda part: F.coalesce(rate(part, F.col("failed_dataflows")), F.lit(0.0))
    told = {
        "date_min": F.least("date_min", "first_job"), "date_max": F.greatest("date_max", "last_job"), "failed_job_runs": F.col("failed_jobs"), "affected_job_contexts": F.col("affected_job_shapes"), "affected_stages": F.col("affected_job_shapes"),
        "total_failed_records": F.col("failed_dataflows"), "repeated_failure_share": share(F.col("repeated_failure_runs")), "top_cause_runs": F.coalesce("top.n", F.lit(0)), "top_cause_share": share(F.coalesce("top.n", F.lit(0))),
        "top_cause_category": F.col("top.category"), "top_cause_phase": F.col("top.phase"), "top_cause_signature": F.col("top.failure_signature"),
    }
    return out.withColumns(told).drop("top", "first_job", "last_job")


def failed_records(df: DataFrame, top: int = 100) -> DataFrame:
    """Newest failures; rule and tags are found for the page only."""
    page = failed_runs(df).orderBy(F.desc_nulls_last("event_time"), "dataflow_run_id").limit(top)
    return page.select("dataflow_run_id", "event_time", "failure_phase", "failure_category", "failure_message", "failure_target", failure_rule_id(F.col("failure_message")).alias("rule_id"), F.array_join(failure_tags(all_messages(), F.col("failure_category")), ",").alias("tags"))


def repeated_signatures(df: DataFrame, top: int = 30) -> DataFrame:
    flow = F.coalesce(F.nullif("dataflow_id", F.lit("")), F.nullif("dataflow_name", F.lit("")))
    out = failed_runs(df).groupBy("failure_signature").agg(F.count(F.lit(1)).alias("failed_runs"), distinct_jobs(), F.countDistinct(flow).alias("affected_dataflows"), F.max("event_time").alias("latest_time"), latest("failure_message").alias("latest_error"), latest("failure_target").alias("failure_target"))
    return out.orderBy(F.desc("failed_runs"), F.desc("affected_jobs"), F.desc_nulls_last("latest_time"), "failure_signature").limit(top)


def failure_by_endpoint(df: DataFrame, top: int = 30) -> DataFrame:
    ends = [F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")).alias(c) for c in ("source_name", "destination_name")]
    out = failed_runs(df).groupBy(*ends).agg(F.count(F.lit(1)).alias("failed_runs"), distinct_jobs(), dominant("failure_category").alias("failure_category"), dominant("failure_phase").alias("failure_phase"), F.coalesce(dominant(F.nullif("source_format", F.lit(""))), F.lit("unknown")).alias("source_format"), F.max("event_time").alias("latest_time"))
    return out.orderBy(F.desc("failed_runs"), F.desc("affected_jobs"), F.desc_nulls_last("latest_time"), "source_name", "destination_name").limit(top)


def category_phase_matrix(df: DataFrame) -> DataFrame:
    return failed_runs(df).groupBy(F.col("failure_category").alias("category")).agg(*by_phase(), F.count(F.lit(1)).alias("total"))


def failures_by_stage(df: DataFrame, top: int = 30) -> DataFrame:
    return failed_runs(df).groupBy(F.coalesce(F.nullif("stage", F.lit("")), F.lit("unknown")).alias("name")).agg(*by_phase(), F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "name").limit(top)


def failure_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Failures by source type, phase or category."""
    out = failed_runs(df).groupBy(F.coalesce(F.nullif(column, F.lit("")), F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.desc("count"), "name").limit(top) if top else out


def top_failing_dataflows(df: DataFrame, top: int = 30) -> DataFrame:
    named = failed_runs(df).filter(filled("dataflow_id").isNotNull())
    out = named.groupBy("dataflow_id").agg(F.coalesce(latest(F.nullif("dataflow_name", F.lit(""))), F.first("dataflow_id")).alias("dataflow_name"), F.count(F.lit(1)).alias("error_count"), *by_phase(), distinct_jobs(), latest("failure_message").alias("last_error"), F.max("event_time").alias("last_time"))
    return out.orderBy(F.desc("error_count"), F.desc("affected_jobs"), F.desc_nulls_last("last_time"), "dataflow_name", "dataflow_id").limit(top)


def failure_trend(df: DataFrame, jf: DataFrame) -> DataFrame:
    both = df.filter(status_is("failed")).select("run_date", F.lit(1).alias("f"), F.lit(0).alias("j")).unionByName(jf.filter(status_is("failed")).select("run_date", F.lit(0).alias("f"), F.lit(1).alias("j")))
    return both.groupBy("run_date").agg(F.count(F.lit(1)).alias("failed"), F.sum("j").alias("failed_jobs"), F.sum("f").alias("failed_dataflows"))
