"""Fact building: typed job and dataflow facts from raw run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import filled, has_id, known, normalized_status, utc_date


def pad_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with a typed null for each column of schema that it lacks."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name.lower() not in have})


def run_date(df: DataFrame) -> Column:
    """The run's date as its log gives it (__run_date), else the UTC date of its event."""
    own = utc_date("event_time")
    return F.coalesce(F.col("__run_date").cast("date"), own) if "__run_date" in df.columns else own


def build_job_facts(jobs: DataFrame) -> DataFrame:
    return jobs.withColumns({"normalized_status": normalized_status("status"), "run_date": run_date(jobs)})


def build_dataflow_facts(runs: DataFrame, jf: DataFrame) -> DataFrame:
    """Runs with the context of their job: one row for each (source, job) with any known value; `unknown` without a job.

    Both sides are dealt by (source, job), so the join needs no more than one shuffle of the runs; Spark broadcasts the
    context where it is small. Runs without a job are dealt by their own id instead, so they don't meet in one task. As the context has one row
    a key, Spark leaves the join out of a plan that reads none of its columns. Of several values the smallest is taken, so that each reading gives the same.
    """
    names = ["engine_name", "metadata_provider_name", "platform_name"]
    held = jf.filter("job_id is not null")
    context = held.groupBy("_source_id", F.concat(F.lit("j"), "job_id").alias("__job")).agg(*[F.min(filled(c)).alias(f"__{c}") for c in names])
    key = F.coalesce(F.concat(F.lit("j"), "job_id"), F.concat(F.lit("r"), F.coalesce("dataflow_run_id", F.lit(""))))
    out = runs.withColumn("__job", key).join(context, ["_source_id", "__job"], "left")
    out = out.withColumns({c: known(f"__{c}") for c in names}).drop("__job", *[f"__{c}" for c in names])
    return out.withColumns({"normalized_status": normalized_status("status"), "run_date": run_date(runs)})


def validate_facts(raw: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: rows of both, rows whose derived columns differ from their definition, and whether publication may go on."""
    rows = raw.agg(F.count(F.lit(1)).alias("raw_rows"))
    status = F.col("normalized_status").eqNullSafe(normalized_status("status"))
    date = F.col("run_date").eqNullSafe(run_date(facts))
    checks = facts.agg(F.count(F.lit(1)).alias("fact_rows"), F.count_if(~status).alias("status_mismatches"), F.count_if(~date).alias("run_date_mismatches"))
    return rows.join(checks).withColumn("valid", (F.col("raw_rows") == F.col("fact_rows")) & (F.col("status_mismatches") == 0) & (F.col("run_date_mismatches") == 0))


def latest_dataflow_runs(df: DataFrame) -> DataFrame:
    """Newest run of each identity, `id:` the dataflow id or else `name:` its name; names with several ids are ambiguous."""
    name = F.nullif(F.lower(F.trim("dataflow_name")), F.lit(""))
    identity = F.when(has_id(), F.concat(F.lit("id:"), F.trim("dataflow_id"))).when(name.isNotNull(), F.concat(F.lit("name:"), name))
    named = df.withColumn("identity", identity).filter("identity is not null")
    newest = Window.partitionBy("identity").orderBy(F.desc_nulls_last("event_time"), F.desc("dataflow_run_id"))
    first = named.withColumn("r", F.row_number().over(newest)).filter("r = 1").withColumn("name_key", name)
    shared = df.filter(has_id() & name.isNotNull()).groupBy(name.alias("name_key")).agg(F.countDistinct(F.trim("dataflow_id")).alias("ids"))
    out = first.join(shared, "name_key", "left")
    return out.select("identity", "dataflow_id", "dataflow_name", "dataflow_run_id", "job_id", "normalized_status", "event_time", (F.coalesce("ids", F.lit(0)) > 1).alias("ambiguous_name"))


def filter_values(df: DataFrame, jf: DataFrame) -> DataFrame:
    """(source, field, value, records) of the filter dimensions; a connection counts a run once though it may be both ends."""
    flows = ["stage", "source_connection_type", "destination_connection_type", "source_format", "destination_format", "destination_load_type", "operation_type", "normalized_status"]
    jobs = ["engine_name", "metadata_provider_name", "platform_name", "normalized_status"]

    def counted(x: DataFrame, fields: list[str], kind: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f"{kind}_{f}").alias("field"), filled(f).alias("value")) for f in fields])
        return x.select("_source_id", F.inline(pairs)).filter("value is not null").groupBy("_source_id", "field", "value").agg(F.count(F.lit(1)).alias("records"))

    ends = F.array_distinct(F.array_compact(F.array(filled("source_name"), filled("destination_name"))))
    both = df.select("_source_id", F.lit("connection").alias("field"), F.explode(ends).alias("value")).groupBy("_source_id", "field", "value").agg(F.count(F.lit(1)).alias("records"))
    return counted(df, flows, "dataflow").unionByName(counted(jf, jobs, "job")).unionByName(both)
