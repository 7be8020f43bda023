"""Data quality of the logs: linkage, reconciliation, completeness, coverage and the queue of what to look into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import NO_ID, bucket, filled, rate
from .jobs import job_comparisons


def clean_id(c: str) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*NO_ID), F.trim(c))


def job_linkage(df: DataFrame, jf: DataFrame) -> DataFrame:
    """Job ids of both logs: matched, orphan (dataflows only) or job_only. Sources aren't told apart."""
    flows = df.select(clean_id("job_id").alias("job_id"), "event_time").filter("job_id is not null").groupBy("job_id").agg(F.count(F.lit(1)).alias("dataflows"), F.max("event_time").alias("latest_dataflow"))
    jobs = jf.select(clean_id("job_id").alias("job_id"), "event_time").filter("job_id is not null").groupBy("job_id").agg(F.count(F.lit(1)).alias("jobs"), F.max("event_time").alias("latest_job"))
    both = flows.join(jobs, "job_id", "full_outer")
    kind = F.when(F.col("jobs").isNull(), "orphan").when(F.col("dataflows").isNull(), "job_only").otherwise("matched")
    return both.select("job_id", F.coalesce("dataflows", F.lit(0)).alias("dataflows"), F.coalesce("jobs", F.lit(0)).alias("jobs"), F.greatest("latest_dataflow", "latest_job").alias("latest_time"), kind.alias("linkage"))


def linkage_summary(df: DataFrame, jf: DataFrame) -> DataFrame:
    return job_linkage(df, jf).groupBy("linkage").agg(F.count(F.lit(1)).alias("jobs"), F.sum("dataflows").alias("dataflows"))


def linkage_evidence(df: DataFrame, jf: DataFrame, top: int = 200) -> DataFrame:
    rank = Window.partitionBy("linkage").orderBy(F.desc_nulls_last("latest_time"), "job_id")
    return job_linkage(df, jf).withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= top).select("linkage", "r", "job_id", "dataflows", "latest_time")


def reconciliation(jf: DataFrame, df: DataFrame) -> DataFrame:
    """Mismatches by metric with the sum of their differences and the jobs they affect."""
    return job_comparisons(jf, df).groupBy("metric").agg(F.count(F.lit(1)).alias("mismatches"), F.sum(F.abs("difference")).alias("difference"), F.count_distinct("job_id").alias("affected_jobs"))


def reconciliation_checks(jf: DataFrame, df: DataFrame, top: int = 50) -> DataFrame:
    """The first mismatches by job and metric, each with the number of all."""
    bad = job_comparisons(jf, df)
    listed = bad.orderBy("job_id", "metric").limit(top)
    return listed.join(bad.agg(F.count(F.lit(1)).alias("mismatch_count"))).select("job_id", "metric", "expected", "observed", "difference", "mismatch_count")  # one row


#: Group, columns of which one has to be filled, whether every run should have it.
FIELDS = [
    ("job identity", ["job_id"], True),
    ("dataflow identity", ["dataflow_id"], True),
    ("dataflow name", ["dataflow_name"], True),
    ("status", ["status"], True),
    ("event time", ["event_time"], True),
    ("duration", ["duration_seconds"], True),
    ("stage", ["stage"], False),
    ("operation", ["operation_type"], False),
    ("source", ["source_name"], False),
    ("destination", ["destination_full_table", "destination_table", "destination_path", "destination_name"], False),
    ("watermark", ["source_watermark_columns"], False),
    ("volume", ["source_rows_read", "destination_rows_written"], False),
]


def field_completeness(df: DataFrame) -> DataFrame:
    """Filled rows of each field group and what that calls for: bad below 80 %, warning below 95 %, for fields that all runs should have."""
    present = lambda cs: F.coalesce(*[filled(F.col(c).cast("string")) for c in cs]).isNotNull()
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(present(cs)).alias(f"n{i}") for i, (_, cs, _) in enumerate(FIELDS)])
    long = counts.select("rows", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(u).alias("universal"), F.col(f"n{i}").alias("present")) for i, (n, _, u) in enumerate(FIELDS)])))
    share = rate(F.col("present"), F.col("rows"))
    return long.select("field", "present", "rows", share.alias("percent"), F.when(~F.col("universal"), "info").when(share < 80, "bad").when(share < 95, "warning").otherwise("ok").alias("severity"))


def source_coverage(df: DataFrame, jf: DataFrame) -> DataFrame:
    """Records, different files over both logs, file kind and newest times of each source."""
    wanted = ["_source_id", "_file_uri", "_file_kind", "event_time", "_ingested_at"]
    both = df.select(*wanted, F.lit(1).alias("f")).unionByName(jf.select(*wanted, F.lit(0).alias("f")))
    # one row a file first, so that no task counts all files of a source
    files = both.groupBy("_source_id", "_file_uri").agg(F.sum("f").alias("f"), F.count(F.lit(1)).alias("n"), F.max("_file_kind").alias("kind"), F.max("event_time").alias("log"), F.max("_ingested_at").alias("ingested"))
    out = files.groupBy("_source_id").agg(F.coalesce(F.max("kind"), F.lit("unknown")).alias("file_kind"), F.count("_file_uri").alias("file_count"), F.sum("f").alias("dataflow_records"), (F.sum("n") - F.sum("f")).alias("job_records"), F.sum("n").alias("records"), F.max("log").alias("latest_log_at"), F.max("ingested").alias("latest_ingested_at"))
    return out


def record_trend(df: DataFrame, jf: DataFrame, grain: str = "month", tz: str = "UTC") -> DataFrame:
    """Records of both logs by bucket, with zeros for buckets that have none."""
    one = lambda x, n: x.filter("event_time is not null").groupBy(bucket("event_time", grain, tz).alias("b")).agg(F.count(F.lit(1)).alias(n))
    both = one(df, "dataflow_records").join(one(jf, "job_records"), "b", "full_outer")
    step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}[grain]
    all_ = both.agg(F.min("b").alias("lo"), F.max("b").alias("hi")).filter("lo is not null").select(F.explode(F.sequence("lo", "hi", F.expr(step))).alias("b"))
    return all_.join(both, "b", "left").select(F.col("b").alias("bucket_start"), F.coalesce("dataflow_records", F.lit(0)).alias("dataflow_records"), F.coalesce("job_records", F.lit(0)).alias("job_records"))


def linkage_trend(df: DataFrame, jf: DataFrame, grain: str = "month", tz: str = "UTC") -> DataFrame:
    """Records of both logs by bucket, with how many job ids both have in it, only the dataflows or only the jobs, and the share of the first.

    Rows without a time are a bucket of their own, null. Ids are compared within a bucket, so a job that ran over its end may be in two.
    """
    at = bucket("event_time", grain, tz).alias("b")
    ids = lambda x, flag: x.select(at, clean_id("job_id").alias("job_id")).filter("job_id is not null").distinct().withColumn(flag, F.lit(1))
    # one row a bucket and id, counted by how many logs it is in: no join of the two
    both = ids(df, "in_df").unionByName(ids(jf, "in_jf"), allowMissingColumns=True).groupBy("b", "job_id").agg(F.max("in_df").alias("f"), F.max("in_jf").alias("j"))
    has = lambda c: F.col(c).isNotNull()
    links = both.groupBy("b").agg(F.count_if(has("f") & has("j")).alias("matched"), F.count_if(has("f") & ~has("j")).alias("orphan"), F.count_if(~has("f") & has("j")).alias("job_only"))
    counts = df.select(at, F.lit(1).alias("f"), F.lit(0).alias("j")).unionByName(jf.select(at, F.lit(0).alias("f"), F.lit(1).alias("j"))).groupBy("b").agg(F.sum("f").alias("dataflow_records"), F.sum("j").alias("job_records"))
    out = counts.join(links.withColumnRenamed("b", "lb"), F.col("b").eqNullSafe(F.col("lb")), "left").fillna(0, ["matched", "orphan", "job_only"])
    return out.select(F.col("b").alias("bucket_start"), "dataflow_records", "job_records", "matched", "orphan", "job_only", rate(F.col("matched"), F.col("matched") + F.col("orphan") + F.col("job_only")).alias("linkage_rate"))


def diagnostics_summary(df: DataFrame, jf: DataFrame) -> DataFrame:
    """Records of both logs, linkage counts, mismatches, bad and warned fields, the share of jobs ready for joint analysis, and the state of the logs.

    no_evidence without records, has_issues with orphans, jobs without dataflows or mismatches, warning if only one log has records, else healthy.
    """
    link = job_linkage(df, jf).agg(*[F.count_if(F.col("linkage") == k).alias(k) for k in ("matched", "orphan", "job_only")], rate(F.count_if(F.col("linkage") == "matched"), F.count(F.lit(1))).alias("readiness_rate"))
    bad = job_comparisons(jf, df).agg(F.count(F.lit(1)).alias("mismatches"))
    fields = field_completeness(df).agg(F.count_if(F.col("severity") == "bad").alias("bad_fields"), F.count_if(F.col("severity") == "warning").alias("warned_fields"))
    count = lambda x, name: x.agg(F.count(F.lit(1)).alias(name))
    out = link.join(bad).join(fields).join(count(df, "dataflow_records")).join(count(jf, "job_records"))  # one row each
    flows, jobs = F.col("dataflow_records") > 0, F.col("job_records") > 0
    issues = (F.col("orphan") > 0) | (F.col("job_only") > 0) | (F.col("mismatches") > 0)
    return out.withColumn("status", F.when(~flows & ~jobs, "no_evidence").when(issues, "has_issues").when(flows != jobs, "warning").otherwise("healthy"))


#: Category, issue and hint of what is to be looked into (fixed values).
ORPHAN = ("orphan dataflow job id", "Dataflow records reference a job_id with no matching job log.", "Check job_run_log coverage for the same run window.")
JOB_ONLY = ("job without dataflows", "Job log exists but no child dataflow records were found.", "Check dataflow_run_log coverage and cache sync for this job.")
MISMATCH = ("reconciliation mismatch", "Inspect the job drawer and child dataflow records.")
FIELD = ("field completeness", "Confirm the log version emits the fields used by Monitoring pages.")


def queue_row(df: DataFrame, severity: Column, category: str, issue: Column, target: Column, time: Column, evidence: Column, hint: str) -> DataFrame:
    return df.select(severity.alias("severity"), F.lit(category).alias("category"), issue.cast("string").alias("issue"), target.cast("string").alias("target"), time.cast("timestamp").alias("latest_time"), evidence.alias("evidence"), F.lit(hint).alias("action_hint"))


def investigation_queue(df: DataFrame, jf: DataFrame, top: int = 200, checks: int = 50) -> DataFrame:
    """What to look into, with its evidence as JSON and a hint: bad before warning, then the newest, those without a time last, then by category.

    Orphaned job ids are bad, jobs without dataflows and mismatches (the first 50 that reconciliation lists) warnings, incomplete fields what their severity says.
    Of each kind of linkage only the `top` that are listed can be in the queue.
    """
    link = job_linkage(df, jf).join(jf.select(clean_id("job_id").alias("job_id"), "total_dataflows").groupBy("job_id").agg(F.max("total_dataflows").alias("told")), "job_id", "left")
    none = F.lit(None)
    orphan = queue_row(link.filter("linkage = 'orphan'"), F.lit("bad"), ORPHAN[0], F.lit(ORPHAN[1]), F.col("job_id"), F.col("latest_time"), F.to_json(F.struct("job_id", F.col("dataflows").alias("dataflow_records"))), ORPHAN[2])
    alone = queue_row(link.filter("linkage = 'job_only'"), F.lit("warning"), JOB_ONLY[0], F.lit(JOB_ONLY[1]), F.col("job_id"), F.col("latest_time"), F.to_json(F.struct("job_id", F.coalesce("told", F.lit(0)).cast("long").alias("job_total_dataflows"))), JOB_ONLY[2])
    told = F.concat(F.col("metric"), F.lit(" expected "), F.col("expected"), F.lit(" but observed "), F.col("observed"), F.lit("."))
    listed = job_comparisons(jf, df).orderBy("job_id", "metric").limit(checks)
    odd = queue_row(listed, F.lit("warning"), MISMATCH[0], told, F.col("job_id"), none, F.to_json(F.struct("job_id", "metric", "expected", "observed", "difference")), MISMATCH[1])
    share = F.concat(F.lit("dataflow "), F.col("field"), F.lit(" completeness is "), F.col("percent"), F.lit("%."))
    fields = queue_row(field_completeness(df).filter("severity in ('bad', 'warning')"), F.col("severity"), FIELD[0], share, F.concat(F.lit("dataflow · "), F.col("field")), none, F.to_json(F.struct("field", "present", "rows")), FIELD[1])
    rank = F.when(F.col("severity") == "bad", 4).otherwise(3)
    all_ = orphan.unionByName(alone).unionByName(odd).unionByName(fields)
    return all_.orderBy(F.desc(rank), F.desc_nulls_last("latest_time"), "category", "target", "issue").limit(top)
