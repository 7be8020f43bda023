"""Registered streaming queries: tables read as file streams until they are used up, with checkpoints and results in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rendered
from ..functions.graph import shared_folder
from ..sources.derived import oracle_facts
from ..sources.generations import publish_generation, read_published, write_generation
from ..streaming import runs as R
from .ingestion import JOB_NUMBER, log_folder


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return rows.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("dataflow_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("dataflow_run_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("event_time"))


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that the stream gives, written by its batches."""
    spark, at = df.sparkSession, shared_folder(df.sparkSession, "stream")
    if mode == "complete":  # each batch gives the whole result, of which the last stays
        out = df.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/rows"))
    else:
        out = df.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/rows")
    out.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows")


def status_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend of all runs: a last row of the far future moves the watermark past every window, and its own never closes."""
    rows = events(spark, sf_dir)
    trend = R.stream_status_trend(rows, "1 day", "40000 days")
    return rendered(drained(trend, "complete"))


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(drained(R.stream_latest_status(events(spark, sf_dir)), "complete"))


def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job lines as they arrive; lines that don't parse have no job."""
    rows = R.stream_job_runs(spark, f"{log_folder(spark, sf_dir)}/jobs")
    return drained(rows.filter("job_id is not null").select("job_id", "status", "total_failed"))


def stream_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = log_folder(spark, sf_dir)
    schema = spark.read.parquet(f"{at}/flows/dt=2024-01-01").schema
    return drained(R.stream_dataflow_runs(spark, f"{at}/flows", schema).select("dataflow_run_id", "status"))


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in one batch, in a table that replaces by file."""
    at = shared_folder(spark, "replaced")
    rows = events(spark, sf_dir).withColumn("_file_uri", F.concat(F.lit("f"), F.substring("dataflow_run_id", 12, 1)))
    R.start_replace_by_file(rows, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return rendered(R.read_replaced(spark, f"{at}/table").select("dataflow_run_id", "status", "run_date"))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three published batches over files of about a hundred events: a second version of each fifth file, then one of each seventh, in which each eleventh is gone; and a fourth batch that was never published."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.floor(F.col("event_id") / 100).alias("n"), F.to_date("ts").alias("run_date"))
    rows = rows.withColumn("_file_uri", F.concat(F.lit("file-"), F.col("n").cast("string")))
    at = shared_folder(spark, "generations")
    n = F.col("n")
    batches = [(rows, None), (rows.filter(n % 5 == 0), None), (rows.filter((n % 7 == 0) & (n % 11 != 0)), rows.filter(n % 11 == 0)), (rows.filter(n % 3 == 0), None)]
    for k, (new, gone) in enumerate(batches):
        write_generation(new.select("_file_uri", "event_id", "run_date", F.lit(k).alias("version")), at, k, gone)
        if k < 3:
            publish_generation(spark, at, k)
    return rendered(read_published(spark, at).select("_file_uri", "event_id", "version", "run_date"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"z01_stream_dataflow_runs": stream_flows, "z01_stream_job_runs": stream_jobs, "z02_replace_by_file": replaced, "z02_generations": generations, "z04_stream_status_trend": status_trend, "z05_stream_latest_status": latest_status}


def oracle_sql() -> dict[str, str]:
    return {
        "z01_stream_dataflow_runs": f"{oracle_facts()} SELECT dataflow_run_id, status FROM raw_runs",
        "z01_stream_job_runs": f"{oracle_facts()} SELECT job_id, status, total_failed FROM raw_jobs WHERE {JOB_NUMBER} % 50 <> 0 AND {JOB_NUMBER} % 51 <> 1",
        "z02_generations": "SELECT 'file-' || n AS _file_uri, event_id, CASE WHEN n % 7 = 0 THEN 2 WHEN n % 5 = 0 THEN 1 ELSE 0 END AS version, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_date FROM (SELECT *, event_id // 100 AS n FROM events) WHERE n % 11 <> 0",
        "z02_replace_by_file": "SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS dataflow_run_id, event_type AS status, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_date FROM events",
        "z04_stream_status_trend": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS bucket_start, LOWER(event_type) AS status, COUNT(*) AS runs FROM events GROUP BY 1, 2",
        "z05_stream_latest_status": "SELECT 'user-' || user_id AS dataflow_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time, LOWER(event_type) AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    }
