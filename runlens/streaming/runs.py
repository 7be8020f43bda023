"""Structured Streaming: run logs that arrive as files, status trends and latest states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import normalized_status
from ..sources.generations import publish_generation, read_published, write_generation
from ..sources.logs import JOB_RUN_SCHEMA


def stream_dataflow_runs(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files as they arrive; the checkpoint remembers those already read."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).select("*", F.col("_metadata.file_path").alias("_file_uri"))


def stream_job_runs(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    rows = spark.readStream.schema(JOB_RUN_SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return rows.select("*", F.col("_metadata.file_path").alias("_file_uri"))


def stream_system_logs(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of system logs as they arrive: level, dataflow_id, job_id (from the file's name where a line has none) and message."""
    lines = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).text(folder)
    row = F.from_json("value", "level string, dataflow_id string, job_id string, message string")
    named = F.nullif(F.regexp_extract(F.col("_metadata.file_name"), r"system_log_\d{8}_\d{6}_(.+)\.jsonl$", 1), F.lit(""))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = lines.filter(F.trim("value") != "").select(row.alias("r"), named.alias("job"), F.col("_metadata.file_path").alias("_file_uri"))
    return out.select(F.upper("r.level").alias("level"), blank("r.dataflow_id").alias("dataflow_id"), F.coalesce(blank("r.job_id"), "job").alias("job_id"), F.col("r.message").alias("message"), "_file_uri")


def within_watermark(runs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Runs with a watermark on event_time: later aggregations drop rows that come later than `late` behind the newest."""
    return runs.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", late)


def stream_status_trend(runs: DataFrame, grain: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Runs by tumbling window and status; a window is final once the watermark has passed it, and later rows are dropped."""
    timed = within_watermark(runs, late).withColumn("status", normalized_status("status"))
    return timed.groupBy(F.window("event_time", grain), "status").agg(F.count(F.lit(1)).alias("runs")).select(F.col("window.start").alias("bucket_start"), "status", "runs")


def stream_latest_status(runs: DataFrame) -> DataFrame:
    """Newest state of each dataflow, for update mode. State holds one row a dataflow."""
    newest = F.max(F.struct(F.col("event_time").cast("timestamp").alias("event_time"), F.col("dataflow_run_id"), normalized_status("status").alias("status"))).alias("n")
    return runs.groupBy("dataflow_id").agg(newest).select("dataflow_id", F.col("n.event_time").alias("event_time"), F.col("n.status").alias("status"))


def start_replace_by_file(runs: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Each batch replaces the rows of its files; it writes its own rows only, and is seen once it is published (see sources.generations).

    A batch that runs again writes and publishes the same generation. The file source never reads an altered file again: rewritten files need the
    batch plan with a manifest. Rows without event_time have the date of the epoch's start, 1970-01-01.
    """

    def publish(batch: DataFrame, epoch: int) -> None:
        new = batch.withColumn("run_date", F.coalesce(F.to_date("event_time"), F.to_date(F.lit("1970-01-01"))))
        write_generation(new, table, epoch)
        publish_generation(batch.sparkSession, table, epoch)

    return runs.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_replaced(spark: SparkSession, table: str) -> DataFrame:
    """The newest published rows of each file."""
    return read_published(spark, table)
