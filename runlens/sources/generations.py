"""Tables of rows by file, written in generations: a batch is seen as a whole once its publication row is there, or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dealing import dealt_join


def write_generation(rows: DataFrame, folder: str, generation: int, gone: DataFrame | None = None) -> None:
    """Writes the new rows of a batch's files (rows: _file_uri, run_date and others; gone: _file_uri of files whose rows are to go), unseen until published.

    Only the batch is written, whatever the table holds: rows by run date, of which those of many rows are split at run time, so that no task has a whole large date, and one row for each file it
    replaces. A batch that runs again writes the same folders.
    """
    rows.hint("rebalance", F.col("run_date")).write.mode("overwrite").partitionBy("run_date").parquet(f"{folder}/rows/generation={generation}")
    files = rows.select("_file_uri").distinct().withColumn("held", F.lit(True))
    if gone is not None:
        files = files.unionByName(gone.select("_file_uri").distinct().withColumn("held", F.lit(False)))
    files.write.mode("overwrite").parquet(f"{folder}/files/generation={generation}")


def publish_generation(spark: SparkSession, folder: str, generation: int) -> None:
    """The publication row of a generation, written after all that it publishes."""
    spark.range(1).select(F.current_timestamp().alias("published_at")).write.mode("overwrite").parquet(f"{folder}/publications/generation={generation}")


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """Every file's rows as of its newest published generation; files that a later one calls gone have none, others keep theirs."""
    published = spark.read.parquet(f"{folder}/publications").select("generation")
    files = spark.read.parquet(f"{folder}/files").join(published, "generation", "left_semi")
    newest = files.groupBy("_file_uri").agg(F.max("generation").alias("generation"), F.max_by("held", "generation").alias("held")).filter("held").drop("held")
    rows = spark.read.parquet(f"{folder}/rows")
    return dealt_join(rows, newest, ["_file_uri", "generation"], F.xxhash64(*[c for c in rows.columns if c != "generation"]), "inner").select(*[c for c in rows.columns if c != "generation"])
