"""Audit of a log tree: what each file's schema and values say against the log's schema, and repair of whole numbers kept as floats."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.graph import settled
from .logs import JOB_RUN_SCHEMA

#: Columns that a cache adds to logs, and one of a dataflow's log that nobody reads.
OWN = ("_source_id", "_file_uri", "_file_kind", "_file_date", "_source_size", "_source_mtime_ns", "_ingested_at")
IGNORED = ("transform_missing_column_policy",)
#: Where logs for analysis are below a root, first found first.
STREAMS = ("etl_logs/analyst", "analyst")
FLOATS, WHOLES = ("float", "double"), ("tinyint", "smallint", "int", "bigint")
FOOTER = "path string, column string, source_type string, row_count bigint, invalid_count bigint, low double, high double, null_count bigint"
FINDING = ["category", "artifact_type", "path", "column", "target_type", "source_type", "occurrences", "row_count", "invalid_count", "low", "high", "null_count"]


class Audit(NamedTuple):
    """findings: a row for each file, column and kind of finding; columns: counts by column; totals: one row; repair_plan: (path, column)."""

    findings: DataFrame
    columns: DataFrame
    totals: DataFrame
    repair_plan: DataFrame


def type_name(t: pa.DataType) -> str:
    """An Arrow type as Spark writes it; others as Arrow does."""
    named = {pa.int8(): "tinyint", pa.int16(): "smallint", pa.int32(): "int", pa.int64(): "bigint", pa.float32(): "float", pa.float64(): "double", pa.string(): "string", pa.large_string(): "string", pa.bool_(): "boolean", pa.date32(): "date", pa.binary(): "binary"}
    if pa.types.is_timestamp(t):
        return "timestamp" if t.tz else "timestamp_ntz"
    return f"decimal({t.precision},{t.scale})" if pa.types.is_decimal(t) else named.get(t, str(t))


def lossy(x: np.ndarray) -> np.ndarray:
    """Which floats a 64-bit integer can't hold: not finite, not whole or too large."""
    return ~np.isfinite(x) | (x != np.floor(x)) | (x < -(2.0**63)) | (x >= 2.0**63)


def value_stats(file: pq.ParquetFile, column: str) -> tuple[int, int, float | None, float | None, int]:
    """Rows, values that a 64-bit integer can't hold, smallest and largest value (NaN left out), nulls; batch by batch."""
    invalid = nulls = 0
    low, high = math.inf, -math.inf
    for batch in file.iter_batches(columns=[column]):
        values = batch.column(0)
        nulls += values.null_count
        x = values.drop_null().to_numpy(zero_copy_only=False).astype(float)
        invalid += int(lossy(x).sum())
        x = x[~np.isnan(x)]
        if len(x):
            low, high = min(low, float(x.min())), max(high, float(x.max()))
    return file.metadata.num_rows, invalid, None if low > high else low, None if low > high else high, nulls


def footers(files: DataFrame, whole: list[str]) -> DataFrame:
    """A row for each column of the Parquet files at `path`, as told by their footers, which the tasks read.

    Of columns in `whole` that are floats the values are read as well. A file that isn't Parquet has one row with a null column.
    """
    wanted = frozenset(whole)
    shape = pa.schema([("path", pa.string()), ("column", pa.string()), ("source_type", pa.string()), ("row_count", pa.int64()), ("invalid_count", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("null_count", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                fs, at = FileSystem.from_uri(uri)
                with fs.open_input_file(at) as f:
                    try:
                        file = pq.ParquetFile(f)
                    except pa.ArrowInvalid:
                        rows.append((uri, None, None, None, None, None, None, None))
                    else:
                        # 96-bit times are instants, which Arrow's type doesn't tell
                        instants = {c.path for c in map(file.schema.column, range(len(file.schema))) if c.physical_type == "INT96"}
                        for field in file.schema_arrow:
                            kind = "timestamp" if field.name in instants else type_name(field.type)
                            stats = value_stats(file, field.name) if field.name in wanted and kind in FLOATS else (None,) * 5
                            rows.append((uri, field.name, kind, *stats))
                yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in rows], schema=shape)

    return files.select("path").mapInArrow(read, FOOTER)


def compatibility(target: Column, source: Column) -> Column:
    """same, compatible, checked (its values decide) or incompatible. Only floats become whole numbers, and only after a look at the values."""
    return (
        F.when(source == target, "same")
        .when((target == "bigint") & source.isin(*FLOATS), "checked")
        .when((target == "double") & source.isin(*WHOLES, *FLOATS), "compatible")
        .when(target.startswith("timestamp") & source.startswith("timestamp"), "compatible")
        .otherwise("incompatible")
    )


def log_files(spark: SparkSession, root: str, suffix: str = "jsonl") -> DataFrame:
    """path and kind (parquet or jsonl) of the files below the first of STREAMS that has any, else below the root. Job logs end in suffix and are in a folder job_run_log."""
    at = quote(re.sub(r"^\w+:/*", "/", root).rstrip("/"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{parquet,{suffix}}}").load(root).select(F.col("_metadata.file_path").alias("path"))
    rank = F.lit(len(STREAMS))
    for k, folder in reversed(list(enumerate(STREAMS))):
        rank = F.when(F.col("path").contains(f"{at}/{folder}/"), k).otherwise(rank)
    ranked = listed.withColumn("rank", rank)
    kind = F.when(F.col("path").endswith(".parquet"), "parquet").when(F.col("path").contains("/job_run_log/"), "jsonl")
    return ranked.join(F.broadcast(ranked.agg(F.min("rank").alias("first")))).filter("rank = first").select("path", kind.alias("kind")).filter("kind is not null")


def job_lines(spark: SparkSession, root: str, files: DataFrame, suffix: str) -> DataFrame:
    """path and v (the line as a variant, null if it isn't JSON) of each line of the job logs that isn't blank."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").text(root).select("value", F.col("_metadata.file_path").alias("path")).filter(F.trim("value") != "")
    return lines.join(files.filter("kind = 'jsonl'").select("path"), "path", "left_semi").select("path", F.try_parse_json("value").alias("v"))


def json_type(v: Column) -> Column:
    """null, bool, int, str, dict, list or float. Zeros behind the point are lost, so decimals without others are ints only if no 64-bit integer holds them."""
    kind = F.schema_of_variant(v)
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|2\d|3\d),0\)$")
    return F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "bool").when(whole, "int").when(kind == "STRING", "str").when(kind.startswith("OBJECT"), "dict").when(kind.startswith("ARRAY"), "list").otherwise("float")


def json_fits(kind: Column, target: Column) -> Column:
    fits = F.when(target == "string", kind == "str").when(target == "boolean", kind == "bool").when(target == "bigint", kind == "int").when(target == "double", kind.isin("int", "float")).otherwise(True)
    return (kind == "null") | fits


def schema_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema], "column string, target_type string")


def audit_logs(spark: SparkSession, root: str, target: T.StructType, jobs: T.StructType = JOB_RUN_SCHEMA, own: tuple[str, ...] = OWN, ignored: tuple[str, ...] = IGNORED, suffix: str = "jsonl") -> Audit:
    """What the Parquet files of dataflow runs and the JSON lines of job runs below root have that isn't as in `target` and `jobs`.

    Categories: ignored and unexpected columns, incompatible types or values, compatible types, and repairable ones: floats that all are whole.
    Columns of `own` have no findings. Job findings are counted by file, column and JSON type; a line that isn't JSON has a null column, as has a file
    that isn't Parquet. NaN and infinite numbers or repeated keys make a line malformed. Only records of type job_run_log are looked at. A tree without files gives no findings and totals of 0.
    Files have to be readable by pyarrow's file systems, on the executors. Footers and counts of lines are written to a table once, and what is returned is derived from those.
    """
    files = settled(log_files(spark, root, suffix))
    wanted = schema_table(spark, target)
    found = settled(footers(files.filter("kind = 'parquet'"), [f.name for f in target if f.dataType.simpleString() == "bigint"]))
    judged = found.filter(~F.coalesce(F.col("column").isin(*own), F.lit(False))).join(F.broadcast(wanted), "column", "left").withColumn("fit", compatibility(F.col("target_type"), F.col("source_type")))
    category = (
        F.when(F.col("column").isNull(), "incompatible")
        .when(F.col("column").isin(*ignored), "ignored")
        .when(F.col("target_type").isNull(), "unexpected")
        .when(F.col("fit") == "checked", F.when(F.col("invalid_count") == 0, "repairable").otherwise("incompatible"))
        .otherwise(F.col("fit"))
    )
    shown = F.when(~F.col("column").isin(*ignored), F.col("target_type"))
    of_flows = judged.select(category.alias("category"), F.lit("dataflow_parquet").alias("artifact_type"), "path", "column", shown.alias("target_type"), "source_type", F.lit(1).cast("long").alias("occurrences"), "row_count", "invalid_count", "low", "high", "null_count").filter("category <> 'same'")

    lines = job_lines(spark, root, files, suffix)
    keys = lines.filter(F.try_variant_get("v", "$._type", "string") == "job_run_log").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    kinds = F.col("key").alias("column"), json_type(F.col("value")).alias("source_type")
    counted = settled(
        keys.groupBy("path", *kinds).agg(F.count(F.lit(1)).alias("occurrences"))
        .unionByName(lines.filter("v is null").groupBy("path", F.lit(None).cast("string").alias("column"), F.lit("malformed").alias("source_type")).agg(F.count(F.lit(1)).alias("occurrences")))
    )
    own_type = (F.col("column") == "_type") & (F.col("source_type") == "str")
    expected = schema_table(spark, jobs)
    bad = F.when(F.col("column").isNull(), "incompatible").when(F.col("target_type").isNull(), "unexpected").when(~json_fits(F.col("source_type"), F.col("target_type")), "incompatible")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("row_count", "long"), ("invalid_count", "long"), ("low", "double"), ("high", "double"), ("null_count", "long"))]
    of_jobs = counted.join(F.broadcast(expected), "column", "left").select(bad.alias("category"), F.lit("job_jsonl").alias("artifact_type"), "path", "column", "target_type", "source_type", "occurrences", *none).filter("category is not null")
    findings = of_flows.unionByName(of_jobs)

    # every record has the key _type, so its count is that of the records
    records = counted.agg(F.coalesce(F.sum(F.when(own_type, F.col("occurrences"))), F.lit(0)).alias("job_records"), F.coalesce(F.sum(F.when(F.col("column").isNull(), F.col("occurrences"))), F.lit(0)).alias("malformed_job_lines"))
    how_many = files.agg(F.count_if(F.col("kind") == "parquet").alias("parquet_files"), F.count_if(F.col("kind") == "jsonl").alias("job_jsonl_files"))
    named = ("compatible", "ignored", "incompatible", "repairable", "unexpected")
    totals = how_many.join(records).join(findings.agg(*[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("occurrences"))), F.lit(0)).alias(f"{c}_count") for c in named]))

    has = lambda rows: rows.groupBy("column").agg(F.sum("occurrences").alias("n"))
    flow_columns = wanted.join(has(found.withColumn("occurrences", F.lit(1))), "column", "left").join(F.broadcast(how_many)).select(F.lit("dataflow_parquet").alias("artifact_type"), "column", F.lit("missing").alias("what"), (F.col("parquet_files") - F.coalesce("n", F.lit(0))).alias("count"))
    job_columns = expected.join(has(counted), "column", "left").join(F.broadcast(records)).select(F.lit("job_jsonl").alias("artifact_type"), "column", F.lit("missing").alias("what"), (F.col("job_records") - F.coalesce("n", F.lit(0))).alias("count"))
    typed = found.filter("column is not null").groupBy("column", "source_type").agg(F.count(F.lit(1)).alias("count")).select(F.lit("dataflow_parquet").alias("artifact_type"), "column", F.concat(F.lit("type "), "source_type").alias("what"), "count")
    others = findings.filter("category in ('ignored', 'unexpected')").groupBy("artifact_type", "column", F.col("category").alias("what")).agg(F.sum("occurrences").alias("count"))
    columns = flow_columns.unionByName(job_columns).filter("count > 0").unionByName(typed).unionByName(others)
    return Audit(findings.select(*FINDING), columns, totals, of_flows.filter("category = 'repairable'").select("path", "column"))


def repair_logs(spark: SparkSession, audit: Audit, folder: str) -> DataFrame:
    """Copies of the files in the repair plan below folder with whole floats as 64-bit integers: path, repaired, columns, rows. The originals stay.

    Refused if the audit has incompatible findings. Each task writes its files batch by batch under a name made from the file's path, which a repeated task writes
    anew, then reads the copy and compares rows, nulls and sums with the original; a difference is an error. Nothing is written before the result is asked for.
    """
    if audit.totals.filter("incompatible_count > 0").count():
        raise ValueError("the audit has incompatible findings; nothing was repaired")
    plan = audit.repair_plan.groupBy("path").agg(F.array_sort(F.collect_list("column")).alias("columns"))
    named = plan.select("path", "columns", F.concat(F.lit(f"{folder.rstrip('/')}/"), F.sha1("path"), F.lit(".parquet")).alias("repaired"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                (fs, at), (to, new) = FileSystem.from_uri(row["path"]), FileSystem.from_uri(row["repaired"])
                before = {c: [0, 0, 0.0] for c in row["columns"]}
                after = {c: [0, 0, 0.0] for c in row["columns"]}
                to.create_dir(new.rsplit("/", 1)[0])
                with fs.open_input_file(at) as f, to.open_output_stream(new) as g:
                    file = pq.ParquetFile(f)
                    schema = pa.schema([x.with_type(pa.int64()) if x.name in row["columns"] else x for x in file.schema_arrow])
                    with pq.ParquetWriter(g, schema) as writer:
                        for part in file.iter_batches():
                            tally(before, part)
                            writer.write_batch(pa.RecordBatch.from_arrays([pc.cast(c, x.type) for c, x in zip(part.columns, schema, strict=True)], schema=schema))
                with to.open_input_file(new) as f:
                    for part in pq.ParquetFile(f).iter_batches(columns=row["columns"]):
                        tally(after, part)
                if before != after:
                    raise ValueError(f"the repaired copy of {row['path']} differs from it")
                done.append({**row, "rows": next(iter(after.values()))[0]})
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("repaired", pa.string()), ("columns", pa.list_(pa.string())), ("rows", pa.int64())]))

    return named.select("path", "repaired", "columns").mapInArrow(rewrite, "path string, repaired string, columns array<string>, rows bigint")


def tally(sums: dict[str, list], part: pa.RecordBatch) -> None:
    """Adds a batch's rows, nulls and sum of each column."""
    for c, s in sums.items():
        x = part.column(part.schema.get_field_index(c))
        s[0] += len(x)
        s[1] += x.null_count
        s[2] += float(pc.sum(pc.cast(x, pa.float64())).as_py() or 0.0)
