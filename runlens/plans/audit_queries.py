"""Registered queries of the audit, over log files derived from the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.graph import shared_folder
from ..sources import audit
from ..sources.derived import oracle_facts, raw_runs
from ..sources.logs import JOB_RUN_SCHEMA
from .published import revision

TARGET = T.StructType([T.StructField(n, t) for n, t in (("dataflow_run_id", T.StringType()), ("status", T.StringType()), ("stage", T.StringType()), ("destination_rows_inserted", T.LongType()), ("source_rows_read", T.LongType()), ("duration_seconds", T.DoubleType()), ("event_time", T.TimestampType()))])
RUN_KEY = "CAST(split_part(dataflow_run_id, '-', 1) AS BIGINT)"
JOB_KEY = "CAST(substring(job_id, 5, 20) AS BIGINT)"
#: Runs of a file; each kind of file deviates in its own way.
PER_FILE, KINDS = 1000, 4
ODD = {"bad": 50, "blank": 51, "other": 53, "text": 59, "note": 61, "list": 67}

_TREES: dict[tuple[str, str], tuple[tuple, str]] = {}


def tree(spark: SparkSession, sf_dir: str) -> str:
    """A log tree, once a session and revision of the tables: Parquet files of four kinds, job logs with odd lines, and logs that no audit looks at."""
    key, now = (spark.sparkContext.applicationId, sf_dir), revision(spark, f"{sf_dir}/lineitem.parquet")
    if _TREES.get(key, (None,))[0] != now:
        at = shared_folder(spark, "audited")
        runs, jobs = raw_runs(spark, sf_dir)
        rows = runs.withColumn("file", F.floor(F.expr(RUN_KEY) / PER_FILE)).select("file", "dataflow_run_id", "status", "stage", "destination_rows_inserted", "source_rows_read", "duration_seconds", "event_time", (F.expr(RUN_KEY) % 97 == 0).alias("odd"))
        whole = F.col("destination_rows_inserted").cast("double")
        of = lambda k: rows.filter(F.col("file") % KINDS == k)
        kinds = [
            of(0).drop("odd").withColumn("_file_uri", F.lit("x")),
            of(1).drop("odd").withColumns({"destination_rows_inserted": whole, "extra": F.lit("x"), "transform_missing_column_policy": F.lit("keep")}),
            of(2).drop("stage").withColumns({"source_rows_read": F.when(~F.col("odd"), F.col("source_rows_read") + 0.0), "destination_rows_inserted": whole + F.when(F.col("odd"), 0.5).otherwise(0.0), "duration_seconds": F.col("duration_seconds").cast("int")}).drop("odd"),
            of(3).drop("odd").withColumns({"status": F.length("status"), "event_time": F.col("event_time").cast("timestamp_ntz")}),
        ]
        for k, df in enumerate(kinds):
            df.repartition("file").write.partitionBy("file").parquet(f"{at}/etl_logs/analyst/dataflow_run_log/kind={k}")
        line = F.to_json(F.struct(F.lit("job_run_log").alias("_type"), "job_id", "status", "duration_seconds", F.col("total_failed").alias("total_failed")))
        n = F.expr(JOB_KEY)
        at_odd = lambda name: n % ODD[name] == 1
        value = (
            F.when(at_odd("bad"), F.concat(F.lit('{"job_id": '), "job_id")).when(at_odd("blank"), "  ").when(at_odd("other"), '{"_type": "other", "x": 1}')
            .when(at_odd("text"), '{"_type": "job_run_log", "total_failed": "1", "status": null}').when(at_odd("note"), '{"_type": "job_run_log", "note": 1.5, "duration_seconds": 3}').when(at_odd("list"), '[1, "job_run_log"]').otherwise(line)
        )
        jobs.select(F.floor(n / PER_FILE).alias("file"), value.alias("value")).repartition("file").write.partitionBy("file").text(f"{at}/etl_logs/analyst/job_run_log")
        jobs.select(F.lit("not JSON").alias("value")).write.text(f"{at}/etl_logs/debug_json/job_run_log")
        _TREES[key] = (now, at)
    return _TREES[key][1]


def audited(spark: SparkSession, sf_dir: str) -> audit.Audit:
    return audit.audit_logs(spark, tree(spark, sf_dir), TARGET, suffix="txt")


def folder(path: str = "path") -> Column:
    """The number of a file, which Spark doesn't let us name."""
    return F.regexp_extract(path, r"/file=(\d+)/", 1).cast("long")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).findings.withColumn("path", folder())


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the copies of files that can be repaired hold: those of the second kind, as a tree with other findings is refused."""
    part, at, made = f"{tree(spark, sf_dir)}/etl_logs/analyst/dataflow_run_log/kind=1", shared_folder(spark, "repaired"), shared_folder(spark, "repairs")
    audit.repair_logs(spark, audit.audit_logs(spark, part, TARGET, suffix="txt"), at).write.parquet(made)
    rows = spark.read.schema("destination_rows_inserted bigint").parquet(at).select("destination_rows_inserted", F.col("_metadata.file_name").alias("name"))
    sums = rows.groupBy("name").agg(F.count("destination_rows_inserted").alias("values"), F.sum("destination_rows_inserted").alias("total"))
    repairs = spark.read.parquet(made).select(folder().alias("path"), F.array_join("columns", ",").alias("columns"), "rows", F.substring_index("repaired", "/", -1).alias("name"))
    return repairs.join(sums, "name").select("path", "columns", "rows", "values", "total")


JSON_TARGET = {f.name: f.dataType.simpleString() for f in JOB_RUN_SCHEMA}
_odd = lambda name: f"n % {ODD[name]} = 1"
#: Which line a job has, the first that holds, and its keys with their types.
LINES = "lines AS (SELECT n, n // {p} AS file, duration_seconds, total_failed, CASE {arms} ELSE 'full' END AS line FROM (SELECT *, CAST(job_id[5:] AS BIGINT) AS n FROM raw_jobs))".format(p=PER_FILE, arms=" ".join(f"WHEN {_odd(k)} THEN '{k}'" for k in ODD))
HELD = """held AS (SELECT file, '_type' AS c, 'str' AS k FROM lines WHERE line IN ('full', 'text', 'note') UNION ALL SELECT file, unnest(['job_id', 'status']), 'str' FROM lines WHERE line = 'full'
 UNION ALL SELECT file, 'duration_seconds', 'float' FROM lines WHERE line = 'full' AND duration_seconds IS NOT NULL UNION ALL SELECT file, 'total_failed', 'int' FROM lines WHERE line = 'full' AND total_failed IS NOT NULL
 UNION ALL SELECT file, 'total_failed', 'str' FROM lines WHERE line = 'text' UNION ALL SELECT file, 'status', 'null' FROM lines WHERE line = 'text' UNION ALL SELECT file, 'note', 'float' FROM lines WHERE line = 'note' UNION ALL SELECT file, 'duration_seconds', 'int' FROM lines WHERE line = 'note')"""
_NONE = "CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT)"


def _finding(category: str, kind: int, column: str, target: str | None, source: str, stats: str = _NONE) -> str:
    to = "CAST(NULL AS VARCHAR)" if target is None else f"'{target}'"
    return f"SELECT '{category}' AS category, 'dataflow_parquet' AS artifact_type, file AS path, '{column}' AS \"column\", {to} AS target_type, '{source}' AS source_type, 1 AS occurrences, {stats} FROM runs WHERE kind = {kind} GROUP BY file"


HALF = "(destination_rows_inserted + CASE WHEN n % 97 = 0 THEN 0.5 ELSE 0 END)"
READ = "CASE WHEN n % 97 <> 0 THEN CAST(source_rows_read AS DOUBLE) END"
RUNS = f"runs AS (SELECT *, file % {KINDS} AS kind FROM (SELECT *, n // {PER_FILE} AS file FROM (SELECT *, {RUN_KEY} AS n FROM raw_runs)))"
PARTS = [
    _finding("repairable", 1, "destination_rows_inserted", "bigint", "double", "COUNT(*) AS row_count, 0 AS invalid_count, MIN(CAST(destination_rows_inserted AS DOUBLE)) AS low, MAX(CAST(destination_rows_inserted AS DOUBLE)) AS high, 0 AS null_count"),
    _finding("unexpected", 1, "extra", None, "string"),
    _finding("ignored", 1, "transform_missing_column_policy", None, "string"),
    # a file is only whole if no run of it is odd
    _finding("CATEGORY", 2, "destination_rows_inserted", "bigint", "double", f"COUNT(*), COUNT(*) FILTER (n % 97 = 0), MIN({HALF}), MAX({HALF}), 0").replace("'CATEGORY'", "CASE WHEN COUNT(*) FILTER (n % 97 = 0) > 0 THEN 'incompatible' ELSE 'repairable' END"),
    _finding("repairable", 2, "source_rows_read", "bigint", "double", f"COUNT(*), 0, MIN({READ}), MAX({READ}), COUNT(*) - COUNT({READ})"),
    _finding("compatible", 2, "duration_seconds", "double", "int"),
    _finding("incompatible", 3, "status", "string", "int"),
    _finding("compatible", 3, "event_time", "timestamp", "timestamp_ntz"),
    "SELECT 'incompatible', 'job_jsonl', file, NULL, NULL, 'malformed', COUNT(*), NULL, NULL, NULL, NULL, NULL FROM lines WHERE line = 'bad' GROUP BY file",
    "SELECT 'unexpected', 'job_jsonl', file, 'note', NULL, 'float', COUNT(*), NULL, NULL, NULL, NULL, NULL FROM lines WHERE line = 'note' GROUP BY file",
    "SELECT 'incompatible', 'job_jsonl', file, 'total_failed', 'bigint', 'str', COUNT(*), NULL, NULL, NULL, NULL, NULL FROM lines WHERE line = 'text' GROUP BY file",
]
FOUND = f"{RUNS}, {LINES}, {HELD}, found AS ({' UNION ALL '.join(PARTS)})"
#: Columns of each kind of file and their types.
SHAPES = {
    0: {"dataflow_run_id": "string", "status": "string", "stage": "string", "destination_rows_inserted": "bigint", "source_rows_read": "bigint", "duration_seconds": "double", "event_time": "timestamp", "_file_uri": "string"},
    1: {"dataflow_run_id": "string", "status": "string", "stage": "string", "destination_rows_inserted": "double", "source_rows_read": "bigint", "duration_seconds": "double", "event_time": "timestamp", "extra": "string", "transform_missing_column_policy": "string"},
    2: {"dataflow_run_id": "string", "status": "string", "destination_rows_inserted": "double", "source_rows_read": "double", "duration_seconds": "int", "event_time": "timestamp"},
    3: {"dataflow_run_id": "string", "status": "int", "stage": "string", "destination_rows_inserted": "bigint", "source_rows_read": "bigint", "duration_seconds": "double", "event_time": "timestamp_ntz"},
}
SHAPE = "shape AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{c}', '{t}')" for k, cs in SHAPES.items() for c, t in cs.items()) + ") v(kind, c, t)), flows AS (SELECT DISTINCT file, kind FROM runs)"
COLUMNS = f"""SELECT 'dataflow_parquet' AS artifact_type, c AS "column", 'type ' || t AS what, COUNT(*) AS count FROM flows JOIN shape USING (kind) GROUP BY ALL
 UNION ALL SELECT 'dataflow_parquet', w, 'missing', COUNT(*) FROM flows f, (SELECT unnest({[f.name for f in TARGET]}) AS w) WHERE NOT EXISTS (SELECT 1 FROM shape s WHERE s.kind = f.kind AND c = w) GROUP BY ALL
 UNION ALL SELECT 'job_jsonl', w, 'missing', (SELECT COUNT(*) FROM held WHERE c = '_type') - (SELECT COUNT(*) FROM held WHERE c = w) AS k FROM (SELECT unnest({list(JSON_TARGET)}) AS w) WHERE k > 0
 UNION ALL SELECT artifact_type, "column", category, CAST(SUM(occurrences) AS BIGINT) FROM found WHERE category IN ('ignored', 'unexpected') GROUP BY ALL"""
TOTALS = "SELECT (SELECT COUNT(*) FROM flows) AS parquet_files, (SELECT COUNT(DISTINCT file) FROM lines) AS job_jsonl_files, (SELECT COUNT(*) FROM held WHERE c = '_type') AS job_records, (SELECT COUNT(*) FROM lines WHERE line = 'bad') AS malformed_job_lines, " + ", ".join(f"CAST(COALESCE(SUM(occurrences) FILTER (category = '{c}'), 0) AS BIGINT) AS {c}_count" for c in ("compatible", "ignored", "incompatible", "repairable", "unexpected")) + " FROM found"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "i15_schema_audit": (findings, f"{FOUND} SELECT * FROM found"),
    "i15_audit_columns": (lambda spark, sf_dir: audited(spark, sf_dir).columns, f"{FOUND}, {SHAPE} {COLUMNS}"),
    "i15_audit_totals": (lambda spark, sf_dir: audited(spark, sf_dir).totals, f"{FOUND}, {SHAPE} {TOTALS}"),
    "i16_repaired_files": (repaired, f"{RUNS} SELECT file AS path, 'destination_rows_inserted' AS columns, COUNT(*) AS rows, COUNT(destination_rows_inserted) AS values, CAST(SUM(destination_rows_inserted) AS BIGINT) AS total FROM runs WHERE kind = 1 GROUP BY 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: make for name, (make, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: f"{oracle_facts()}, {sql}" for name, (_, sql) in QUERIES.items()}
