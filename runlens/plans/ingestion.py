"""Registered ingestion queries over file listings derived from `events`."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bucket, bucket_end, bucket_label, name_uuid, rendered
from ..functions.graph import settled, shared_folder
from ..operators import facts
from ..sources import logs
from ..sources.derived import oracle_facts, raw_runs

#: One file for each event; the layout depends on the source.
FILES = """SELECT CAST(event_id % 3 + 1 AS BIGINT) AS _source_id, event_id, user_id, event_type, value, CAST(ts AS TIMESTAMP) AS ts,
  CASE event_id % 3 WHEN 0 THEN 'logs/__run_date=' || {day} WHEN 1 THEN 'logs/' || {hour} ELSE 'logs/' || {month} END || '/part-' || CAST(event_id AS {text}) || '.parquet' AS uri,
  CAST(event_id % 5 AS BIGINT) AS revision, CAST(1000 + event_id % 977 AS BIGINT) AS size FROM {table}"""
MANIFEST = "SELECT _source_id, uri, ts AS modified, size, CASE WHEN event_id % 7 = 0 THEN revision + 1 ELSE revision END AS revision, {value} AS partition_value FROM files WHERE event_id % 4 <> 0"
VALUE = "CASE event_id % 3 WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN date_trunc('hour', ts) ELSE date_trunc('month', ts) END"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = lambda f: f"date_format(ts, \"{f}\")"
    return spark.sql(FILES.format(day=fmt("yyyy-MM-dd"), hour=fmt("yyyy/MM/dd/HH"), month=fmt("'y'yyyy'/m'MM"), text="STRING", table=f"parquet.`{sf_dir}/events.parquet`"))


def oracle_files() -> str:
    fmt = lambda f: f"strftime(ts, '{f}')"
    return "WITH files AS (" + FILES.format(day=fmt("%Y-%m-%d"), hour=fmt("%Y/%m/%d/%H"), month=fmt("y%Y/m%m"), text="VARCHAR", table="events") + f"), manifest AS ({MANIFEST.format(value=f'CAST({VALUE} AS TIMESTAMP)')}), bounds AS (SELECT CAST(date_trunc('day', MAX(ts)) AS TIMESTAMP) AS hi FROM files)"


def manifest(df: DataFrame) -> DataFrame:
    value = F.when(F.col("event_id") % 3 == 0, F.date_trunc("day", "ts")).when(F.col("event_id") % 3 == 1, F.date_trunc("hour", "ts")).otherwise(F.date_trunc("month", "ts"))
    return df.filter("event_id % 4 <> 0").select("_source_id", "uri", F.col("ts").alias("modified"), "size", (F.col("revision") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).alias("revision"), value.alias("partition_value"))


def planned(df: DataFrame) -> DataFrame:
    parsed = logs.parse_partition_path(df, "uri")
    last = df.agg(F.date_trunc("day", F.max("ts")).alias("t")).first()["t"]
    return logs.plan_incremental(parsed, manifest(df), str(last), "2100-01-01 00:00:00")


def two_batches(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A root for each shape of directories. The first batch lacks the last three days and each 50th file; the second finds all, and looks back at two days."""
    listed = settled(logs.parse_partition_path(df, "uri").select(F.concat(F.lit("root-"), (F.col("event_id") % 3).cast("string")).alias("root"), "event_id", "uri", "revision", F.col("ts").alias("modified"), "granularity", "partition_value"))
    last = df.agg(F.max("ts").alias("t")).first()["t"]
    days = lambda n: str(last - timedelta(days=n))
    early = listed.filter((F.col("modified") <= F.to_timestamp(F.lit(days(3)))) & (F.col("event_id") % 50 != 0)).drop("event_id")
    none = df.sparkSession.createDataFrame([], "root string, checkpoint timestamp, boundary_modified timestamp, last_scanned timestamp")
    loaded, state = logs.plan_partitions(early, early.select("uri", "revision").limit(0), none, days(3))
    loaded, state = settled(loaded), settled(state)
    return logs.plan_partitions(listed.drop("event_id"), loaded, state, str(last), (days(40)[:10], days(39)[:10]))


ROUND = "%Y-%m-%d %H:%M:%S"
GRAIN = "CASE event_id % 3 WHEN 0 THEN date_trunc('day', {0}) WHEN 1 THEN date_trunc('hour', {0}) ELSE date_trunc('month', {0}) END"
BATCHES = f"""hi2 AS (SELECT MAX(ts) AS t FROM files), fl2 AS (SELECT 'root-' || event_id % 3 AS root, event_id, uri, revision, ts, CAST({VALUE} AS TIMESTAMP) AS v, CAST({GRAIN.format('t')} AS TIMESTAMP) AS cur, CAST({GRAIN.format("(t - INTERVAL 3 DAY)")} AS TIMESTAMP) AS cur1, t FROM files, hi2),
 b1 AS (SELECT * FROM fl2 WHERE ts <= t - INTERVAL 3 DAY AND event_id % 50 <> 0), s1 AS (SELECT root, MAX(v) AS cp, GREATEST(MAX(v), MAX(cur1)) AS ls, arg_max(ts, struct_pack(v, ts)) AS bm FROM b1 GROUP BY 1),
 w2 AS (SELECT f.*, cp, ls, bm, CASE WHEN v BETWEEN ls AND cur OR v = cp OR (event_id % 3 = 1 AND v = cur - INTERVAL 1 HOUR) THEN 'incremental'
   WHEN v BETWEEN CASE WHEN event_id % 3 = 2 THEN date_trunc('month', t - INTERVAL 40 DAY) ELSE date_trunc('day', t - INTERVAL 40 DAY) END AND CASE event_id % 3 WHEN 2 THEN date_trunc('month', t - INTERVAL 39 DAY) WHEN 0 THEN date_trunc('day', t - INTERVAL 39 DAY) ELSE date_trunc('day', t - INTERVAL 39 DAY) + INTERVAL 23 HOUR END THEN 'lookback' END AS via FROM fl2 f JOIN s1 USING (root)),
 p2 AS (SELECT * FROM w2 WHERE via IS NOT NULL AND uri NOT IN (SELECT uri FROM b1)),
 n2 AS (SELECT root, GREATEST(MAX(cp), MAX(v) FILTER (via = 'incremental')) AS checkpoint, GREATEST(MAX(bm), arg_max(ts, struct_pack(v, ts)) FILTER (via = 'incremental')) AS boundary_modified, GREATEST(MAX(ls), MAX(cur), MAX(cp)) AS last_scanned FROM w2 GROUP BY 1)"""


def sources(df: DataFrame) -> DataFrame:
    """One source for each user: an environment, whether it is found and synchronised."""
    return df.select("user_id").distinct().select(F.col("user_id").alias("_source_id"), F.concat(F.lit("env-"), (F.col("user_id") % 4).cast("string")).alias("environment"), F.when(F.col("user_id") % 5 != 4, F.col("user_id") % 7 != 0).alias("found"), (F.col("user_id") % 11 != 0).alias("sync_ok"))


def freshness(df: DataFrame) -> DataFrame:
    s = sources(df)
    loaded = df.filter("user_id % 3 <> 0").select(F.col("user_id").alias("_source_id"))
    return logs.source_freshness(s.select("environment", "_source_id"), s.select("_source_id", "found", "sync_ok"), loaded)


FRESH = "src AS (SELECT DISTINCT user_id, 'env-' || CAST(user_id % 4 AS VARCHAR) AS environment, CASE WHEN user_id % 5 <> 4 THEN user_id % 7 <> 0 END AS found, user_id % 11 <> 0 AS sync_ok, user_id % 3 <> 0 AS loaded FROM files), fr AS (SELECT environment, user_id AS _source_id, CASE WHEN found = false THEN 'missing' WHEN NOT sync_ok THEN 'sync_failed' WHEN NOT loaded THEN 'not_cached' WHEN found IS NULL THEN 'unknown' ELSE 'current' END AS status FROM src)"
PLAN = f"plan AS (SELECT f._source_id, f.uri, f.revision FROM files f, bounds WHERE CAST({VALUE} AS TIMESTAMP) >= hi - INTERVAL 1 HOUR AND NOT EXISTS (SELECT 1 FROM manifest m WHERE m.uri = f.uri AND m.revision = f.revision))"


def replaced(df: DataFrame) -> DataFrame:
    """Rows of every 10th file are replaced by ones with twice the value."""
    rows = df.select("_source_id", F.col("uri").alias("_file_uri"), "event_id", "value")
    return logs.replace_by_file(rows, rows.filter("event_id % 10 = 0").withColumn("value", F.col("value") * 2))


def conformed(df: DataFrame) -> DataFrame:
    raw = df.select("event_id", F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("end_time"), F.date_format(F.col("ts") - F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd HH:mm:ss").alias("start_time"), F.when(F.col("event_id") % 3 == 0, F.to_date("ts")).alias("__run_date"))
    return logs.conform_runs(raw).drop("end_time", "start_time")


def retained(df: DataFrame) -> DataFrame:
    runs = df.select((F.col("user_id") % 20).alias("_source_id"), F.col("event_id").alias("run_id"), F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("finished_at"))
    return logs.retention_candidates(runs, "2100-01-01 00:00:00")


QUERIES: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "h18_name_uuid": (lambda df: df.select("event_type").distinct().select("event_type", name_uuid("event_type").alias("uuid")), "SELECT event_type, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lower(printf('%x', CAST('0x' || h[17:18] AS INTEGER) % 64 + 128)) || h[19:20] || '-' || h[21:32] AS uuid FROM (SELECT DISTINCT event_type, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(event_type)) AS h FROM files)"),
    "i04_parse_partition_path": (lambda df: logs.parse_partition_path(df.select("event_id", "uri"), "uri").drop("uri", "partition_format"), f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'hour' ELSE 'month' END AS granularity, strftime({VALUE}, '{ROUND}') AS partition_value FROM files"),
    "i05_partition_layout": (lambda df: logs.partition_layout_check(logs.parse_partition_path(df.withColumn("root", F.concat(F.lit("root-"), (F.col("event_id") % 6 % 4).cast("string"))), "uri"), "root").drop("format"), "SELECT 'root-' || CAST(event_id % 6 % 4 AS VARCHAR) AS root, COUNT(DISTINCT event_id % 3) AS formats, COUNT(*) AS files, CASE WHEN COUNT(DISTINCT event_id % 3) > 1 THEN 'mixed' ELSE 'ok' END AS layout FROM files GROUP BY 1"),
    "z03_late_partitions": (lambda df: two_batches(df)[0].select("root", "uri", "revision", "via"), f"{BATCHES} SELECT root, uri, revision, via FROM p2"),
    "z03_next_state": (lambda df: two_batches(df)[1], f"{BATCHES} SELECT root, " + ", ".join(f"strftime({c}, '{ROUND}') AS {c}" for c in ("checkpoint", "boundary_modified", "last_scanned")) + " FROM n2"),
    "i06_plan_incremental": (lambda df: planned(df).select("_source_id", "uri", "revision"), f"{PLAN} SELECT * FROM plan"),
    "i07_conform_runs": (conformed, f"SELECT event_id, strftime(CASE WHEN event_id % 4 = 0 THEN ts ELSE ts - INTERVAL 2 HOUR END, '{ROUND}') AS event_time, CAST(CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) ELSE CAST(CASE WHEN event_id % 4 = 0 THEN ts ELSE ts - INTERVAL 2 HOUR END AS DATE) END AS VARCHAR) AS run_date FROM files"),
    "i09_lossless_integers": (lambda df: logs.lossless_integer_check(df.withColumn("rounded", F.floor("value").cast("double")), ["value", "rounded"]), "SELECT 'value' AS \"column\", COUNT(value) AS values, COUNT(*) FILTER (value <> floor(value)) AS lossy, MIN(value) AS low, MAX(value) AS high FROM files UNION ALL SELECT 'rounded', COUNT(value), 0, MIN(floor(value)), MAX(floor(value)) FROM files"),
    "i10_replace_by_file": (replaced, "SELECT _source_id, uri AS _file_uri, event_id, CASE WHEN event_id % 10 = 0 THEN value * 2 ELSE value END AS value FROM files"),
    "i11_pending_changes": (lambda df: logs.pending_changes(planned(df), df.select("_source_id").distinct()), f"{PLAN} SELECT s._source_id, EXISTS (SELECT 1 FROM plan p WHERE p._source_id = s._source_id) AS pending FROM (SELECT DISTINCT _source_id FROM files) s"),
    "i12_revision_summary": (lambda df: logs.source_revision_summary(manifest(df)), f"SELECT _source_id, COUNT(*) AS files, strftime(MAX(modified), '{ROUND}') AS latest, CAST(SUM(size) AS BIGINT) AS size FROM manifest GROUP BY 1"),
    "i13_source_freshness": (freshness, f"{FRESH} SELECT * FROM fr"),
    "i13_environment_freshness": (lambda df: logs.environment_freshness(freshness(df)), f"{FRESH} SELECT environment, arg_min(status, list_position(['missing','sync_failed','not_cached','unknown','current'], status)) AS status, COUNT(*) AS sources FROM fr GROUP BY 1"),
    "i14_purge_sources": (lambda df: logs.purge_sources(df.select("_source_id", "event_id"), df.select("_source_id").distinct().filter("_source_id = 2")), "SELECT _source_id, event_id FROM files WHERE _source_id <> 2"),
    "i18_retention_candidates": (retained, f"SELECT _source_id, run_id, strftime(finished_at, '{ROUND}') AS finished_at FROM (SELECT user_id % 20 AS _source_id, event_id AS run_id, ts AS finished_at FROM files WHERE event_id % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) > 100)"),
}


def log_folder(spark: SparkSession, sf_dir: str) -> str:
    """Log directories made of the star schema, once a session: dataflow runs in two Parquet shapes, job runs as JSON lines, metadata documents."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOGS:
        at = shared_folder(spark, "logs")
        runs, jobs = raw_runs(spark, sf_dir)
        wanted = runs.select("dataflow_run_id", "status", "destination_rows_inserted", F.split_part("dataflow_run_id", F.lit("-"), F.lit(1)).cast("long").alias("n"))
        wanted.filter("n % 2 = 0").drop("n").write.parquet(f"{at}/flows/dt=2024-01-01")
        wanted.filter("n % 2 = 1").withColumn("extra", F.lit("x")).drop("n", "destination_rows_inserted").write.parquet(f"{at}/flows/dt=2024-01-02")
        line = F.to_json(F.struct("job_id", "status", "total_failed"))
        n = F.substring("job_id", 5, 20).cast("long")
        jobs.select(F.when(n % 50 == 0, F.concat(F.lit('{"job_id": '), "job_id")).when(n % 51 == 1, F.lit("  ")).otherwise(line).alias("value")).write.text(f"{at}/jobs/__run_date=2024-01-01")
        supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") % 7).alias("k"), F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).alias("r"))
        supplier.groupBy("k").agg(F.to_json(F.struct(F.collect_list("r").alias("connections"))).alias("value")).write.partitionBy("k").text(f"{at}/metadata")
        _LOGS[key] = at
    return _LOGS[key]


_LOGS: dict[tuple[str, str], str] = {}


def read_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.read_dataflow_runs(spark, [f"{log_folder(spark, sf_dir)}/flows"], 7).select("dataflow_run_id", "status", "destination_rows_inserted", "extra", "_source_id", "_file_kind", (F.col("_source_size") > 0).alias("sized"))


def read_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.read_job_runs(spark, [f"{log_folder(spark, sf_dir)}/jobs"], 3)[0].select("job_id", "status", "total_failed", "_source_id", "_file_kind")


def bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.read_job_runs(spark, [f"{log_folder(spark, sf_dir)}/jobs"], 3)[1].select("line", "code")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.from_json("record", "name string, nation long")
    return logs.read_metadata(spark, [f"{log_folder(spark, sf_dir)}/metadata/k={k}" for k in range(7)]).select("section", record["name"].alias("name"), record["nation"].alias("nation"))


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("event_id", F.floor("value").cast("double").alias("whole"))
    return logs.schema_repair(rows, ["whole"])


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_runs(spark, sf_dir)[1]
    made, at = facts.build_job_facts(raw), shared_folder(spark, "published")
    logs.publish(made, facts.validate_facts(raw, made), at)
    return spark.read.parquet(at).groupBy(F.col("run_date").cast("date").alias("run_date")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("job_id").alias("jobs"))


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job runs with the columns of the log's schema that they lack."""
    wide = facts.pad_missing(raw_runs(spark, sf_dir)[1].select("job_id", "status"), logs.JOB_RUN_SCHEMA)
    return wide.select("job_id", "status", "stages", "total_rows_read", "duration_seconds")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    parts = [rows.select(F.lit(g).alias("grain"), bucket_label(bucket("ts", g), g).alias("label"), bucket_end(bucket("ts", g), g).alias("ends")).groupBy("grain", "label", "ends").agg(F.count(F.lit(1)).alias("rows")) for g in ("hour", "day", "week", "month")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


LABELS = {"hour": "%Y-%m-%d %H:00", "day": "%Y-%m-%d", "week": "%G-W%V", "month": "%Y-%m"}
STEPS = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}
FLOW_NUMBER, JOB_NUMBER = "CAST(split_part(dataflow_run_id, '-', 1) AS BIGINT)", "CAST(job_id[5:] AS BIGINT)"
ON_LOGS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "i01_read_dataflow_runs": (read_flows, f"SELECT dataflow_run_id, status, CASE WHEN {FLOW_NUMBER} % 2 = 0 THEN destination_rows_inserted END AS destination_rows_inserted, CASE WHEN {FLOW_NUMBER} % 2 = 1 THEN 'x' END AS extra, 7 AS _source_id, 'dataflow_parquet' AS _file_kind, true AS sized FROM raw_runs"),
    "i02_read_job_runs": (read_jobs, f"SELECT job_id, status, total_failed, 3 AS _source_id, 'job_jsonl' AS _file_kind FROM raw_jobs WHERE {JOB_NUMBER} % 50 <> 0 AND {JOB_NUMBER} % 51 <> 1"),
    "i02_bad_job_lines": (bad_lines, f"SELECT '{{\"job_id\": ' || job_id AS line, 'invalid_jsonl' AS code FROM raw_jobs WHERE {JOB_NUMBER} % 50 = 0"),
    "i16_schema_repair": (repaired, "SELECT event_id, CAST(floor(value) AS BIGINT) AS whole FROM events"),
    "i19_published_facts": (published, "SELECT CAST(run_date AS VARCHAR) AS run_date, COUNT(*) AS rows, COUNT(DISTINCT job_id) AS jobs FROM jf GROUP BY 1"),
    "i20_read_metadata": (read_documents, "SELECT 'connections' AS section, s_name AS name, s_nationkey AS nation FROM supplier"),
    "f03_pad_missing": (padded, "SELECT job_id, status, CAST(NULL AS VARCHAR) AS stages, CAST(NULL AS BIGINT) AS total_rows_read, CAST(NULL AS DOUBLE) AS duration_seconds FROM raw_jobs"),
    "h08_bucket_labels": (labelled, " UNION ALL ".join(f"SELECT '{g}' AS grain, strftime(date_trunc('{g}', CAST(ts AS TIMESTAMP)), '{f}') AS label, strftime(date_trunc('{g}', CAST(ts AS TIMESTAMP)) + {STEPS[g]}, '{ROUND}') AS ends, COUNT(*) AS rows FROM events GROUP BY ALL" for g, f in LABELS.items())),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {n: (lambda make: lambda spark, sf_dir: rendered(make(files(spark, sf_dir))))(make) for n, (make, _) in QUERIES.items()}
    return own | {n: (lambda make: lambda spark, sf_dir: rendered(make(spark, sf_dir)))(make) for n, (make, _) in ON_LOGS.items()}


def oracle_sql() -> dict[str, str]:
    start = oracle_files()
    own = {n: f"{start}, {sql}" if sql.startswith(("plan AS", "src AS", "hi2 AS")) else f"{start} {sql}" for n, (_, sql) in QUERIES.items()}
    return own | {n: f"{oracle_facts()} {sql}" for n, (_, sql) in ON_LOGS.items() if sql}
