"""Run facts derived from the star schema, for queries over tables that hold no run logs.

The same expressions are used by both engines: they are standard SQL but for adding to times and dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-11-05 00:00:00"
#: Error messages by key.
MESSAGES = ["HTTP 429 Too Many Requests for run 123", "403 Forbidden", "OutOfMemoryError in task 7", "DELTA_CONCURRENT_APPEND on table t1", "ModuleNotFoundError: No module named x", "cannot cast 'abc' to INT at 2026-07-28T07:36:28Z", "table sales.orders does not exist", "connection refused by 550e8400-e29b-41d4-a716-446655440000", "read timed out after 30 s", "a;b;c", "None", "something odd happened"]


def _message(key: str) -> str:
    quoted = [m.replace("'", "''") for m in MESSAGES]
    return f"CASE {key} % 12 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(quoted)) + " END"


def _case(key: str, *values: str | None) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


def facts_sql(orders: str, lineitem: str, spark: bool) -> tuple[str, str]:
    """(dataflow runs, job runs) as SELECT statements."""
    plus = (lambda ts, n: f"timestampadd(SECOND, {n}, CAST({ts} AS TIMESTAMP))") if spark else (lambda ts, n: f"(CAST({ts} AS TIMESTAMP) + to_seconds({n}))")
    day = (lambda ts, n: f"date_add(CAST({ts} AS DATE), {n})") if spark else (lambda ts, n: f"(CAST({ts} AS DATE) + {n})")
    big = "CAST(FLOOR({}) AS BIGINT)".format
    failed, phase = "(l_partkey + l_linenumber) % 20 = 0", "l_partkey % 4"
    text = lambda x: f"CAST({x} AS STRING)" if spark else f"CAST({x} AS VARCHAR)"
    error = _message("l_partkey")
    runs = f"""SELECT l_orderkey % 3 + 1 AS _source_id,
      CASE WHEN l_partkey % 101 <> 0 THEN 'job-' || {text('l_orderkey')} END AS job_id,
      CASE WHEN l_partkey % 211 = 0 THEN 'unknown' ELSE 'df-' || {text('l_partkey % 130')} END AS dataflow_id,
      CASE WHEN l_suppkey % 29 = 0 THEN '' ELSE 'flow ' || {text('l_partkey % 130')} END AS dataflow_name,
      {text('l_orderkey')} || '-' || {text('l_linenumber')} || '-' || {text('l_partkey')} || '-' || {text('l_suppkey')} || '-' || {text('CAST(ROUND(l_extendedprice * 100) AS BIGINT)')} AS dataflow_run_id,
      {_case('l_suppkey % 5', 'bronze', 'silver', 'gold', 'quality', '')} AS stage,
      CASE l_partkey % 20 WHEN 0 THEN 'maintenance' WHEN 1 THEN 'replay' WHEN 2 THEN '' ELSE 'etl' END AS operation_type,
      CASE (l_partkey + l_linenumber) % 20 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'running' WHEN 3 THEN 'pending' WHEN 4 THEN 'Succeeded ' ELSE 'succeeded' END AS status,
      CASE WHEN l_partkey % 499 <> 0 THEN {plus('l_shipdate', '(l_partkey * 31 + l_linenumber * 977 + l_suppkey) % 86400')} END AS event_time,
      CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN {day('l_shipdate', 1)} ELSE {day('l_shipdate', 0)} END AS __run_date,
      CASE WHEN l_partkey % 151 <> 0 THEN 'logs/' || {text('l_orderkey % 3')} || '/part-' || {text('l_partkey % 40')} END AS _file_uri, 'parquet' AS _file_kind, {plus('l_shipdate', '86400 + l_partkey % 3600')} AS _ingested_at,
      'ws-' || {text('l_suppkey % 3')} AS workspace_id, CASE WHEN l_suppkey % 10 < 8 THEN 'loads ' || {text('l_partkey % 130')} ELSE '' END AS dataflow_description, CAST(l_partkey % 4 AS BIGINT) AS group_number, CAST(l_linenumber AS BIGINT) AS execution_order,
      {_case('l_suppkey % 3', 'batch', 'stream', '')} AS processing_mode, l_partkey % 10 <> 0 AS is_active,
      CASE WHEN l_suppkey % 4 < 2 THEN 'raw' ELSE '' END AS source_schema, 'in' || {text('l_suppkey % 12')} AS source_table, CASE WHEN l_suppkey % 4 = 0 THEN '`lake`.`raw`.`in' || {text('l_suppkey % 12')} || '`' END AS source_full_table, '/mnt/in/spark' || {text('l_suppkey % 9')} AS source_path,
      CASE WHEN l_suppkey % 5 = 1 THEN 'amount > ' || {text('l_linenumber')} END AS transform_filter_expression, {_case('l_partkey % 4', '["id"]', '', '["id", "day"]', None)} AS destination_merge_keys,
      CAST(2 + l_partkey % 30 AS DOUBLE) AS source_duration_seconds, CAST(3 + l_suppkey % 40 AS DOUBLE) AS transform_duration_seconds, CAST(4 + l_linenumber * 5 AS DOUBLE) AS destination_duration_seconds,
      CASE WHEN l_partkey % 307 <> 0 THEN CAST((9 + l_partkey % 30 + l_suppkey % 40 + l_linenumber * 5 + l_orderkey % 7) * CASE WHEN l_partkey % 83 = 0 THEN 25 ELSE 1 END AS DOUBLE) END AS duration_seconds,
      CASE WHEN l_orderkey % 2 <> 0 THEN CAST(l_orderkey % 7 AS DOUBLE) END AS overhead_duration_seconds,
      'source-' || {text('l_suppkey % 12')} AS source_name, CASE WHEN l_linenumber = 7 THEN '' ELSE 'destination-' || {text('l_partkey % 9')} END AS destination_name,
      {_case('l_suppkey % 4', 'database', 'file', 'file', 'api')} AS source_connection_type, {_case('l_suppkey % 4', 'sql', 'csv', 'parquet', 'json')} AS source_format,
      {_case('l_suppkey % 3', 'lakehouse', 'database', None)} AS destination_connection_type, {_case('l_suppkey % 3', 'delta', 'sql', 'unknown')} AS destination_format,
      CASE WHEN l_suppkey % 6 = 2 THEN '/mnt/lakehouse/t' ELSE '/mnt/files/t' END || {text('l_partkey % 25')} AS destination_path,
      't' || {text('l_partkey % 25')} AS destination_table, CASE WHEN l_partkey % 5 <> 0 THEN 'cat.db.t' || {text('l_partkey % 25')} END AS destination_full_table,
      {_case('l_partkey % 4', 'merge', 'append', 'overwrite', None)} AS destination_load_type,
      CASE WHEN l_partkey % 20 = 0 THEN {_case('l_suppkey % 4', 'compact', 'cleanup', None, None)} END AS destination_operation_type,
      {big('l_quantity * 100')} AS source_rows_read, CASE WHEN l_suppkey % 3 = 0 THEN {big('l_quantity * 90')} END AS destination_rows_written,
      {big('l_quantity * 60')} AS destination_rows_inserted, {big('l_quantity * 20')} AS destination_rows_updated, {big('l_quantity * 10')} AS destination_rows_deleted,
      {big('l_extendedprice')} AS destination_bytes_added, {big('l_extendedprice * l_discount')} AS destination_bytes_removed, {big('l_extendedprice * l_tax')} AS destination_bytes_saved,
      1 + l_partkey % 8 AS destination_files_added, l_partkey % 3 AS destination_files_removed,
      CASE WHEN {failed} AND {phase} = 0 THEN 'failed' ELSE 'succeeded' END AS source_status, CASE WHEN {failed} AND {phase} = 1 THEN 'failed' ELSE 'succeeded' END AS transform_status, CASE WHEN {failed} AND {phase} = 2 THEN 'failed' ELSE 'succeeded' END AS destination_status,
      CASE WHEN {failed} AND {phase} = 0 THEN {error} END AS source_error_message, CASE WHEN {failed} AND {phase} = 1 THEN {error} END AS transform_error_message, CASE WHEN {failed} AND {phase} = 2 THEN {error} END AS destination_error_message,
      CASE WHEN {failed} AND {phase} = 3 THEN {error} END AS error_message,
      CASE WHEN l_partkey % 5 <> 4 THEN '["updated_at"]' END AS source_watermark_columns,
      CASE WHEN l_partkey % 5 >= 3 THEN NULL WHEN l_suppkey % 41 = 0 THEN '{{"v": ' ELSE '{{"v": ' || {text('l_partkey % 50')} || '}}' END AS source_watermark_before,
      CASE WHEN l_partkey % 5 <> 4 THEN '{{"v": ' || {text('l_partkey % 50 + l_linenumber % 3')} || '}}' END AS source_watermark_after,
      CASE WHEN l_partkey % 5 <> 4 THEN '{{"v": ' || {text('l_partkey % 50 + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END')} || '}}' END AS source_watermark_effective
    FROM {lineitem}"""
    kids = f"SELECT l_orderkey AS k, COUNT(*) AS n, COUNT(CASE WHEN (l_partkey + l_linenumber) % 20 = 0 THEN 1 END) AS f, COUNT(CASE WHEN (l_partkey + l_linenumber) % 20 = 1 THEN 1 END) AS s, COUNT(CASE WHEN (l_partkey + l_linenumber) % 20 >= 4 THEN 1 END) AS ok FROM {lineitem} WHERE l_partkey % 101 <> 0 GROUP BY l_orderkey"
    off = lambda c: f"CASE WHEN o_orderkey % 17 <> 0 THEN COALESCE({c}, 0) + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END END"
    jobs = f"""SELECT o_orderkey % 3 + 1 AS _source_id, 'job-' || {text('o_orderkey')} AS job_id,
      CASE WHEN o_orderkey % 100 = 3 THEN 'running' WHEN o_orderkey % 100 = 4 THEN 'pending' WHEN o_orderkey % 10 = 0 THEN 'failed' WHEN o_orderkey % 10 = 1 THEN 'skipped' WHEN o_orderkey % 10 = 2 THEN ' SUCCEEDED ' ELSE 'succeeded' END AS status,
      {plus('o_orderdate', 'o_orderkey * 7919 % 86400')} AS event_time,
      CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN {day('o_orderdate', -1)} ELSE {day('o_orderdate', 0)} END AS __run_date,
      CASE WHEN o_orderkey % 29 <> 0 THEN 'logs/' || {text('o_orderkey % 3')} || CASE WHEN o_orderkey % 4 = 0 THEN '/part-' ELSE '/job-' END || {text('o_custkey % 50')} END AS _file_uri, CASE WHEN o_orderkey % 4 = 0 THEN 'parquet' ELSE 'jsonl' END AS _file_kind, {plus('o_orderdate', '90000 + o_custkey % 3600')} AS _ingested_at,
      CASE WHEN o_orderkey % 53 <> 0 THEN CAST(30 + o_orderkey % 120 AS DOUBLE) END AS duration_seconds,
      {_case('o_custkey % 3', 'DuckDBEngine', 'SparkEngine', '')} AS engine_name, {_case('o_custkey % 2', 'FileProvider', 'DatabaseProvider')} AS metadata_provider_name,
      CASE WHEN o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%' THEN 'LocalPlatform' ELSE 'CloudPlatform' END AS platform_name,
      {_case('o_orderkey % 2', '["bronze", "silver"]', 'gold,quality')} AS stages, {_case('o_orderkey % 4', 'etl', '["etl", "maintenance"]', 'etl,maintenance', None)} AS operation_types,
      {off('k.n')} AS total_dataflows, {off('k.f')} AS total_failed, {off('k.s')} AS total_skipped, {off('k.ok')} AS total_succeeded, o_orderkey % 3 AS total_running, o_orderkey % 2 AS total_pending,
      {big('o_totalprice')} AS total_rows_read, {big('o_totalprice * 0.9')} AS total_rows_written,
      CASE WHEN o_orderkey % 10 = 0 AND o_orderkey % 100 NOT IN (3, 4) THEN {_message('o_orderkey')} END AS error_message
    FROM {orders} o LEFT JOIN ({kids}) k ON k.k = o.o_orderkey WHERE o_orderkey % 97 <> 0"""
    return runs, jobs


def raw_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(dataflow runs, job runs) before facts are built. Tables that are read in fewer parts than there are cores are spread over all of them first."""
    n = spark.sparkContext.defaultParallelism

    def table(name: str) -> str:
        at = f"{sf_dir}/{name}.parquet"
        few = spark.read.parquet(at).rdd.getNumPartitions() < n
        return f"(SELECT /*+ REPARTITION({n}) */ * FROM parquet.`{at}`)" if few else f"parquet.`{at}`"

    runs, jobs = facts_sql(table("orders"), table("lineitem"), True)
    return spark.sql(runs), spark.sql(jobs)


def oracle_facts() -> str:
    """The CTEs `df` (dataflow facts) and `jf` (job facts) for DuckDB."""
    runs, jobs = facts_sql("orders", "lineitem", False)
    status = "LOWER(COALESCE(NULLIF(TRIM(status), ''), 'unknown'))"
    date = "COALESCE(__run_date, CAST(event_time AS DATE))"
    return f"""WITH raw_runs AS ({runs}), raw_jobs AS ({jobs}),
    jf AS (SELECT *, {status} AS normalized_status, {date} AS run_date FROM raw_jobs),
    context AS (SELECT _source_id, job_id, ANY_VALUE(engine_name) AS engine_name, ANY_VALUE(metadata_provider_name) AS metadata_provider_name, ANY_VALUE(platform_name) AS platform_name FROM jf GROUP BY ALL),
    df AS (SELECT r.*, {status} AS normalized_status, {date} AS run_date,
      COALESCE(NULLIF(c.engine_name, ''), 'unknown') AS engine_name, COALESCE(NULLIF(c.metadata_provider_name, ''), 'unknown') AS metadata_provider_name, COALESCE(NULLIF(c.platform_name, ''), 'unknown') AS platform_name
      FROM raw_runs r LEFT JOIN context c ON c._source_id = r._source_id AND c.job_id = r.job_id)"""
