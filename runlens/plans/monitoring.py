"""Registered monitoring queries: a name, how it is made from facts, and the same in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import diagnostics, durations, facts, failures, freshness, jobs, lineage, maintenance, overview, performance, scope, volume
from ..sources.derived import AS_OF, oracle_facts, raw_runs
from . import sqltext as S

Make = Callable[[DataFrame, DataFrame], DataFrame]
QUERIES: dict[str, tuple[Make, str | None]] = {}
NOW = dt.datetime.fromisoformat(AS_OF)


def add(name: str, make: Make, sql: str | None, ctes: str = "") -> None:
    QUERIES[name] = (make, None if sql is None else ", ".join(["FACTS", *([ctes] if ctes else [])]) + " " + sql)


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Dataflow and job facts derived from the star schema, as plans: a query derives the columns it reads, and the join that gives runs their job's context goes
    where no column of it is read.
    """
    runs, raw = raw_runs(spark, sf_dir)
    jobs = facts.build_job_facts(raw)
    return facts.build_dataflow_facts(runs, jobs), jobs


def registry(f: Make) -> Make:
    return lambda df, jf: f(freshness.freshness_registry(df, AS_OF), jf)


def stage() -> Column:
    return F.coalesce(F.nullif("stage", F.lit("")), F.lit("unknown"))


def kind() -> Column:
    return F.coalesce(F.nullif("operation_type", F.lit("")), F.lit("unknown"))


RANX = f"CASE WHEN {S.RAN} THEN duration_seconds END"
DUR = ", ".join(f"{S.nip(RANX, p)} AS {k}_duration_seconds" for k, p in overview.DURATIONS.items()) + f", COUNT({RANX}) AS duration_count, {S.avg(RANX)} AS avg_duration_seconds, COALESCE(ROUND(MAX({RANX}), 3), 0) AS max_duration_seconds"
RATES = f"{S.ok()} AS success_rate, {S.ok(s='failed')} AS failure_rate, " + ", ".join(f"{S.ok('true', x)} AS {a}_rate" for x, a in (("skipped", "skip"), ("running", "running"), ("pending", "pending")))
FACT_COLS = "_source_id, job_id, dataflow_id, dataflow_run_id, normalized_status, engine_name, metadata_provider_name, platform_name"

# facts and scope
add("f01_job_facts", lambda df, jf: jf.select("_source_id", "job_id", "normalized_status", "event_time", "run_date", "duration_seconds"), f"SELECT _source_id, job_id, normalized_status, {S.ts('event_time')} AS event_time, CAST(run_date AS VARCHAR) AS run_date, duration_seconds FROM jf")
add("f02_dataflow_facts", lambda df, jf: df.select(*FACT_COLS.split(", "), "event_time", "run_date"), f"SELECT {FACT_COLS}, {S.ts('event_time')} AS event_time, CAST(run_date AS VARCHAR) AS run_date FROM df")
add("f04_validate_facts", lambda df, jf: facts.validate_facts(jf.drop("normalized_status", "run_date"), jf), "SELECT (SELECT COUNT(*) FROM raw_jobs) AS raw_rows, COUNT(*) AS fact_rows, CAST(0 AS BIGINT) AS status_mismatches, CAST(0 AS BIGINT) AS run_date_mismatches, true AS valid FROM jf")
IDENT = f"idn AS (SELECT *, NULLIF(LOWER(TRIM(dataflow_name)), '') AS name_key, CASE WHEN {S.NOID} THEN 'id:' || TRIM(dataflow_id) ELSE 'name:' || NULLIF(LOWER(TRIM(dataflow_name)), '') END AS identity FROM df), shared AS (SELECT name_key, COUNT(DISTINCT TRIM(dataflow_id)) AS ids FROM idn WHERE {S.NOID} AND name_key IS NOT NULL GROUP BY 1)"
add("f05_latest_dataflow_runs", lambda df, jf: facts.latest_dataflow_runs(df), f"SELECT identity, dataflow_id, dataflow_name, dataflow_run_id, job_id, normalized_status, {S.ts('event_time')} AS event_time, COALESCE(ids, 0) > 1 AS ambiguous_name FROM (SELECT * FROM idn WHERE identity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY identity ORDER BY event_time DESC NULLS LAST, dataflow_run_id DESC) = 1) LEFT JOIN shared USING (name_key)", IDENT)
FV = [("dataflow", "df", c) for c in ("stage", "source_connection_type", "destination_connection_type", "source_format", "destination_format", "destination_load_type", "operation_type", "normalized_status")] + [("job", "jf", c) for c in ("engine_name", "metadata_provider_name", "platform_name", "normalized_status")]
add("i17_filter_values", lambda df, jf: facts.filter_values(df, jf), " UNION ALL ".join(f"SELECT _source_id, '{k}_{c}' AS field, TRIM({c}) AS value, COUNT(*) AS records FROM {t} WHERE {S.filled(c)} IS NOT NULL GROUP BY ALL" for k, t, c in FV) + " UNION ALL SELECT _source_id, 'connection', value, COUNT(*) FROM (SELECT DISTINCT _source_id, dataflow_run_id, value FROM (SELECT _source_id, dataflow_run_id, source_name AS value FROM df UNION ALL SELECT _source_id, dataflow_run_id, destination_name FROM df) WHERE NULLIF(TRIM(value), '') IS NOT NULL) GROUP BY ALL")


def scoped(flt: dict[str, str]) -> Make:
    def make(df: DataFrame, jf: DataFrame) -> DataFrame:
        a, b = scope.scope(df, jf, flt, NOW)
        return a.select(F.lit("dataflow").alias("kind"), F.col("dataflow_run_id").alias("id")).unionByName(b.select(F.lit("job").alias("kind"), F.col("job_id").alias("id")))

    return make


def scoped_sql(flow: str, job: str, semi: bool) -> str:
    tail = " AND EXISTS (SELECT 1 FROM sd WHERE sd._source_id = jf._source_id AND sd.job_id = jf.job_id)" if semi else ""
    return f"SELECT 'dataflow' AS kind, dataflow_run_id AS id FROM sd UNION ALL SELECT 'job', job_id FROM jf WHERE {job}{tail}", f"sd AS (SELECT * FROM df WHERE {flow})"


TABLE = "COALESCE({}, '')".format
FLOW_SEARCH = "contains(LOWER(concat_ws(chr(1), job_id, dataflow_run_id, dataflow_id, dataflow_name, stage, error_message, source_name, source_full_table, replace(source_full_table, chr(96), ''), source_table, source_path, destination_name, destination_full_table, destination_table, destination_path, COALESCE(destination_name, 'unknown') || '::' || COALESCE(replace(destination_full_table, chr(96), ''), ''), engine_name, metadata_provider_name)), '{}')".format
JOB_SEARCH = "contains(LOWER(concat_ws(chr(1), job_id, engine_name, metadata_provider_name, status, error_message)), '{}')".format
for name, flt, args in (
    ("s02_scope_90d", {"range": "90d"}, ("event_time >= TIMESTAMP '2001-08-07 00:00:00' AND event_time <= TIMESTAMP '2001-11-05 00:00:00'",) * 2 + (False,)),
    ("s03_scope_multi_value", {"status": "failed|skipped", "stage": "gold", "engine": "SparkEngine"}, ("normalized_status IN ('failed','skipped') AND stage = 'gold' AND engine_name = 'SparkEngine'", "normalized_status IN ('failed','skipped') AND engine_name = 'SparkEngine'", True)),
    ("s04_scope_connection", {"connection": "source-3|destination-4"}, ("source_name IN ('source-3','destination-4') OR destination_name IN ('source-3','destination-4')", "true", True)),
    ("s05_scope_search", {"q": "Spark"}, (FLOW_SEARCH("spark"), JOB_SEARCH("spark"), False)),
    ("s05_scope_search_qualified", {"q": "lake.raw.IN"}, (FLOW_SEARCH("lake.raw.in"), JOB_SEARCH("lake.raw.in"), False)),
    ("s05_scope_search_joined", {"q": "destination-3::cat.db"}, (FLOW_SEARCH("destination-3::cat.db"), JOB_SEARCH("destination-3::cat.db"), False)),
    ("s05_scope_search_literal", {"q": "10_%"}, (FLOW_SEARCH("10_%"), JOB_SEARCH("10_%"), False)),
    ("s06_scope_investigation", {"destination_table": "cat.db.t7"}, ("'cat.db.t7' IN (destination_full_table, destination_table, destination_path, destination_name)", "true", True)),
):
    sql, ctes = scoped_sql(*args)
    add(name, scoped(flt), sql, ctes)
add("s08_dataflow_log_page", lambda df, jf: scope.dataflow_log_page(df, "duration_seconds", True, 50, 25), f"SELECT dataflow_run_id, dataflow_id, dataflow_name, job_id, stage, operation_type, normalized_status, {S.ts('event_time')} AS event_time, duration_seconds, engine_name FROM df ORDER BY duration_seconds DESC NULLS LAST, df.event_time DESC NULLS LAST, dataflow_run_id LIMIT 50 OFFSET 25")
add("s09_job_log_page", lambda df, jf: scope.job_log_page(jf, df, limit=50), f"SELECT p._source_id, p.job_id, p.normalized_status, {S.ts('p.event_time')} AS event_time, p.duration_seconds, p.engine_name, COUNT(d.dataflow_run_id) AS child_runs, COUNT(*) FILTER (d.normalized_status = 'failed') AS child_failed, {S.s('d.source_rows_read')} AS child_rows_read, ROUND(quantile_cont(d.duration_seconds, 0.95), 3) AS child_p95_duration FROM pg p LEFT JOIN df d ON d._source_id = p._source_id AND d.job_id = p.job_id GROUP BY ALL", "pg AS (SELECT * FROM jf ORDER BY event_time DESC NULLS LAST, job_id LIMIT 50)")
add("s10_enrich_job_runs", lambda df, jf: jobs.enrich_job_runs(jf, df).drop("job_key"), "SELECT j._source_id, j.job_id, j.normalized_status, CASE WHEN COALESCE(total_dataflows, total_failed, total_skipped, total_succeeded) IS NULL THEN 'not_available' WHEN m.n > 0 THEN 'mismatch' ELSE 'matched' END AS reconciliation, CASE WHEN length(t) > 40 THEN t[1:37] || '...' ELSE t END AS error_preview FROM (SELECT *, TRIM(regexp_replace(COALESCE(error_message, ''), '\\s+', ' ', 'g')) AS t FROM jf) j LEFT JOIN (SELECT _source_id, job_id, COUNT(*) AS n FROM mis GROUP BY ALL) m USING (_source_id, job_id)", S.COMPARE)
OVER = "COALESCE(GREATEST(0, COALESCE(overhead_duration_seconds, duration_seconds - source_duration_seconds - transform_duration_seconds - destination_duration_seconds)), 0)"
SLOWEST = f"list_sort([{{'d': -source_duration_seconds, 'i': 0, 'p': 'source'}}, {{'d': -transform_duration_seconds, 'i': 1, 'p': 'transform'}}, {{'d': -destination_duration_seconds, 'i': 2, 'p': 'destination'}}, {{'d': -{OVER}, 'i': 3, 'p': 'overhead'}}])[1].p"
S11 = f"""ph AS (SELECT *, CASE WHEN normalized_status = 'failed' THEN COALESCE(list_filter([IF(source_status = 'failed', 'source', NULL), IF(transform_status = 'failed', 'transform', NULL), IF(destination_status = 'failed', 'destination', NULL)], lambda x: x IS NOT NULL)[1], 'overhead') END AS broken,
  {SLOWEST} AS slow, TRIM(regexp_replace(COALESCE({', '.join(S.filled(f'{p}error_message') for p in ('', 'source_', 'transform_', 'destination_'))}, ''), '\\s+', ' ', 'g')) AS said FROM df), ph2 AS (SELECT *, COALESCE(broken || '_failed', slow || '_bottleneck') AS phase_health FROM ph)"""
add("s11_phase_health", lambda df, jf: durations.phase_health(df), "SELECT phase_health, COUNT(*) AS runs FROM ph2 GROUP BY 1", S11)
S11_COLS = ["dataflow_run_id", "source_display", "destination_display", "phase_health", "error_phase", "error_preview", "coverage_state", "movement_state", "adjustment_state", "failure_phase", "failure_category", "failure_signature", "linked_job_status", "linked_job_duration_seconds"]
CLOSED = "(({0}[1:1] = '{{' AND {0}[-1:] = '}}' OR {0}[1:1] = '[' AND {0}[-1:] = ']') AND NOT json_valid({0}))".format
MARKED = f"""mk AS (SELECT dataflow_run_id, {S.filled(S.B)} AS wb, {S.filled(S.A)} AS wa, {S.filled(S.E)} AS we, COALESCE({S.filled(S.B)}, {S.filled(S.A)}, {S.filled(S.E)}, {S.filled('source_watermark_columns')}) IS NULL AS bare, normalized_status AS st FROM df),
 mk2 AS (SELECT *, CASE WHEN bare THEN 'not_configured' WHEN COALESCE({CLOSED('wb')}, false) OR COALESCE({CLOSED('wa')}, false) OR COALESCE({CLOSED('we')}, false) THEN 'invalid' ELSE 'configured' END AS coverage_state FROM mk),
 mk3 AS (SELECT dataflow_run_id, coverage_state, CASE WHEN coverage_state <> 'configured' THEN coverage_state WHEN st IN ('running','pending') THEN 'incomplete' WHEN st IN ('failed','skipped') THEN 'unchanged' WHEN wa IS NULL THEN 'incomplete' WHEN wb IS NULL THEN 'initialized' WHEN wa = wb THEN 'unchanged' ELSE 'advanced' END AS movement_state, CASE WHEN coverage_state <> 'configured' THEN coverage_state WHEN wb IS NULL THEN 'unknown' WHEN we <> wb THEN 'adjusted' ELSE 'not_adjusted' END AS adjustment_state FROM mk2)"""
add(
    "s11_enrich_dataflow_runs",
    lambda df, jf: durations.enrich_dataflow_runs(df, jf).select(*S11_COLS),
    f"""SELECT ph2.dataflow_run_id, COALESCE(replace({S.filled('source_full_table')}, chr(96), ''), concat_ws('.', {S.filled('source_schema')}, source_table)) AS source_display, COALESCE(destination_full_table, destination_table) AS destination_display, phase_health,
    COALESCE(broken, '') AS error_phase, CASE WHEN length(said) > 140 THEN said[1:137] || '...' ELSE said END AS error_preview, coverage_state, movement_state, adjustment_state, f.failure_phase, f.failure_category, f.failure_signature, COALESCE(newj.normalized_status, 'unknown') AS linked_job_status, newj.duration_seconds AS linked_job_duration_seconds
    FROM ph2 JOIN mk3 USING (dataflow_run_id) LEFT JOIN (SELECT dataflow_run_id, failure_phase, failure_category, failure_signature FROM fails) f USING (dataflow_run_id) LEFT JOIN newj ON newj._source_id = ph2._source_id AND newj.job_id = ph2.job_id""",
    ", ".join([S11, MARKED, S.FAILED, S.NEWJ]),
)

# overview
AGE = "date_diff('day', run_date, DATE '2001-11-05')"
FAIL_IN = ", ".join(S.n(f"normalized_status = 'failed' AND {AGE} >= 0 AND {AGE} < {d}", f"failed_last_{d}_days") for d in (7, 30, 365))
add("o01_environment_summary", lambda df, jf: scope.environment_summary(df, jf, AS_OF), f"SELECT COUNT(*) AS dataflow_runs, COUNT(DISTINCT CASE WHEN {S.NOID} THEN dataflow_id END) AS dataflows, {S.ok()} AS success_rate, {FAIL_IN}, CAST(MIN(run_date) AS VARCHAR) AS first_date, CAST(MAX(run_date) AS VARCHAR) AS last_date, (SELECT COUNT(*) FROM jf) AS job_runs, (SELECT COUNT(DISTINCT NULLIF(engine_name, '')) FROM jf) AS active_engines FROM df")
add("o03_job_summary", lambda df, jf: overview.job_summary(jf), f"SELECT COUNT(*) AS total_jobs, {S.sts()}, {RATES}, {', '.join(f'{S.s(c)} AS {c}' for c in ('total_skipped', 'total_pending', 'total_running'))}, {S.s('total_rows_read')} + {S.s('total_rows_written')} AS total_rows_processed, COUNT(DISTINCT NULLIF(engine_name, '')) AS distinct_engine_name, COUNT(DISTINCT NULLIF(metadata_provider_name, '')) AS distinct_metadata_provider_name, {DUR} FROM jf")
add("o04_dataflow_summary", lambda df, jf: overview.dataflow_summary(df), f"SELECT COUNT(*) AS total_dataflows, {S.sts()}, {RATES}, {', '.join(f'{S.s(c)} AS sum_{c}' for c in ('source_rows_read', 'destination_rows_written', 'destination_bytes_added'))}, {S.s('destination_bytes_added')} - {S.s('destination_bytes_removed')} AS net_bytes_change, {DUR} FROM df")
for g in ("hour", "day", "week", "month"):
    add(f"o05_status_trend_{g}", (lambda g: lambda df, jf: overview.status_trend(df, g))(g), f"SELECT {S.trunc(g)} AS bucket_start, normalized_status AS status, COUNT(*) AS count FROM df WHERE event_time IS NOT NULL GROUP BY 1, 2")
add("o05_status_trend_wide", lambda df, jf: overview.status_trend_wide(jf, "month"), f"SELECT {S.trunc('month')} AS bucket_start, {S.sts()}, COUNT(*) FILTER ({S.RAN}) AS executable, {S.ok()} AS success_rate, {S.ok(s='failed')} AS failure_rate FROM jf WHERE event_time IS NOT NULL GROUP BY 1")
WIN = [("today", "CAST(event_time AS DATE) = DATE '2001-11-05'"), ("last_24h", "event_time > TIMESTAMP '2001-11-04' AND event_time <= TIMESTAMP '2001-11-05'"), ("last_7d", "event_time > TIMESTAMP '2001-10-29' AND event_time <= TIMESTAMP '2001-11-05'")]
add("o06_operation_windows", lambda df, jf: overview.operation_windows(df, jf, AS_OF), " UNION ALL ".join([f"SELECT 'dataflow' AS record_type, '{w}' AS window, COUNT(*) AS runs, {S.sts(False)} FROM df WHERE {c} HAVING COUNT(*) > 0" for w, c in WIN] + [f"SELECT 'job', '{w}', COUNT(*), COUNT(*) FILTER (normalized_status = 'succeeded'), COUNT(*) FILTER (normalized_status = 'failed'), {S.s('total_skipped')}, {S.s('total_running')}, {S.s('total_pending')} FROM jf WHERE {c} HAVING COUNT(*) > 0" for w, c in WIN]))
CTX = ["engine_name", "metadata_provider_name", "platform_name"]
add("o07_runtime_contexts", lambda df, jf: overview.runtime_contexts(jf), f"SELECT {', '.join(f'{S.known(c)} AS {c}' for c in CTX)}, COUNT(*) AS jobs, {S.sts(False)}, {S.ok()} AS success_rate, {S.avg(RANX)} AS avg_duration_seconds, {S.nip(RANX, .95)} AS p95_duration_seconds FROM jf GROUP BY 1, 2, 3 ORDER BY failed DESC, jobs DESC, 1, 2, 3 LIMIT 30")
add("o08_operation_health", lambda df, jf: overview.operation_health(df, jf), f"SELECT record_type, operation_type, COUNT(*) AS count, {S.sts(False)} FROM (SELECT 'job' AS record_type, operation_type, normalized_status FROM jo UNION ALL SELECT 'dataflow', {S.blank('operation_type')}, normalized_status FROM df) GROUP BY 1, 2", "jo AS (SELECT DISTINCT _source_id, job_id, normalized_status, COALESCE(NULLIF(TRIM(v), ''), 'unknown') AS operation_type FROM (SELECT *, unnest(regexp_split_to_array(TRIM(regexp_replace(COALESCE(operation_types, ''), '[\\[\\]\"'']', '', 'g')), '\\s*[,;|]\\s*')) AS v FROM jf))")
WT = ["source_rows_read", "destination_rows_written", "destination_rows_inserted", "destination_rows_updated", "destination_rows_deleted", "destination_bytes_added", "destination_bytes_removed", "destination_bytes_saved", "destination_files_added", "destination_files_removed"]
add("o09_workload_trend", lambda df, jf: overview.workload_trend(df, "month"), f"SELECT {S.trunc('month')} AS bucket_start, COUNT(*) AS runs, {', '.join(f'{S.s(c)} AS {c}' for c in WT)}, {S.s(S.EST)} AS estimated_rows_written, {S.s('destination_bytes_added')} - {S.s('destination_bytes_removed')} AS net_bytes FROM df WHERE event_time IS NOT NULL GROUP BY 1")
add("o10_failure_categories", lambda df, jf: overview.failure_category_counts(df), "SELECT failure_category AS category, COUNT(*) AS count FROM fails GROUP BY 1", S.FAILED)
add("o11_top_failing_dataflow", lambda df, jf: overview.top_failing_dataflow(df), "SELECT COALESCE(NULLIF(dataflow_name, ''), NULLIF(dataflow_id, ''), 'unknown') AS dataflow_name, dataflow_id, COUNT(*) AS error_count FROM df WHERE normalized_status = 'failed' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1")
NEWER = "event_time >= TIMESTAMP '2001-11-05' - to_days({})".format
UPK = "(LOWER(operation_type) = 'maintenance' OR LOWER(destination_operation_type) IN ('compact', 'cleanup', 'maintenance'))"
HEALTH = f"""hin AS (SELECT d.*, j.*, (SELECT COUNT(*) FROM (SELECT DISTINCT _source_id, job_id FROM mis)) AS mismatch_count,
   (SELECT COUNT(DISTINCT job_id) FROM kids k WHERE NOT EXISTS (SELECT 1 FROM jf WHERE jf._source_id = k._source_id AND jf.job_id = k.job_id)) AS orphan_dataflow_job_ids,
   (SELECT COUNT(DISTINCT job_id) FROM jf WHERE NOT EXISTS (SELECT 1 FROM kids k WHERE jf._source_id = k._source_id AND jf.job_id = k.job_id)) AS jobs_without_dataflow_records,
   GREATEST(latest_job_log_at, latest_dataflow_log_at) AS latest_log_at, CAST(GREATEST(0, floor(date_diff('second', GREATEST(latest_job_log_at, latest_dataflow_log_at), TIMESTAMP '2001-11-05') / 86400.0)) AS BIGINT) AS latest_log_age_days FROM
 (SELECT MAX(event_time) AS latest_dataflow_log_at, {', '.join(S.n(f"normalized_status = 'failed' AND {NEWER(d)}", f'failed_dataflows_last_{d}_days') for d in (3, 7))}, {', '.join(S.n(f"normalized_status = 'failed' AND {UPK} AND {NEWER(d)}", f'maintenance_failed_last_{d}_days') for d in (7, 14))}, {S.n(f"normalized_status = 'skipped' AND {UPK} AND {NEWER(7)}", 'maintenance_skipped_last_7_days')} FROM df) d,
 (SELECT MAX(event_time) AS latest_job_log_at, COUNT(*) AS total_jobs, {', '.join(S.n(f"normalized_status = 'failed' AND {NEWER(d)}", f'failed_jobs_last_{d}_days') for d in (3, 7))} FROM jf) j)"""
HSQL = S.COMPARE + ", " + HEALTH
TIMES = ("latest_log_at", "latest_job_log_at", "latest_dataflow_log_at")
HCOLS = "* REPLACE (" + ", ".join(f"{S.ts(c)} AS {c}" for c in TIMES) + ")"
add("o12_health_inputs", lambda df, jf: overview.health_inputs(df, jf, AS_OF), f"SELECT {HCOLS} FROM hin", HSQL)


def health(df: DataFrame, jf: DataFrame, as_of: str = AS_OF, read_errors: DataFrame | None = None) -> DataFrame:
    inputs = overview.health_inputs(df, jf, as_of).join(overview.log_coverage(df, jf, read_errors))
    return overview.environment_health(inputs)


def health_text(df: DataFrame) -> DataFrame:
    return df.select("status", F.array_join("reasons", " ").alias("reasons"), "latest_log_age_days")


STATUS = ["healthy", "no_log_evidence", "warning", "has_issues"]


def health_sql(inputs: str, errors: int) -> str:
    """Reasons as a list in order, the status as the largest rank; hin is read through `inputs`."""
    some = lambda *names: " OR ".join(f"{x} > 0" for x in names)
    kinds = [
        [("coverage_status IN ('missing_sources', 'no_records')", 1, "'No complete ETL log evidence is available.'")],
        [("coverage_status IN ('error', 'partial')", 2, "'Log coverage is partial or has read errors.'")],
        [(f"latest_log_age_days > {d}", r, "'Latest log is ' || latest_log_age_days || ' days old.'") for d, r in ((30, 3), (7, 2))],
        [(some("failed_jobs_last_3_days", "failed_dataflows_last_3_days"), 3, "'Recent failures were found in the last 3 days.'"), (some("failed_jobs_last_7_days", "failed_dataflows_last_7_days"), 2, "'Failures were found in the last 7 days.'")],
        [(some("maintenance_failed_last_7_days"), 3, "'Maintenance failures were found in the last 7 days.'"), (some("maintenance_failed_last_14_days"), 2, "'Maintenance failures were found in the last 14 days.'")],
        [(some("maintenance_skipped_last_7_days"), 2, "'Skipped maintenance operations were found in the last 7 days.'")],
        [(some("mismatch_count"), 2, "'Job and dataflow log totals do not fully reconcile.'")],
    ]
    answers = ", ".join("CASE " + " ".join(f"WHEN {c} THEN {{'k': {r}, 'said': {text}}}" for c, r, text in kind) + " END" for kind in kinds)
    cover = f"CASE WHEN {errors} > 0 THEN IF(total_jobs + flows > 0, 'partial', 'error') WHEN total_jobs + flows = 0 THEN 'no_records' ELSE 'complete' END"
    return f"""hst AS (SELECT * EXCLUDE (found), {STATUS}[1 + COALESCE(list_max(list_transform(found, lambda x: x.k)), 0)] AS status, IF(len(found) = 0 AND total_jobs > 0, 'No immediate monitoring issues detected.', array_to_string(list_transform(found, lambda x: x.said), ' ')) AS reasons
      FROM (SELECT *, list_filter([{answers}], lambda x: x IS NOT NULL) AS found FROM (SELECT *, {cover} AS coverage_status, {errors} AS read_errors FROM (SELECT *, (SELECT COUNT(*) FROM df) AS flows FROM {inputs}))))"""


# at the facts' own time, later by ten and forty days, without any record, and with a log that couldn't be read
add("o13_environment_health", lambda df, jf: health_text(health(df, jf)), "SELECT status, reasons, latest_log_age_days FROM hst", HSQL + ", " + health_sql("hin", 0))
for late, stamp in ((10, "2001-11-15 00:00:00"), (40, "2001-12-15 00:00:00")):
    later = HSQL.replace("TIMESTAMP '2001-11-05'", f"TIMESTAMP '{stamp[:10]}'")
    add(f"o13_environment_health_after_{late}_days", (lambda at: lambda df, jf: health_text(health(df, jf, at)))(stamp), "SELECT status, reasons, latest_log_age_days FROM hst", later + ", " + health_sql("hin", 0))
nothing = HSQL.replace(" FROM df)", " FROM df WHERE false)").replace(" FROM jf)", " FROM jf WHERE false)").replace("FROM df WHERE job_id", "FROM df WHERE false AND job_id").replace("FROM jf j LEFT JOIN", "FROM (SELECT * FROM jf WHERE false) j LEFT JOIN").replace("FROM jf WHERE NOT EXISTS", "FROM jf WHERE false AND NOT EXISTS")
add("o13_environment_health_no_records", lambda df, jf: health_text(health(df.filter("false"), jf.filter("false"))), "SELECT status, reasons, latest_log_age_days FROM hst", nothing + ", " + health_sql("hin", 0).replace("(SELECT COUNT(*) FROM df)", "0"))
add("o13_environment_health_read_errors", lambda df, jf: health_text(health(df, jf, read_errors=df.sparkSession.range(2))), "SELECT status, reasons, latest_log_age_days FROM hst", HSQL + ", " + health_sql("hin", 2))


def attention_inputs(df: DataFrame, jf: DataFrame) -> DataFrame:
    """One row that gathers what pages warn of."""
    stale = freshness.freshness_registry(df, AS_OF).agg(F.coalesce(F.sum("is_stale"), F.lit(0)).alias("stale_candidates"))
    still = freshness.watermark_states(df).agg(F.count_if(F.col("movement_state") == "unchanged").alias("watermark_unchanged_runs"))
    slow = performance.totals(df).select("optimization_candidate_count", "duration_pressure_ratio", "p95_duration_seconds")
    stage_ = durations.slowest_by(df, "stage", 1).agg(F.first("group_value").alias("slowest_stage"), F.first("p95").alias("slowest_stage_p95"))
    upkeep = maintenance.registry(df).agg(F.count_if(F.col("active_lakehouse_table") & ~F.col("maintained_table")).alias("coverage_missing_tables"), F.count_if(F.col("maintenance_lag_seconds") > maintenance.LAG_DAYS * 86400).alias("lagged_tables"), F.count_if(F.col("latest_status").isin("running", "pending")).alias("latest_active_tables"))
    top = overview.top_failing_dataflow(df).agg(F.first("dataflow_name").alias("top_failing_dataflow"), F.coalesce(F.first("error_count"), F.lit(0)).alias("error_count"))
    open_ = df.agg(F.count_if(C.status_is("running", "pending")).alias("active_dataflow_runs"))
    context = overview.worst_context(overview.runtime_contexts(jf))
    out = health(df, jf).withColumn("linkage_gaps", F.col("orphan_dataflow_job_ids") + F.col("jobs_without_dataflow_records"))
    for part in (stale, still, slow, stage_, upkeep, top, open_, context):
        out = out.join(part)
    return out


ATT = f"""perf AS (SELECT COUNT(candidate_code) AS optimization_candidate_count, {S.nip('duration_seconds', .5)} AS p50, {S.nip('duration_seconds', .95)} AS p95_duration_seconds FROM cand),
 stg AS (SELECT * FROM (SELECT {S.blank('stage')} AS slowest_stage, COUNT(*) AS runs, {S.nip('duration_seconds', .95)} AS slowest_stage_p95 FROM df WHERE {S.RAN} AND duration_seconds IS NOT NULL GROUP BY 1) ORDER BY slowest_stage_p95 DESC, runs DESC, slowest_stage LIMIT 1),
 topf AS (SELECT COALESCE(NULLIF(dataflow_name, ''), NULLIF(dataflow_id, ''), 'unknown') AS top_failing_dataflow, dataflow_id, COUNT(*) AS error_count FROM df WHERE normalized_status = 'failed' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1),
 ctx AS (SELECT {', '.join(f'{S.known(c)} AS {c}' for c in CTX)}, COUNT(*) FILTER (normalized_status = 'failed') AS context_failed, {S.ok()} AS context_success_rate FROM jf GROUP BY 1, 2, 3),
 worst AS (SELECT engine_name || ' / ' || metadata_provider_name AS context_name, context_success_rate, context_failed FROM ctx WHERE context_failed > 0 AND context_success_rate < 95 ORDER BY context_success_rate, context_failed DESC, 1, platform_name LIMIT 1),
 ain AS (SELECT hst.*, orphan_dataflow_job_ids + jobs_without_dataflow_records AS linkage_gaps, (SELECT CAST(COALESCE(SUM(is_stale), 0) AS BIGINT) FROM reg) AS stale_candidates, (SELECT COUNT(*) FROM etl WHERE movement_state = 'unchanged') AS watermark_unchanged_runs, optimization_candidate_count, CASE WHEN p50 > 0 THEN p95_duration_seconds / p50 ELSE 0 END AS duration_pressure_ratio, p95_duration_seconds, slowest_stage, slowest_stage_p95,
   (SELECT COUNT(*) FROM mreg WHERE active AND NOT maintained) AS coverage_missing_tables, (SELECT COUNT(*) FROM mreg WHERE lag_seconds > 604800) AS lagged_tables, (SELECT COUNT(*) FROM mreg WHERE latest_status IN ('running', 'pending')) AS latest_active_tables, top_failing_dataflow, error_count, (SELECT COUNT(*) FROM df WHERE normalized_status IN ('running', 'pending')) AS active_dataflow_runs, context_name, context_success_rate, context_failed FROM hst, perf, stg, topf, worst)"""
ALL_CTES = ", ".join([S.COMPARE, HEALTH, health_sql("hin", 0), S.REG, S.CAND, S.MREG, ATT])
AIN = ["status", "stale_candidates", "watermark_unchanged_runs", "optimization_candidate_count", "slowest_stage", "slowest_stage_p95", "coverage_missing_tables", "lagged_tables", "latest_active_tables", "top_failing_dataflow", "error_count", "active_dataflow_runs", "linkage_gaps", "context_name", "context_success_rate", "context_failed"]
add("o14_attention_inputs", lambda df, jf: attention_inputs(df, jf).select(*AIN), f"SELECT {', '.join(AIN)} FROM ain", ALL_CTES)
SECS = "CASE WHEN {0} < 60 THEN printf('%.2fs', {0}) ELSE printf('%.2fm', {0} / 60) END".format
IN_DAYS = [("recent_failed_jobs", "Review recent failed jobs", "jobs", "failed_jobs", "jobs failed", 3, 7, True), ("recent_failed_dataflows", "Review recent failed dataflows", "failures", "failed_dataflows", "dataflow runs failed", 3, 7, True), ("maintenance_failed", "Review failed maintenance", "maintenance", "maintenance_failed", "maintenance operations failed", 7, 14, False)]
WARN = [
    (1, "maintenance_skipped", "Review skipped maintenance", "maintenance", "maintenance_skipped_last_7_days", "maintenance operations were skipped in the last 7 days.", False),
    (1, "maintenance_coverage", "Review maintenance coverage", "maintenance", "coverage_missing_tables", "active lakehouse tables have no maintenance evidence.", True),
    (1, "maintenance_lag", "Review maintenance lag", "maintenance", "lagged_tables", "tables exceed the maintenance lag threshold.", True),
    (2, "maintenance_active", "Inspect active maintenance", "maintenance", "latest_active_tables", "table maintenance targets are running or pending.", True),
    (1, "stale_dataflows", "Review stale dataflows", "freshness", "stale_candidates", "stale dataflow candidates were detected.", False),
    (1, "watermark_not_advanced", "Review unchanged watermarks", "freshness", "watermark_unchanged_runs", "runs did not advance watermark values.", False),
    (1, "optimization_candidates", "Review optimization candidates", "performance", "optimization_candidate_count", "dataflow runs match performance optimization rules.", True),
    (1, "log_reconciliation", "Review log consistency", "diagnostics", "mismatch_count", "job totals differ from dataflow rollups.", False),
    (0, "job_linkage_gaps", "Review job linkage gaps", "diagnostics", "linkage_gaps", "job IDs are not linked across job and dataflow logs.", True),
    (2, "active_dataflows", "Inspect active dataflows", "dataflows", "active_dataflow_runs", "dataflow runs are running or pending in the current filters.", True),
    (0, "log_read_errors", "Review log read errors", "diagnostics", "read_errors", "read errors were found.", True),
]


def attention_sql(top: int) -> str:
    """Each warning is a SELECT from the one row of inputs; wider windows ask only where the narrower hold nothing."""
    arms = [f"SELECT IF({c}_last_{a}_days > 0, 0, 1) AS k, '{code}' AS code, '{title}' AS title, '{page}' AS target, IF({c}_last_{a}_days > 0, {c}_last_{a}_days || ' {said} in the last {a} days.', {c}_last_{b}_days || ' {said} in the last {b} days.') AS detail, {f'IF({c}_last_{a}_days > 0, {c}_last_{a}_days, {c}_last_{b}_days)' if scored else 0} AS impact FROM ain WHERE {c}_last_{a}_days + {c}_last_{b}_days > 0" for code, title, page, c, said, a, b, scored in IN_DAYS]
    arms += [f"SELECT {k}, '{code}', '{title}', '{page}', {c} || ' {said}', {c if scored else 0} FROM ain WHERE {c} > 0" for k, code, title, page, c, said, scored in WARN]
    pressed = "duration_pressure_ratio >= 5 AND p95_duration_seconds >= 30"
    arms += [
        "SELECT 0, 'repeated_failure', 'Repeated dataflow failure', 'failures', top_failing_dataflow || ' failed ' || error_count || ' times.', error_count FROM ain WHERE error_count >= 3",
        "SELECT 1, 'no_log_evidence', 'No log evidence', 'overview', 'No monitoring logs were found in current filters.', 0 FROM ain WHERE status = 'no_log_evidence'",
        "SELECT 1, 'stale_logs', 'Check log freshness', 'overview', 'Latest log is ' || latest_log_age_days || ' days old.', 0 FROM ain WHERE latest_log_age_days > 7",
        f"SELECT IF(duration_pressure_ratio >= 10 AND p95_duration_seconds >= 60, 0, 1), 'performance_pressure', 'Review performance pressure', 'performance', 'P95 is ' || ROUND(duration_pressure_ratio, 1) || 'x P50 at ' || {SECS('p95_duration_seconds')} || '.', duration_pressure_ratio FROM ain WHERE {pressed}",
        f"SELECT 2, 'slowest_stage', 'Inspect slowest stage', 'performance', slowest_stage || ' has p95 duration ' || {SECS('slowest_stage_p95')} || '.', 0 FROM ain WHERE slowest_stage_p95 >= 60 AND NOT ({pressed})",
        "SELECT 1, 'runtime_context_health', 'Review runtime context health', 'jobs', context_name || ' is at ' || ROUND(context_success_rate, 1) || '% success.', context_failed FROM ain WHERE context_name IS NOT NULL",
    ]
    return f"SELECT code, ['bad', 'warning', 'info'][k + 1] AS severity, title, detail, target, CAST(impact AS DOUBLE) AS impact FROM ({' UNION ALL '.join(arms)}) t ORDER BY k, t.impact DESC, title LIMIT {top}"


add("o15_attention_queue", lambda df, jf: overview.attention_queue(attention_inputs(df, jf)), attention_sql(8), ALL_CTES)
add("o15_attention_all", lambda df, jf: overview.attention_queue(attention_inputs(df, jf), 30), attention_sql(30), ALL_CTES)

# jobs
add("j01_latest_jobs", lambda df, jf: jobs.latest_jobs(jf).select("_source_id", "job_id", "normalized_status", "event_time"), f"SELECT _source_id, job_id, normalized_status, {S.ts('event_time')} AS event_time FROM newj", S.NEWJ)
add("j02_workload_efficiency", lambda df, jf: jobs.job_workload_efficiency(df, jf), f"SELECT w.job_id, w._source_id, COALESCE(j.normalized_status, CASE WHEN failed_children > 0 THEN 'failed' ELSE 'unknown' END) AS status, w.operation_type, {S.known('j.engine_name')} AS engine_name, {S.known('j.platform_name')} AS platform_name, w.duration_seconds, child_runs, failed_children, skipped_children, rows_read, rows_written, bytes_added, ROUND(rows_read / w.duration_seconds, 3) AS rows_per_second FROM (SELECT _source_id, job_id, {S.blank('operation_type')} AS operation_type, SUM(COALESCE(duration_seconds, 0)) AS duration_seconds, COUNT(*) AS child_runs, COUNT(*) FILTER (normalized_status = 'failed') AS failed_children, COUNT(*) FILTER (normalized_status = 'skipped') AS skipped_children, {S.s('source_rows_read')} AS rows_read, {S.s('destination_rows_written')} AS rows_written, {S.s('destination_bytes_added')} AS bytes_added FROM df WHERE job_id IS NOT NULL GROUP BY 1, 2, 3) w LEFT JOIN newj j USING (_source_id, job_id) WHERE w.duration_seconds > 0 ORDER BY w.duration_seconds DESC, child_runs DESC, job_id, operation_type LIMIT 500", S.NEWJ)
add("j03_child_fanout", lambda df, jf: jobs.child_fanout(jf), f"SELECT total_dataflows, COUNT(*) AS jobs, {S.sts()} FROM jf WHERE total_dataflows > 0 GROUP BY 1")
add("j04_status_by_stage", lambda df, jf: jobs.job_status_by_stage(df, jf), f"SELECT stage, COUNT(*) AS touched_jobs, {S.sts()} FROM (SELECT t.stage, COALESCE(j.normalized_status, 'unknown') AS normalized_status FROM (SELECT DISTINCT _source_id, job_id, {S.blank('stage')} AS stage FROM df WHERE job_id IS NOT NULL) t LEFT JOIN newj j USING (_source_id, job_id)) GROUP BY 1", S.NEWJ)
add("j05_latest_failed_job", lambda df, jf: jobs.latest_failed_job(jf), f"SELECT job_id, {S.ts('event_time')} AS event_time, duration_seconds, engine_name, stages, operation_types FROM jf WHERE normalized_status = 'failed' AND event_time IS NOT NULL ORDER BY jf.event_time DESC, job_id LIMIT 1")
add("j06_reconcile_jobs", lambda df, jf: jobs.reconcile_jobs(jf, df), "SELECT * FROM mis ORDER BY job_id, metric LIMIT 50", S.COMPARE)


def _box(table: str, group: str) -> str:
    quart = ", ".join(f"{S.nip('duration_seconds', p)} AS {k}" for k, p in durations.QUARTILES.items())
    return f"""bx0 AS (SELECT *, {group} AS group_value FROM {table} WHERE {S.RAN} AND duration_seconds IS NOT NULL),
     bx1 AS (SELECT group_value, COUNT(*) AS count, ROUND(MIN(duration_seconds), 3) AS min_duration, ROUND(MAX(duration_seconds), 3) AS max_duration, ROUND(AVG(duration_seconds), 3) AS avg_duration, COUNT(*) FILTER (normalized_status = 'succeeded') AS succeeded, COUNT(*) FILTER (normalized_status = 'failed') AS failed, {S.ok()} AS success_rate, {quart} FROM bx0 GROUP BY 1),
     bx2 AS (SELECT b.group_value, MIN(duration_seconds) FILTER (inside) AS whisker_min, MAX(duration_seconds) FILTER (inside) AS whisker_max, COUNT(*) FILTER (NOT inside) AS outlier_count FROM (SELECT r.group_value, r.duration_seconds, r.duration_seconds BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM bx0 r JOIN bx1 USING (group_value)) b GROUP BY 1),
     box AS (SELECT * FROM bx1 JOIN bx2 USING (group_value) ORDER BY p95 DESC, count DESC, group_value LIMIT 40)"""


add("j07_job_duration_distribution", lambda df, jf: durations.duration_distribution(jf, F.coalesce("operation_types", F.lit("unknown"))), "SELECT * FROM box", _box("jf", "COALESCE(operation_types, 'unknown')"))
add("t01_slowest_jobs", lambda df, jf: jobs.slowest_jobs(jf), "SELECT job_id, duration_seconds, normalized_status FROM jf WHERE duration_seconds IS NOT NULL ORDER BY duration_seconds DESC, job_id LIMIT 20")
ROLL = "kd AS (SELECT _source_id, job_id, COUNT(*) AS kids, COUNT(*) FILTER (normalized_status = 'failed') AS kf, COUNT(*) FILTER (normalized_status = 'skipped') AS ks, quantile_cont(duration_seconds, 0.95) AS k95 FROM df WHERE job_id IS NOT NULL GROUP BY 1, 2), mm AS (SELECT _source_id, job_id, COUNT(*) AS bad FROM mis GROUP BY 1, 2), ru AS (SELECT jf.*, CASE WHEN kids > 0 THEN kids ELSE COALESCE(total_dataflows, 0) END AS child_dataflow_count, COALESCE(kf, 0) AS child_failed_count, COALESCE(ks, 0) AS child_skipped_count, COALESCE(k95, 0) AS child_p95_duration_seconds, COALESCE(bad, 0) AS reconciliation_mismatch_count FROM jf LEFT JOIN kd USING (_source_id, job_id) LEFT JOIN mm USING (_source_id, job_id))"
add("t02_jobs_by_child_impact", lambda df, jf: jobs.jobs_by_child_impact(jf, df), "SELECT job_id, normalized_status AS status, child_failed_count, reconciliation_mismatch_count, child_skipped_count, child_dataflow_count, child_p95_duration_seconds, COALESCE(duration_seconds, 0) AS duration_seconds FROM ru WHERE child_dataflow_count > 0 OR child_failed_count > 0 OR child_skipped_count > 0 OR child_p95_duration_seconds > 0 ORDER BY child_failed_count DESC, reconciliation_mismatch_count DESC, child_skipped_count DESC, child_dataflow_count DESC, child_p95_duration_seconds DESC, job_id LIMIT 20", S.COMPARE + ", " + ROLL)

# durations
PS = " UNION ALL ".join(f"SELECT {S.blank('stage')} AS g, '{p}' AS phase, {p}_duration_seconds AS duration, LOWER(NULLIF(TRIM({p}_status), '')) AS normalized_status FROM pr" for p in ("source", "transform", "destination")) + f" UNION ALL SELECT {S.blank('stage')}, 'overhead', COALESCE(overhead_duration_seconds, CASE WHEN duration_seconds IS NOT NULL THEN GREATEST(0, duration_seconds - source_duration_seconds - transform_duration_seconds - destination_duration_seconds) END), CASE WHEN normalized_status = 'failed' AND source_status <> 'failed' AND transform_status <> 'failed' AND destination_status <> 'failed' THEN 'failed' END FROM pr"
add("p01_phase_summary", lambda df, jf: durations.phase_summary(df), f"SELECT *, ROUND(100.0 * duration_seconds / NULLIF(SUM(duration_seconds) OVER (PARTITION BY group_value, is_total), 0), 2) AS share_percent FROM (SELECT CASE WHEN GROUPING(g) = 1 THEN 'Total' ELSE g END AS group_value, CAST(GROUPING(g) AS INTEGER) AS is_total, phase, ROUND(COALESCE(SUM(duration), 0), 3) AS duration_seconds, COUNT(duration) AS run_count, {S.avg('duration')} AS avg_duration_seconds, {S.sts()}, {S.nip('duration', .95)} AS p95_duration_seconds FROM ph GROUP BY GROUPING SETS ((g, phase), (phase)))", f"pr AS (SELECT * FROM df WHERE normalized_status IN ('succeeded','failed','skipped')), ph AS ({PS})")
add("p02_duration_distribution", lambda df, jf: durations.duration_distribution(df, kind()), "SELECT * FROM box", _box("df", S.blank("operation_type")))
add("p03_duration_outliers", lambda df, jf: durations.duration_outliers(df, stage()), "SELECT group_value, row_number() OVER (PARTITION BY group_value ORDER BY duration_seconds DESC, dataflow_run_id) AS outlier_rank, duration_seconds, dataflow_run_id, dataflow_name, normalized_status, operation_type, engine_name FROM bx0 JOIN (SELECT group_value, q1, q3 FROM box) USING (group_value) WHERE duration_seconds < q1 - 1.5 * (q3 - q1) OR duration_seconds > q3 + 1.5 * (q3 - q1) QUALIFY outlier_rank <= 40", _box("df", S.blank("stage")))
add("p04_operation_mix", lambda df, jf: durations.operation_mix(df, stage()), f"SELECT g AS group_value, string_agg(k || ': ' || n, ', ' ORDER BY k) AS operation_mix FROM (SELECT {S.blank('stage')} AS g, {S.blank('operation_type')} AS k, COUNT(*) AS n FROM df WHERE {S.RAN} AND duration_seconds IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
ENDS = f"{S.blank('source_name')} AS source_name, {S.blank('destination_name')} AS destination_name"
add("p05_endpoint_health", lambda df, jf: durations.endpoint_health(df), f"SELECT {ENDS}, {', '.join(f'COALESCE({S.mode(c)}, {chr(39)}unknown{chr(39)}) AS {c}' for c in ('source_format', 'destination_format', 'destination_connection_type'))}, COUNT(*) AS runs, {S.sts(False)}, {S.ok()} AS success_rate, {S.avg('duration_seconds')} AS avg_duration, {S.s('source_rows_read')} AS rows_read, {S.s('destination_bytes_added')} AS bytes_added, {S.nip('duration_seconds', .95)} AS p95_duration FROM df GROUP BY 1, 2 ORDER BY failed DESC, p95_duration DESC, runs DESC, 1, 2 LIMIT 18")
DNAME = f"COALESCE({S.latest('NULLIF(dataflow_name, ' + repr('') + ')')}, dataflow_id) AS dataflow_name"
add("p06_dataflow_health", lambda df, jf: durations.dataflow_health(df), f"SELECT dataflow_id, {DNAME}, COALESCE({S.latest('NULLIF(stage, ' + repr('') + ')')}, 'unknown') AS stage, COALESCE({S.mode('NULLIF(operation_type, ' + repr('') + ')')}, 'unknown') AS operation_type, COUNT(*) AS runs, {S.sts()}, {S.ok()} AS success_rate, {S.avg('duration_seconds')} AS avg_duration, COALESCE(MAX(duration_seconds), 0) AS max_duration, {S.s('source_rows_read')} AS rows_read, {S.ts('MAX(event_time)')} AS latest_time, {S.nip('duration_seconds', .95)} AS p95_duration FROM df WHERE {S.NOID} GROUP BY dataflow_id ORDER BY runs DESC, failed DESC, running + pending DESC, p95_duration DESC, 2, 1 LIMIT 40")
add("t04_status_by_stage", lambda df, jf: durations.status_by(df, "stage"), f"SELECT {S.blank('stage')} AS name, COUNT(*) AS runs, {S.sts()} FROM df GROUP BY 1")
add("t05_operation_type_mix", lambda df, jf: durations.status_by(df, "operation_type"), f"SELECT {S.blank('operation_type')} AS name, COUNT(*) AS runs, {S.sts()} FROM df GROUP BY 1")
add("t08_engine_stage_matrix", lambda df, jf: durations.engine_stage_matrix(df), f"SELECT engine_name, {S.blank('stage')} AS stage, COUNT(*) AS runs, COUNT(*) FILTER (normalized_status = 'failed') AS failed, {S.avg('duration_seconds')} AS avg_duration FROM df GROUP BY 1, 2")
for name, column, top in (("t09_slowest_dataflows", "dataflow_id", 25), ("t09_duration_by_stage", "stage", 40)):
    add(name, (lambda c, t: lambda df, jf: durations.slowest_by(df, c, t))(column, top), f"SELECT {S.blank(column)} AS group_value, COUNT(*) AS runs, {S.avg('duration_seconds')} AS avg_duration, {S.nip('duration_seconds', .95)} AS p95 FROM df WHERE {S.RAN} AND duration_seconds IS NOT NULL GROUP BY 1 ORDER BY p95 DESC, runs DESC, 1 LIMIT {top}")

# failures
FF = S.FAILED
add("x01_failed_runs", lambda df, jf: failures.failed_runs(df).select("dataflow_run_id", "failure_phase", "failure_message", "failure_category", "failure_signature", "failure_target"), "SELECT dataflow_run_id, failure_phase, failure_message, failure_category, failure_signature, failure_target FROM fails", FF)
CAUSES = S.FAILED + ", " + S.FJOBS + f", sg AS (SELECT failure_signature, failure_category, failure_phase, COUNT(*) AS k, {S.AJOBS} AS j, MAX(event_time) AS t FROM fails GROUP BY ALL), first AS (SELECT * FROM sg ORDER BY k DESC, j DESC, t DESC NULLS LAST, failure_signature LIMIT 1)"
FAILED_SHARE = "COALESCE(ROUND(100.0 * {} / NULLIF((SELECT COUNT(*) FROM fails), 0), 2), 0)"
JOB_RECORDS = f"(SELECT COUNT(*) FROM df) AS dataflow_records, (SELECT COUNT(*) FROM jf) AS job_records, (SELECT CAST(MIN(d) AS VARCHAR) FROM (SELECT run_date AS d FROM df UNION ALL SELECT run_date FROM jf)) AS date_min, (SELECT CAST(MAX(d) AS VARCHAR) FROM (SELECT run_date AS d FROM df UNION ALL SELECT run_date FROM jf)) AS date_max, (SELECT {S.ts('MAX(event_time)')} FROM df) AS latest_dataflow_log_at, (SELECT {S.ts('MAX(event_time)')} FROM jf) AS latest_job_log_at, (SELECT {S.ts('MAX(t)')} FROM (SELECT MAX(event_time) AS t FROM df UNION ALL SELECT MAX(event_time) FROM jf)) AS latest_log_at, (SELECT COUNT(DISTINCT NULLIF(engine_name, '')) FROM jf) AS active_engines, (SELECT COUNT(DISTINCT NULLIF(metadata_provider_name, '')) FROM jf) AS active_metadata_providers"
add("x09_failure_summary", lambda df, jf: failures.failure_summary(df, jf), f"SELECT {JOB_RECORDS}, (SELECT COUNT(*) FROM fails) AS failed_dataflows, (SELECT COUNT(*) FROM fails) AS total_failed_records, (SELECT {S.AJOBS} FROM fails) AS affected_dataflow_jobs, (SELECT COUNT(DISTINCT NULLIF(dataflow_id, '')) FROM fails) AS affected_dataflows, (SELECT COUNT(DISTINCT COALESCE(source_name, 'unknown') || '|' || COALESCE(destination_name, 'unknown')) FROM fails) AS affected_routes, (SELECT {S.ts('MAX(event_time)')} FROM fails) AS latest_failure_at, (SELECT {S.latest("COALESCE(NULLIF(dataflow_name, ''), job_id)")} FROM fails) AS latest_failure_name, COUNT(*) AS unique_signatures, COUNT(*) FILTER (k >= 2) AS repeated_signatures, CAST(COALESCE(SUM(k) FILTER (k >= 2), 0) AS BIGINT) AS repeated_failure_runs, {FAILED_SHARE.format('SUM(k) FILTER (k >= 2)')} AS repeated_failure_share, (SELECT COUNT(*) FROM fjobs) AS failed_jobs, (SELECT COUNT(*) FROM fjobs) AS failed_job_runs, (SELECT {S.AJOBS} FROM fjobs) AS affected_jobs, {', '.join(f"(SELECT COUNT(DISTINCT COALESCE(operation_types, '') || '|' || COALESCE(stages, '')) FROM fjobs) AS {x}" for x in ('affected_job_shapes', 'affected_job_contexts', 'affected_stages'))}, (SELECT COUNT(*) FROM jf WHERE normalized_status = 'succeeded') AS succeeded_jobs, (SELECT COUNT(*) FROM df WHERE normalized_status = 'succeeded') AS succeeded_dataflows, COALESCE((SELECT k FROM first), 0) AS top_cause_runs, {FAILED_SHARE.format('(SELECT k FROM first)')} AS top_cause_share, (SELECT failure_category FROM first) AS top_cause_category, (SELECT failure_phase FROM first) AS top_cause_phase, (SELECT failure_signature FROM first) AS top_cause_signature FROM sg", CAUSES)
TAGS = "array_to_string(list_sort(list_distinct(list_filter(list_concat(" + ", ".join(f"CASE WHEN regexp_matches(low, {chr(39)}{'|'.join(r[3]).replace(chr(39), chr(39) * 2)}{chr(39)}) THEN {[r[1], *r[4]]!r}::VARCHAR[] ELSE []::VARCHAR[] END" for r in S.BY_RANK) + "), lambda x: x <> failure_category)))[1:5], ',')"
add("x10_failed_records", lambda df, jf: failures.failed_records(df), f"SELECT dataflow_run_id, {S.ts('event_time')} AS event_time, failure_phase, failure_category, failure_message, failure_target, {S.rules('failure_message', 0, None, None, None)} AS rule_id, {TAGS} AS tags FROM pg", FF + ", pg AS (SELECT *, LOWER(TRIM(concat_ws(chr(10), NULLIF(TRIM(source_error_message), ''), NULLIF(TRIM(transform_error_message), ''), NULLIF(TRIM(destination_error_message), ''), NULLIF(TRIM(error_message), '')))) AS low FROM fails ORDER BY event_time DESC NULLS LAST, dataflow_run_id LIMIT 100)")
add("x11_repeated_signatures", lambda df, jf: failures.repeated_signatures(df), f"SELECT failure_signature, COUNT(*) AS failed_runs, {S.AJOBS} AS affected_jobs, COUNT(DISTINCT COALESCE(NULLIF(dataflow_id, ''), NULLIF(dataflow_name, ''))) AS affected_dataflows, {S.ts('MAX(event_time)')} AS latest_time, {S.latest('failure_message')} AS latest_error, {S.latest('failure_target')} AS failure_target FROM fails GROUP BY 1 ORDER BY 2 DESC, 3 DESC, MAX(event_time) DESC NULLS LAST, 1 LIMIT 30", FF)
add("x12_failure_by_endpoint", lambda df, jf: failures.failure_by_endpoint(df), f"SELECT {ENDS}, COUNT(*) AS failed_runs, {S.AJOBS} AS affected_jobs, {S.mode('failure_category')} AS failure_category, {S.mode('failure_phase')} AS failure_phase, COALESCE({S.mode('NULLIF(source_format, ' + repr('') + ')')}, 'unknown') AS source_format, {S.ts('MAX(event_time)')} AS latest_time FROM fails GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, MAX(event_time) DESC NULLS LAST, 1, 2 LIMIT 30", FF)
add("x13_category_phase_matrix", lambda df, jf: failures.category_phase_matrix(df), f"SELECT failure_category AS category, {S.BYPHASE}, COUNT(*) AS total FROM fails GROUP BY 1", FF)
add("x14_failures_by_stage", lambda df, jf: failures.failures_by_stage(df), f"SELECT {S.blank('stage')} AS name, {S.BYPHASE}, COUNT(*) AS count FROM fails GROUP BY 1 ORDER BY count DESC, name LIMIT 30", FF)
for column in ("source_connection_type", "failure_phase", "failure_category"):
    add(f"x15_failures_by_{column}", (lambda c: lambda df, jf: failures.failure_counts(df, c, 20))(column), f"SELECT {S.blank(column)} AS name, COUNT(*) AS count FROM fails GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", FF)
add("x16_top_failing_dataflows", lambda df, jf: failures.top_failing_dataflows(df), f"SELECT dataflow_id, {DNAME}, COUNT(*) AS error_count, {S.BYPHASE}, {S.AJOBS} AS affected_jobs, {S.latest('failure_message')} AS last_error, {S.ts('MAX(event_time)')} AS last_time FROM fails WHERE NULLIF(TRIM(dataflow_id), '') IS NOT NULL GROUP BY 1 ORDER BY 3 DESC, affected_jobs DESC, MAX(event_time) DESC NULLS LAST, 2, 1 LIMIT 30", FF)
add("x17_failure_trend", lambda df, jf: failures.failure_trend(df, jf), "SELECT CAST(run_date AS VARCHAR) AS run_date, COUNT(*) AS failed, CAST(SUM(j) AS BIGINT) AS failed_jobs, CAST(SUM(f) AS BIGINT) AS failed_dataflows FROM (SELECT run_date, 1 AS f, 0 AS j FROM df WHERE normalized_status = 'failed' UNION ALL SELECT run_date, 0, 1 FROM jf WHERE normalized_status = 'failed') GROUP BY 1")

# freshness
REG_COLS = "* REPLACE (" + ", ".join(f"{S.ts(c)} AS {c}" for c in ("latest_run_at", "latest_freshness_at", "watermark_time")) + ")"


def flat_registry(df: DataFrame) -> DataFrame:
    part = lambda name: F.array_join(F.transform("last_statuses", lambda x: x[name]), ",")
    return freshness.freshness_registry(df, AS_OF).withColumns({"last_runs": part("dataflow_run_id"), "last_statuses": part("status")})


add("r01_watermark_states", lambda df, jf: freshness.watermark_states(df).select("dataflow_run_id", "watermark_enabled", "movement_state", "adjustment_state"), "SELECT dataflow_run_id, watermark_enabled, movement_state, adjustment_state FROM etl", S.ETL)
add("r03_freshness_registry", lambda df, jf: flat_registry(df), f"SELECT {REG_COLS} FROM reg", S.REG)
add("r04_age_by_dataflow", registry(lambda r, _: freshness.age_by_dataflow(r)), f"SELECT dataflow_id, dataflow_name, source_name || ' -> ' || destination_name AS target, {S.ts('latest_freshness_at')} AS latest_freshness_at, latest_freshness_status, age_seconds, age_days FROM reg WHERE age_days IS NOT NULL ORDER BY age_days DESC, dataflow_name, dataflow_id LIMIT 200", S.REG)
MOVED = lambda m: f"movement_state = '{m}'"
MOVES = ("advanced", "initialized", "unchanged", "incomplete", "invalid")
ADV = S.pct("COUNT(*) FILTER (movement_state = 'advanced')", "COUNT(*) FILTER (movement_state IN ('advanced','unchanged'))")
RUN_COUNTS = {"successful_runs": "= 'succeeded'", "freshness_runs": "IN ('succeeded', 'skipped')", "failed_runs": "= 'failed'", "skipped_runs": "= 'skipped'"}
AGES = ", ".join(f"COALESCE(CAST(MIN({c}) AS DOUBLE), 0) AS min_{c}, COALESCE(CAST(MAX({c}) AS DOUBLE), 0) AS max_{c}, {S.nip(c, .5)} AS p50_{c}, {S.nip(c, .95)} AS p95_{c}" for c in ("age_days", "age_seconds"))
add(
    "r05_freshness_summary",
    lambda df, jf: freshness.freshness_summary(df, jf, AS_OF),
    f"""SELECT * REPLACE ({', '.join(f'{S.ts(c)} AS {c}' for c in TIMES)}, CAST(date_min AS VARCHAR) AS date_min, CAST(date_max AS VARCHAR) AS date_max) FROM (SELECT *, GREATEST(latest_dataflow_log_at, latest_job_log_at) AS latest_log_at, latest_watermark_invalid_dataflows + latest_watermark_incomplete_dataflows AS latest_watermark_issue_dataflows FROM
     (SELECT COUNT(*) AS dataflow_records, MIN(run_date) AS date_min, MAX(run_date) AS date_max, MAX(event_time) AS latest_dataflow_log_at, COUNT(DISTINCT NULLIF(engine_name, 'unknown')) AS active_engines, COUNT(DISTINCT NULLIF(metadata_provider_name, 'unknown')) AS active_metadata_providers FROM df),
     (SELECT COUNT(*) AS job_records, MAX(event_time) AS latest_job_log_at FROM jf),
     (SELECT {', '.join(S.n(f'normalized_status {c}', k) for k, c in RUN_COUNTS.items())}, COUNT(*) FILTER (NOT COALESCE({S.NOID}, false)) AS missing_dataflow_id_runs, {', '.join(S.n(MOVED(m), f'watermark_{m}_runs') for m in MOVES)}, {S.n("adjustment_state = 'adjusted'", 'watermark_adjusted_runs')}, {ADV} AS watermark_advanced_rate FROM etl),
     (SELECT COUNT(*) AS observed_dataflows, COUNT(latest_freshness_at) AS dataflows_with_freshness_evidence, COUNT(*) FILTER (latest_status NOT IN ('succeeded','skipped')) AS latest_status_issue_dataflows, {S.n(MOVED('invalid'), 'latest_watermark_invalid_dataflows')}, {S.n(MOVED('incomplete'), 'latest_watermark_incomplete_dataflows')},
       COUNT(*) FILTER (watermark_enabled) AS watermark_enabled_dataflows, {S.pct('COUNT(*) FILTER (watermark_enabled)', 'COUNT(*)')} AS watermark_coverage_rate, COUNT(*) FILTER (skipped_streak >= 3) AS skipped_streak_dataflows, CAST(SUM(is_stale) AS BIGINT) AS stale_dataflows, {S.pct('SUM(is_stale)', 'COUNT(*)')} AS stale_dataflow_rate, {AGES} FROM reg))""",
    S.REG,
)
MV2 = ", ".join(S.n(f"movement_state = '{m}'", m) for m in ("advanced", "initialized", "unchanged", "incomplete", "invalid"))
add("r06_watermark_trend", lambda df, jf: freshness.watermark_trend(df, "month"), f"SELECT {S.trunc('month')} AS bucket_start, {MV2}, {S.n('adjustment_state = ' + repr('adjusted'), 'adjusted')}, COUNT(*) AS runs, {ADV} AS advanced_rate FROM etl WHERE watermark_enabled AND event_time IS NOT NULL GROUP BY 1", S.ETL)
add("r07_age_distribution", registry(lambda r, _: freshness.age_distribution(r)), "SELECT CASE WHEN age_days IS NULL THEN 'Unknown' WHEN age_days <= 1 THEN '<=1d' WHEN age_days <= 3 THEN '1-3d' WHEN age_days <= 7 THEN '3-7d' WHEN age_days <= 30 THEN '7-30d' ELSE '>30d' END AS bucket, COUNT(*) AS dataflows FROM reg GROUP BY 1", S.REG)
add("r08_coverage_by_stage", lambda df, jf: freshness.coverage_by_stage(df), f"SELECT {S.blank('stage')} AS stage, COUNT(DISTINCT dataflow_id) AS dataflows, COUNT(DISTINCT dataflow_id) FILTER (watermark_enabled) AS watermark_enabled, {S.pct('COUNT(DISTINCT dataflow_id) FILTER (watermark_enabled)', 'COUNT(DISTINCT dataflow_id)')} AS coverage_rate FROM etl WHERE dataflow_id IS NOT NULL GROUP BY 1", S.ETL)
add("r09_streak_distribution", registry(lambda r, _: freshness.streak_distribution(r)), "SELECT CASE WHEN skipped_streak = 1 THEN '1' WHEN skipped_streak <= 3 THEN '2-3' WHEN skipped_streak <= 7 THEN '4-7' ELSE '>7' END AS bucket, COUNT(*) AS dataflows FROM reg WHERE skipped_streak > 0 GROUP BY 1", S.REG)
add("r10_movement_evidence", lambda df, jf: freshness.movement_evidence(df), f"SELECT dataflow_run_id, dataflow_id, {S.ts('event_time')} AS event_time, movement_state, adjustment_state, normalized_status, {S.B}, {S.A}, {S.E} FROM etl WHERE watermark_enabled AND dataflow_id IS NOT NULL ORDER BY etl.event_time DESC NULLS LAST, dataflow_run_id LIMIT 100", S.ETL)
add("r11_evidence_page", registry(lambda r, _: freshness.evidence_page(r, offset=10)), "SELECT dataflow_id, latest_status, movement_state, age_days, run_count, skipped_streak FROM reg ORDER BY age_days DESC NULLS LAST, dataflow_id LIMIT 25 OFFSET 10", S.REG)
# a time from which all runs of some dataflows are skipped
def late() -> Column:
    return (F.col("event_time") >= F.to_timestamp(F.lit("2001-09-01"))) & F.col("dataflow_id").startswith("df-1")
QUIET = S.REG.replace("FROM df WHERE", "FROM dq WHERE")
DQ = "dq AS (SELECT * REPLACE (IF(event_time >= TIMESTAMP '2001-09-01' AND dataflow_id LIKE 'df-1%', 'skipped', normalized_status) AS normalized_status) FROM df)"
add("t11_skipped_patterns", lambda df, jf: freshness.skipped_patterns(freshness.freshness_registry(df.withColumn("normalized_status", F.when(late(), "skipped").otherwise(F.col("normalized_status"))), AS_OF)), f"SELECT dataflow_id, skipped_streak, {S.ts('latest_run_at')} AS latest_run_at FROM reg WHERE skipped_streak >= 3 ORDER BY skipped_streak DESC, dataflow_id LIMIT 50", DQ + ", " + QUIET)
add("t12_stale_candidates", registry(lambda r, _: freshness.stale_candidates(r)), "SELECT dataflow_id, age_days, latest_status FROM reg WHERE is_stale = 1 ORDER BY age_days DESC, dataflow_id LIMIT 50", S.REG)

# performance
add("e02_thresholds", lambda df, jf: performance.thresholds(performance.measures(df)), "SELECT * FROM thr", S.MEAS)
add("e04_optimization_candidates", lambda df, jf: performance.optimization_candidates(df).select("dataflow_run_id", "bottleneck_phase", "candidate_code", "candidate_priority"), "SELECT dataflow_run_id, bottleneck_phase, candidate_code, candidate_priority FROM cand", S.CAND)
PF = ("slow_small_workload", "slow_small_maintenance", "high_overhead", "phase_skew")
SLOW = "{'d': duration_seconds, 'r': dataflow_run_id}"
RUN = {"dataflow_name": "dataflow_name", "dataflow_id": "dataflow_id", "dataflow_run_id": "dataflow_run_id", "job_id": "job_id", "stage": "stage", "operation_type": "operation_group", "status": "normalized_status"}
RECORDS = f"(SELECT COUNT(*) FROM df) AS dataflow_records, (SELECT COUNT(*) FROM jf) AS job_records, (SELECT CAST(MIN(run_date) AS VARCHAR) FROM df) AS date_min, (SELECT CAST(MAX(run_date) AS VARCHAR) FROM df) AS date_max, (SELECT {S.ts('MAX(event_time)')} FROM df) AS latest_dataflow_log_at, (SELECT {S.ts('MAX(event_time)')} FROM jf) AS latest_job_log_at, (SELECT {S.ts('MAX(t)')} FROM (SELECT MAX(event_time) AS t FROM df UNION ALL SELECT MAX(event_time) FROM jf)) AS latest_log_at, (SELECT COUNT(DISTINCT NULLIF(engine_name, 'unknown')) FROM df) AS active_engines, (SELECT COUNT(DISTINCT NULLIF(metadata_provider_name, 'unknown')) FROM df) AS active_metadata_providers"
add("e05_performance_summary", lambda df, jf: performance.performance_summary(df, jf), f"SELECT {RECORDS}, COUNT(*) AS run_count, {S.avg('duration_seconds')} AS avg_duration_seconds, COALESCE(MAX(duration_seconds), 0) AS max_duration_seconds, COALESCE(MAX(duration_seconds), 0) AS slowest_run_duration_seconds, {', '.join(f'arg_max({c}, {SLOW}) AS slowest_run_{n}' for n, c in RUN.items())}, CAST(NULL AS VARCHAR) AS slowest_run_start_time, CAST(NULL AS VARCHAR) AS slowest_run_end_time, CASE WHEN SUM(source_phase) >= GREATEST(SUM(transform_phase), SUM(destination_phase), SUM(overhead_phase)) THEN 'source' WHEN SUM(transform_phase) >= GREATEST(SUM(destination_phase), SUM(overhead_phase)) THEN 'transform' WHEN SUM(destination_phase) >= SUM(overhead_phase) THEN 'destination' WHEN SUM(overhead_phase) > 0 THEN 'overhead' ELSE 'unknown' END AS bottleneck_phase, {', '.join(f'{S.pct(f'SUM({p}_phase)', 'SUM(phase_total)')} AS {p}_duration_percent' for p in C.PHASES)}, COALESCE(ROUND(CAST(SUM(source_rows_read) AS DOUBLE) / NULLIF(SUM(duration_seconds), 0), 3), 0) AS rows_read_per_second, CAST(COALESCE(SUM(source_rows_read), 0) AS BIGINT) AS total_rows_read, CAST(COALESCE(SUM(destination_rows_written), 0) AS BIGINT) AS total_rows_written, COUNT(candidate_code) AS optimization_candidate_count, {', '.join(S.n(x, x + '_count') for x in PF)}, {', '.join(f'{S.nip('duration_seconds', q / 100)} AS p{q}_duration_seconds' for q in (50, 75, 95, 99))} FROM cand", S.CAND)
EP = "dataflow_run_id, operation_group, duration_seconds, rows_processed, maintenance_bytes, maintenance_files, bottleneck_phase, candidate_code, candidate_priority"
add("e06_efficiency_points", lambda df, jf: performance.efficiency_points(df), f"SELECT {EP} FROM cand ORDER BY candidate_priority DESC, duration_seconds DESC, event_time DESC NULLS LAST, dataflow_run_id LIMIT 200", S.CAND)
add("e07_profiles", lambda df, jf: performance.profiles(df), f"SELECT dataflow_id, {DNAME}, {S.mode('operation_group')} AS operation_type, COUNT(*) AS runs, {S.avg('duration_seconds')} AS avg_duration, MAX(duration_seconds) AS max_duration, {S.mode('bottleneck_phase')} AS bottleneck_phase, COUNT(candidate_code) AS candidates, {S.nip('duration_seconds', .5)} AS p50_duration, {S.nip('duration_seconds', .95)} AS p95_duration FROM cand WHERE {S.NOID} GROUP BY 1 ORDER BY p95_duration DESC, runs DESC, 1 LIMIT 40", S.CAND)
add("e08_context_profiles", lambda df, jf: performance.context_profiles(df), f"SELECT {', '.join(f'{S.known(c)} AS {c}' for c in ('platform_name', 'engine_name', 'metadata_provider_name'))}, COUNT(*) AS runs, COUNT(*) FILTER (normalized_status = 'failed') AS failed, {S.avg('duration_seconds')} AS avg_duration, ROUND(CAST(SUM(source_rows_read) AS DOUBLE) / NULLIF(SUM(duration_seconds), 0), 3) AS rows_per_second, COUNT(candidate_code) AS candidates, {S.nip('duration_seconds', .95)} AS p95_duration FROM cand GROUP BY 1, 2, 3 ORDER BY candidates DESC, p95_duration DESC, runs DESC, 1, 2, 3 LIMIT 30", S.CAND)
add("e09_performance_trend", lambda df, jf: performance.performance_trend(df, "month"), f"SELECT {S.trunc('month')} AS bucket_start, COUNT(*) AS runs, COUNT(candidate_code) AS candidates, {S.nip('duration_seconds', .5)} AS p50_duration, {S.nip('duration_seconds', .95)} AS p95_duration FROM cand WHERE event_time IS NOT NULL GROUP BY 1", S.CAND)
add("e10_evidence_page", lambda df, jf: performance.evidence_page(df, offset=5), "SELECT dataflow_run_id, candidate_code, candidate_priority, duration_seconds, bottleneck_phase FROM cand WHERE candidate_code IS NOT NULL ORDER BY candidate_priority DESC, duration_seconds DESC, dataflow_run_id LIMIT 25 OFFSET 5", S.CAND)
add("t07_duration_breakdown", lambda df, jf: performance.duration_breakdown(df), "SELECT dataflow_run_id, duration_seconds, source_phase, transform_phase, destination_phase, overhead_phase FROM meas ORDER BY duration_seconds DESC, dataflow_run_id LIMIT 30", S.MEAS)
add("t07_duration_vs_rows", lambda df, jf: performance.duration_vs_rows(df), "SELECT dataflow_run_id, duration_seconds, rows_processed FROM meas WHERE rows_processed > 0 ORDER BY duration_seconds DESC, rows_processed DESC, dataflow_run_id LIMIT 200", S.MEAS)
add("t10_stratified_points", lambda df, jf: performance.stratified_points(df), "SELECT dataflow_run_id, is_maintenance, duration_seconds, candidate_priority FROM (SELECT *, r > CASE WHEN is_maintenance THEN 50 ELSE 150 END AS extra FROM (SELECT *, operation_group = 'maintenance' AS is_maintenance, row_number() OVER (PARTITION BY operation_group = 'maintenance' ORDER BY candidate_priority DESC, duration_seconds DESC, dataflow_run_id) AS r FROM cand)) ORDER BY extra, r, dataflow_run_id LIMIT 200", S.CAND)

# volume
add("v01_volume_rows", lambda df, jf: volume.volume_rows(df).select("dataflow_run_id", "est_rows_written", "is_lakehouse", "net_bytes", "files_changed"), "SELECT dataflow_run_id, est_rows_written, is_lakehouse, net_bytes, files_changed FROM vrows", S.VROWS)
add("v02_run_candidates", lambda df, jf: volume.run_candidates(df), "SELECT dataflow_run_id, dataflow_id, candidate_kind, ROUND(candidate_ratio, 6) AS candidate_ratio FROM vs WHERE candidate_ratio > 0 ORDER BY vs.candidate_ratio DESC, dataflow_run_id LIMIT 100", S.VROWS + ", " + S.scored("vrows", "vs"))
VM = ", ".join(S.VM.values())
VF = S.VROWS + ", " + S.VFLOWS + ", " + S.scored("vflows", "vfs")
add("v03_dataflow_candidates", lambda df, jf: volume.dataflow_candidates(df), f"SELECT dataflow_id, {VM}, candidate_kind, ROUND(candidate_ratio, 6) AS candidate_ratio FROM vfs", VF)
HIGH = {"rows": "read", "est_rows": "est_rows", "lakehouse_rows": "lakehouse_rows", "bytes": "bytes", "files": "files"}
VTOTAL = {"rows_read": "source_rows_read", "rows_written": "destination_rows_written", "est_rows_written": "est_rows_written", "rows_inserted": "destination_rows_inserted", "rows_updated": "destination_rows_updated", "rows_deleted": "destination_rows_deleted", "bytes_added": "destination_bytes_added", "bytes_removed": "destination_bytes_removed", "bytes_saved": "destination_bytes_saved"}
add("v04_volume_summary", lambda df, jf: volume.volume_summary(df, jf), f"SELECT {RECORDS}, {', '.join(f'{S.s(c)} AS total_{n}' for n, c in VTOTAL.items())}, {S.s('est_rows_written')} - {S.s('destination_rows_written')} AS total_est_rows_written_non_lakehouse, {S.s('destination_files_added')} AS files_added, {S.s('destination_files_removed')} AS files_removed, {S.s('destination_bytes_added')} - {S.s('destination_bytes_removed')} AS net_bytes_change, COALESCE(ROUND(SUM(destination_bytes_added) / NULLIF(SUM(destination_files_added), 0), 3), 0) AS avg_bytes_per_file_added, COUNT(*) FILTER (is_lakehouse) AS lakehouse_destination_run_count, {S.pct('COUNT(*) FILTER (is_lakehouse)', 'COUNT(*)')} AS lakehouse_destination_share, {S.n("normalized_status = 'skipped'", 'skip_count')}, {S.pct("COUNT(*) FILTER (normalized_status = 'skipped')", 'COUNT(*)')} AS skip_rate, COUNT(*) FILTER (candidate_ratio > 0) AS high_volume_run_count, COUNT(*) FILTER (candidate_ratio > 0) AS high_volume_candidate_run_count, {', '.join(S.n(f'candidate_kind = {m!r}', f'high_volume_{n}_count') for n, m in HIGH.items())}, (SELECT COUNT(*) FROM vfs WHERE candidate_ratio > 0) AS high_volume_dataflow_count FROM vs", VF + ", " + S.scored("vrows", "vs"))
add("v05_volume_trend", lambda df, jf: volume.volume_trend(df, "month"), f"SELECT {S.trunc('month')} AS bucket_start, COUNT(*) AS runs, {S.VSUMS2} FROM vrows WHERE event_time IS NOT NULL GROUP BY 1", S.VROWS)
LOADED = "COALESCE(NULLIF(destination_load_type, ''), NULLIF(destination_operation_type, ''), 'unknown')"
SKIPPED = S.n("normalized_status = 'skipped'", "skipped")
add("v06_workload_mix", lambda df, jf: volume.workload_mix(df), f"SELECT {S.blank('operation_type')} || ' · ' || {LOADED} AS workload, COUNT(*) AS runs, {SKIPPED}, {S.VSUMS2} FROM vrows GROUP BY 1 ORDER BY {S.s('source_rows_read')} DESC, SUM(vrows.est_rows_written) DESC, {S.s('destination_bytes_added')} + {S.s('destination_bytes_removed')} DESC, runs DESC, 1 LIMIT 100", S.VROWS)
add("v06_load_mix", lambda df, jf: volume.load_mix(df), f"SELECT {LOADED} AS load_type, COUNT(*) AS runs, {S.VSUMS2} FROM vrows GROUP BY 1 ORDER BY SUM(vrows.est_rows_written) DESC, 1 LIMIT 100", S.VROWS)
add("v07_route_volume", lambda df, jf: volume.route_volume(df), f"SELECT {ENDS}, COUNT(*) AS runs, {SKIPPED}, {', '.join(f"COALESCE({S.mode(f'NULLIF({c}, {S.EMPTY})')}, 'unknown') AS {c}" for c in ('source_format', 'destination_format', 'source_connection_type', 'destination_connection_type'))}, {S.VSUMS2} FROM vrows GROUP BY 1, 2 ORDER BY {S.s('source_rows_read')} DESC, SUM(vrows.est_rows_written) DESC, runs DESC, 1, 2 LIMIT 100", S.VROWS)
RANKED = {"rows_read": "source_rows_read", "est_rows_written": "est_rows_written", "rows_written": "destination_rows_written", "bytes_added": "destination_bytes_added", "net_bytes": "signed_net_bytes"}
add("v08_top_dataflows", lambda df, jf: volume.top_dataflows_by_metric(df), "SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE metric WHEN 'net_bytes' THEN ABS(value) ELSE value END DESC, name, dataflow_id) AS rank FROM (" + " UNION ALL ".join(f"SELECT dataflow_id, {DNAME.removesuffix(' AS dataflow_name')} AS name, COUNT(*) AS count, '{m}' AS metric, {S.s(c)} AS value FROM vrows WHERE {S.NOID} GROUP BY 1" for m, c in RANKED.items()) + ") QUALIFY rank <= 20", S.VROWS)
VTIMED = f"SELECT * EXCLUDE (latest_run_at), {S.ts('latest_run_at')} AS latest_run_at FROM vreg"


def volumes(df: DataFrame) -> DataFrame:
    """The registry with reasons as text, without signals, which have a query of their own."""
    return volume.volume_registry(df).drop("volume_candidate_signals").withColumn("candidate_run_reasons", F.array_join("candidate_run_reasons", ", "))


add("v09_volume_registry", lambda df, jf: volumes(df), VTIMED, S.VREG)
add("v09_volume_signals", lambda df, jf: volume.volume_registry(df).select("dataflow_id", F.inline("volume_candidate_signals")), "SELECT * FROM vsig", S.VREG)
PAGE = ("dataflow_id", "dataflow_name", "run_count", "volume_rows_read", "peak_rows_read", "candidate_run_count", "volume_candidate_kind", "volume_candidate_priority")
add("v10_evidence_page", lambda df, jf: volume.evidence_page(df, offset=10).select(*PAGE), f"SELECT {', '.join(PAGE)} FROM vreg ORDER BY volume_candidate_priority DESC NULLS LAST, dataflow_id LIMIT 25 OFFSET 10", S.VREG)
add("v10_evidence_page_by_bytes", lambda df, jf: volume.evidence_page(df, "volume_net_bytes", True).select(*PAGE), f"SELECT {', '.join(PAGE)} FROM vreg ORDER BY volume_net_bytes NULLS LAST, dataflow_id LIMIT 25", S.VREG)

# maintenance
add("m01_classify", lambda df, jf: maintenance.classify(df).select("dataflow_run_id", "target", "is_maintenance", "is_active", "is_no_op"), "SELECT dataflow_run_id, target, is_maintenance, is_active, is_no_op FROM mt", S.MAINT)
#: Columns of the registry that are others by a second name, and what is told of times.
AGAIN = f"target AS \"table\", CASE WHEN position('::' IN target) > 0 THEN split_part(target, '::', 2) ELSE target END AS target_display, destination_name AS destination_connection_name, destination_format AS format, mreg.latest_status AS status, bytes_reclaimed AS bytes_removed, COALESCE(ROUND(bytes_reclaimed / NULLIF(duration_seconds, 0), 3), 0) AS bytes_reclaimed_per_second, maintenance_lag_seconds > 604800 AS maintenance_lag_warning, 7 AS maintenance_lag_warning_days, {S.ts('mt')} AS latest_maintenance_time, {S.ts('wt')} AS latest_etl_write_time"
WRITERS = "(SELECT target, string_agg(COALESCE(dataflow_id, 'unknown') || ' (' || run_count || ')', ', ' ORDER BY dataflow_name, dataflow_id NULLS FIRST) AS w FROM ups GROUP BY 1)"


def tables(df: DataFrame) -> DataFrame:
    """The registry with writers as text; their rows have a query of their own."""
    one = lambda x: F.concat(F.coalesce(x["dataflow_id"], F.lit("unknown")), F.lit(" ("), x["run_count"].cast("string"), F.lit(")"))
    return maintenance.registry(df).withColumn("upstream_dataflows", F.array_join(F.transform("upstream_dataflows", one), ", "))


add("m02_registry", lambda df, jf: tables(df), f"SELECT mreg.* EXCLUDE (mt, wt), {AGAIN}, COALESCE(w, '') AS upstream_dataflows FROM mreg LEFT JOIN {WRITERS} u USING (target)", S.MREG)
add("m03_upstream_dataflows", lambda df, jf: maintenance.upstream_dataflows(df), f"SELECT * EXCLUDE (latest_time), {S.ts('latest_time')} AS latest_time FROM ups", S.MREG)
ACTIVE = "active_lakehouse_table AND maintained_table"
add("m04_summary", lambda df, jf: maintenance.summary(df, jf), f"SELECT {RECORDS}, a.*, b.*, (SELECT COUNT(*) FROM mt, (SELECT {S.nip('duration_seconds', .95, 'duration_seconds > 0')} AS p FROM mt WHERE is_maintenance) WHERE is_maintenance AND p > 0 AND duration_seconds >= p) AS high_duration_runs FROM (SELECT COUNT(*) AS total_maintenance_runs, {', '.join(S.n(f'normalized_status = {x!r}', x + '_ops') for x in S.ST)}, {S.s('destination_files_removed')} AS files_removed, {S.s('destination_bytes_removed')} AS bytes_reclaimed, {S.s('destination_bytes_saved')} AS bytes_saved, COALESCE(SUM(duration_seconds), 0) AS duration_seconds, COALESCE(SUM(duration_seconds) FILTER (normalized_status = 'succeeded'), 0) AS succeeded_duration_seconds, COUNT(*) FILTER (is_no_op) AS no_op_runs FROM mt WHERE is_maintenance) a, (SELECT {S.n('no_op_runs > 0', 'no_op_tables')}, COALESCE(SUM(no_op_duration_seconds), 0) AS no_op_duration_seconds, {S.n('bytes_reclaimed > 0 OR files_removed > 0', 'tables_with_reclaim')}, {S.n("table_health = 'has_issues'", 'tables_with_issues')}, {S.n("table_health = 'warning'", 'tables_with_warnings')}, {S.n("latest_status = 'failed'", 'latest_failed_tables')}, {S.n("latest_status = 'skipped'", 'latest_skipped_tables')}, {S.n("latest_status IN ('running', 'pending')", 'latest_active_tables')}, {S.n('maintenance_lag_seconds > 604800', 'lagged_tables')}, {S.n('active_lakehouse_table', 'active_lakehouse_tables')}, {S.n(ACTIVE, 'maintained_tables')}, {S.n('active_lakehouse_table AND NOT maintained_table', 'coverage_missing_tables')}, {S.pct(f'COUNT(*) FILTER ({ACTIVE})', 'COUNT(*) FILTER (active_lakehouse_table)')} AS coverage_rate FROM mreg) b", S.MREG)
add("m05_status_trend", lambda df, jf: maintenance.status_trend(df, "month"), f"SELECT {S.trunc('month')} AS bucket_start, COUNT(*) AS runs, {S.sts()} FROM mt WHERE is_maintenance AND event_time IS NOT NULL GROUP BY 1", S.MAINT)
add("m05_reclaim_trend", lambda df, jf: maintenance.reclaim_trend(df, "month"), f"SELECT {S.trunc('month')} AS bucket_start, {S.s('destination_files_removed')} AS files_removed, {S.s('destination_bytes_removed')} AS bytes_reclaimed, {S.s('destination_bytes_saved')} AS bytes_saved FROM mt WHERE is_maintenance AND event_time IS NOT NULL GROUP BY 1", S.MAINT)
add("m06_by_format", lambda df, jf: maintenance.by_format(df), f"SELECT {S.blank('destination_format')} AS format, COUNT(*) AS runs, COUNT(*) FILTER (normalized_status = 'failed') AS failed, {S.s('destination_files_removed')} AS files_removed, {S.s('destination_bytes_removed')} AS bytes_reclaimed FROM mt WHERE is_maintenance GROUP BY 1", S.MAINT)
TABLE = ("target", "attention_priority", "table_health", "attention_reason", "bytes_reclaimed", "maintenance_lag_seconds", "latest_status")
add("m07_evidence_page", lambda df, jf: maintenance.evidence_page(df).select(*TABLE), f"SELECT {', '.join(TABLE)} FROM mreg ORDER BY attention_priority DESC, bytes_reclaimed DESC, files_removed DESC, COALESCE(mt, wt) DESC NULLS LAST, target LIMIT 25", S.MREG)

# diagnostics
add("q01_job_linkage", lambda df, jf: diagnostics.job_linkage(df, jf), f"SELECT job_id, dataflows, jobs, {S.ts('latest_time')} AS latest_time, linkage FROM link", S.LINK)
add("q01_linkage_summary", lambda df, jf: diagnostics.linkage_summary(df, jf), "SELECT linkage, COUNT(*) AS jobs, CAST(SUM(dataflows) AS BIGINT) AS dataflows FROM link GROUP BY 1", S.LINK)
add("q02_linkage_evidence", lambda df, jf: diagnostics.linkage_evidence(df, jf), f"SELECT linkage, row_number() OVER (PARTITION BY linkage ORDER BY link.latest_time DESC NULLS LAST, job_id) AS r, job_id, dataflows, {S.ts('latest_time')} AS latest_time FROM link QUALIFY r <= 200", S.LINK)
add("q03_reconciliation", lambda df, jf: diagnostics.reconciliation(jf, df), "SELECT metric, COUNT(*) AS mismatches, CAST(SUM(ABS(difference)) AS BIGINT) AS difference, COUNT(DISTINCT job_id) AS affected_jobs FROM mis GROUP BY 1", S.COMPARE)
add("q03_reconciliation_checks", lambda df, jf: diagnostics.reconciliation_checks(jf, df), "SELECT job_id, metric, expected, observed, difference, COUNT(*) OVER () AS mismatch_count FROM mis ORDER BY job_id, metric LIMIT 50", S.COMPARE)
add("q06_linkage_trend", lambda df, jf: diagnostics.linkage_trend(df, jf), f"SELECT {S.ts('COALESCE(r.b, l.b)')} AS bucket_start, COALESCE(dataflow_records, 0) AS dataflow_records, COALESCE(job_records, 0) AS job_records, COALESCE(matched, 0) AS matched, COALESCE(orphan, 0) AS orphan, COALESCE(job_only, 0) AS job_only, {S.pct('COALESCE(matched, 0)', '(matched + orphan + job_only)')} AS linkage_rate FROM rc r LEFT JOIN lk l ON r.b IS NOT DISTINCT FROM l.b", f"rc AS (SELECT b, COUNT(*) FILTER (k = 1) AS dataflow_records, COUNT(*) FILTER (k = 2) AS job_records FROM (SELECT CAST(date_trunc('month', event_time) AS TIMESTAMP) AS b, 1 AS k FROM df UNION ALL SELECT CAST(date_trunc('month', event_time) AS TIMESTAMP), 2 FROM jf) GROUP BY 1), ka AS (SELECT DISTINCT CAST(date_trunc('month', event_time) AS TIMESTAMP) AS b, {S.CLEAN} AS id FROM df WHERE ({S.CLEAN}) IS NOT NULL), kb AS (SELECT DISTINCT CAST(date_trunc('month', event_time) AS TIMESTAMP) AS b, {S.CLEAN} AS id FROM jf WHERE ({S.CLEAN}) IS NOT NULL), lk AS (SELECT COALESCE(ka.b, kb.b) AS b, COUNT(*) FILTER (ka.id IS NOT NULL AND kb.id IS NOT NULL) AS matched, COUNT(*) FILTER (kb.id IS NULL) AS orphan, COUNT(*) FILTER (ka.id IS NULL) AS job_only FROM ka FULL OUTER JOIN kb ON ka.b IS NOT DISTINCT FROM kb.b AND ka.id = kb.id GROUP BY 1)")
FIELD = "fields AS (" + " UNION ALL ".join(f"SELECT '{name}' AS field, {str(u).lower()} AS universal, COUNT(*) FILTER (COALESCE({', '.join(f'NULLIF(TRIM(CAST({c} AS VARCHAR)), {chr(39) * 2})' for c in cs)}) IS NOT NULL) AS present, COUNT(*) AS rows FROM df" for name, cs, u in diagnostics.FIELDS) + "), fc AS (SELECT field, present, rows, ROUND(100.0 * present / NULLIF(rows, 0), 2) AS percent, CASE WHEN NOT universal THEN 'info' WHEN 100.0 * present / rows < 80 THEN 'bad' WHEN 100.0 * present / rows < 95 THEN 'warning' ELSE 'ok' END AS severity FROM fields)"
add("q04_field_completeness", lambda df, jf: diagnostics.field_completeness(df), "SELECT * FROM fc", FIELD)
BOTH = "(SELECT _source_id, _file_uri, _file_kind, event_time, _ingested_at, 1 AS f FROM df UNION ALL SELECT _source_id, _file_uri, _file_kind, event_time, _ingested_at, 0 FROM jf)"
add("q05_source_coverage", lambda df, jf: diagnostics.source_coverage(df, jf), f"SELECT _source_id, MAX(_file_kind) AS file_kind, COUNT(DISTINCT _file_uri) AS file_count, CAST(SUM(f) AS BIGINT) AS dataflow_records, CAST(SUM(1 - f) AS BIGINT) AS job_records, COUNT(*) AS records, {S.ts('MAX(event_time)')} AS latest_log_at, {S.ts('MAX(_ingested_at)')} AS latest_ingested_at FROM {BOTH} GROUP BY 1")
add("q06_record_trend", lambda df, jf: diagnostics.record_trend(df, jf), f"SELECT {S.ts('b')} AS bucket_start, COALESCE(x, 0) AS dataflow_records, COALESCE(y, 0) AS job_records FROM (SELECT unnest(generate_series(MIN(b), MAX(b), INTERVAL 1 MONTH)) AS b FROM (SELECT b FROM fa UNION ALL SELECT b FROM fb)) LEFT JOIN fa USING (b) LEFT JOIN fb USING (b)", "fa AS (SELECT CAST(date_trunc('month', event_time) AS TIMESTAMP) AS b, COUNT(*) AS x FROM df WHERE event_time IS NOT NULL GROUP BY 1), fb AS (SELECT CAST(date_trunc('month', event_time) AS TIMESTAMP) AS b, COUNT(*) AS y FROM jf WHERE event_time IS NOT NULL GROUP BY 1)")
DIAG = ", ".join([S.LINK, S.COMPARE, FIELD])
add("q07_diagnostics_summary", lambda df, jf: diagnostics.diagnostics_summary(df, jf), f"SELECT *, CASE WHEN dataflow_records = 0 AND job_records = 0 THEN 'no_evidence' WHEN orphan + job_only + mismatches > 0 THEN 'has_issues' WHEN dataflow_records = 0 OR job_records = 0 THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT {', '.join(S.n(f'linkage = {k!r}', k) for k in ('matched', 'orphan', 'job_only'))}, {S.pct('COUNT(*) FILTER (linkage = ' + repr('matched') + ')', 'COUNT(*)')} AS readiness_rate, (SELECT COUNT(*) FROM mis) AS mismatches, (SELECT COUNT(*) FROM fc WHERE severity = 'bad') AS bad_fields, (SELECT COUNT(*) FROM fc WHERE severity = 'warning') AS warned_fields, (SELECT COUNT(*) FROM df) AS dataflow_records, (SELECT COUNT(*) FROM jf) AS job_records FROM link)", DIAG)
QUEUE = """SELECT 'bad' AS severity, 'orphan dataflow job id' AS category, 'Dataflow records reference a job_id with no matching job log.' AS issue, job_id AS target, latest_time, '{"job_id":"' || job_id || '","dataflow_records":' || dataflows || '}' AS evidence, 'Check job_run_log coverage for the same run window.' AS action_hint FROM link WHERE linkage = 'orphan'
 UNION ALL SELECT 'warning', 'job without dataflows', 'Job log exists but no child dataflow records were found.', job_id, latest_time, '{"job_id":"' || job_id || '","job_total_dataflows":' || CAST(COALESCE((SELECT MAX(total_dataflows) FROM jf WHERE TRIM(jf.job_id) = link.job_id), 0) AS BIGINT) || '}', 'Check dataflow_run_log coverage and cache sync for this job.' FROM link WHERE linkage = 'job_only'
 UNION ALL (SELECT 'warning', 'reconciliation mismatch', metric || ' expected ' || expected || ' but observed ' || observed || '.', job_id, NULL, '{"job_id":"' || job_id || '","metric":"' || metric || '","expected":' || expected || ',"observed":' || observed || ',"difference":' || difference || '}', 'Inspect the job drawer and child dataflow records.' FROM mis ORDER BY job_id, metric LIMIT 50)
 UNION ALL SELECT severity, 'field completeness', 'dataflow ' || field || ' completeness is ' || CAST(percent AS DOUBLE) || '%.', 'dataflow · ' || field, NULL, '{"field":"' || field || '","present":' || present || ',"rows":' || rows || '}', 'Confirm the log version emits the fields used by Monitoring pages.' FROM fc WHERE severity IN ('bad', 'warning')"""
add("q08_investigation_queue", lambda df, jf: diagnostics.investigation_queue(df, jf), f"SELECT severity, category, issue, target, {S.ts('latest_time')} AS latest_time, evidence, action_hint FROM (SELECT * FROM ({QUEUE}) t ORDER BY CASE severity WHEN 'bad' THEN 4 ELSE 3 END DESC, t.latest_time DESC NULLS LAST, category, target, issue LIMIT 200)", DIAG)

# measures besides
add("h14_endpoint_display", lambda df, jf: df.withColumns({c: F.lit(None).cast("string") for c in ("destination_catalog", "destination_database", "destination_schema")}).groupBy(C.endpoint_display("destination").alias("display")).agg(F.count(F.lit(1)).alias("runs")), "SELECT COALESCE(destination_full_table, destination_table) AS display, COUNT(*) AS runs FROM df GROUP BY 1")
SHAPE = """'{"operation_types":[' || CASE WHEN operation_types = 'etl' THEN '"etl"' WHEN operation_types IS NULL THEN '' ELSE '"etl","maintenance"' END || '],"stages":[' || CASE WHEN stages LIKE '[%' THEN '"bronze","silver"' ELSE '"gold","quality"' END || ']}'"""
add("h17_job_shapes", lambda df, jf: jf.groupBy(C.job_key().alias("job_key")).agg(F.count(F.lit(1)).alias("jobs")), f"SELECT sha1({SHAPE})[1:16] AS job_key, COUNT(*) AS jobs FROM jf GROUP BY 1")
NEAR3 = "sd AS (SELECT * FROM df WHERE 'source-3' IN (source_name, destination_name)), sj AS (SELECT * FROM jf WHERE EXISTS (SELECT 1 FROM sd d WHERE d._source_id = jf._source_id AND d.job_id = jf.job_id))"
add("o02_environment_trend", lambda df, jf: overview.status_trend(scope.scope(df, jf, {"connection": "source-3"}, NOW)[1], "month"), f"SELECT {S.trunc('month')} AS bucket_start, normalized_status AS status, COUNT(*) AS count FROM sj WHERE event_time IS NOT NULL GROUP BY 1, 2", NEAR3)
DATES = "(SELECT run_date AS d FROM sd UNION ALL SELECT CAST(event_time AS DATE) FROM sj)"
add("o02_environment_overview", lambda df, jf: scope.environment_overview(df, jf, {"connection": "source-3"}, NOW), f"SELECT (SELECT COUNT(*) FROM sd) AS dataflow_records, (SELECT COUNT(*) FROM sj) AS job_records, (SELECT COUNT(*) FROM sd WHERE normalized_status = 'succeeded') AS dataflow_succeeded, (SELECT COUNT(*) FROM sd WHERE normalized_status = 'failed') AS dataflow_failed, (SELECT COUNT(*) FROM sj WHERE normalized_status = 'failed') AS job_failed, (SELECT COUNT(DISTINCT NULLIF(engine_name, '')) FROM sj) AS active_engines, (SELECT COUNT(DISTINCT NULLIF(metadata_provider_name, '')) FROM sj) AS active_metadata_providers, {S.ts('(SELECT GREATEST((SELECT MAX(event_time) FROM sd), (SELECT MAX(event_time) FROM sj)))')} AS latest_log_at, {S.ts('(SELECT MAX(event_time) FROM sj)')} AS latest_job_log_at, {S.ts('(SELECT MAX(event_time) FROM sd)')} AS latest_dataflow_log_at, (SELECT CAST(MIN(d) AS VARCHAR) FROM {DATES}) AS date_min, (SELECT CAST(MAX(d) AS VARCHAR) FROM {DATES}) AS date_max", NEAR3)
add("r02_skip_streaks", lambda df, jf: freshness.skip_streaks(df.filter(C.has_id())).select("dataflow_run_id", F.col("run_rank").cast("long"), F.col("others_seen").cast("long")), f"SELECT dataflow_run_id, row_number() OVER w AS run_rank, CAST(SUM(CASE WHEN normalized_status = 'skipped' THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS others_seen FROM df WHERE {S.NOID} WINDOW w AS (PARTITION BY dataflow_id ORDER BY event_time DESC NULLS LAST, dataflow_run_id DESC)")
JL = f"(SELECT {S.nip('duration_seconds', .95)} AS p95, {S.nip('duration_seconds', .99)} AS p99 FROM jf WHERE {S.RAN})"
ITEMS = f"it AS (SELECT COALESCE(NULLIF(TRIM(job_id), ''), 'unknown') AS job_id, unnest([{{'code': 'job_failed', 'severity': 'bad', 'title': 'Failed job', 'score': CASE WHEN normalized_status = 'failed' THEN 5000 + COALESCE(epoch_us(event_time) / 1e6, 0) END}}, {{'code': 'child_dataflow_failed', 'severity': 'bad', 'title': 'Child dataflows failed', 'score': CASE WHEN child_failed_count > 0 THEN 4000.0 + child_failed_count END}}, {{'code': 'job_reconciliation_mismatch', 'severity': 'warning', 'title': 'Reconciliation mismatch', 'score': CASE WHEN reconciliation_mismatch_count > 0 THEN 3000.0 + reconciliation_mismatch_count END}}, {{'code': 'job_duration_p99', 'severity': 'warning', 'title': 'P99 duration job', 'score': CASE WHEN p99 > 0 AND COALESCE(duration_seconds, 0) >= p99 THEN 2000 + duration_seconds END}}, {{'code': 'job_duration_p95', 'severity': 'info', 'title': 'P95 duration job', 'score': CASE WHEN p95 > 0 AND COALESCE(duration_seconds, 0) >= p95 AND NOT COALESCE(p99 > 0 AND duration_seconds >= p99, false) THEN 1000 + duration_seconds END}}], recursive := true) FROM ru, {JL})"
add("t03_job_attention_items", lambda df, jf: jobs.job_attention_items(jf, df), "SELECT job_id, code, severity, title, ROUND(score, 3) AS score FROM it WHERE score IS NOT NULL ORDER BY it.score DESC, job_id, code LIMIT 8", S.COMPARE + ", " + ROLL + ", " + ITEMS)
add("t06_watermark_summary", lambda df, jf: freshness.watermark_summary(df), f"SELECT dataflow_id, COUNT(*) AS runs, {', '.join(S.n(f'movement_state = {m!r}', m) for m in ('advanced', 'unchanged', 'initialized', 'invalid', 'incomplete'))}, {S.latest('movement_state')} AS latest_movement FROM etl WHERE watermark_enabled AND {S.NOID} GROUP BY 1 ORDER BY runs DESC, 1 LIMIT 18", S.ETL)
FLAT = facts.latest_dataflow_runs
add("l26_lineage_latest_status", lambda df, jf: lineage.lineage_latest_status(df.filter(C.has_id()).groupBy(F.col("dataflow_id").alias("dataflow")).agg(F.max("dataflow_name").alias("name")), FLAT(df)).drop("name"), f"SELECT dataflow_id AS dataflow, normalized_status AS status, {S.ts('event_time')} AS event_time FROM idn WHERE {S.NOID} QUALIFY row_number() OVER (PARTITION BY identity ORDER BY event_time DESC NULLS LAST, dataflow_run_id DESC) = 1", IDENT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda make: lambda spark, sf_dir: C.rendered(make(*load(spark, sf_dir))))(make) for name, (make, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    start = oracle_facts()
    return {name: sql.replace("FACTS", start, 1) for name, (_, sql) in QUERIES.items() if sql}
