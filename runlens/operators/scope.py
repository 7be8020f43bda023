"""The population that all metrics share: time ranges, filters, search, job scoping and log pages."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import has_id, rate, status_is, utc_date

#: Filter name -> column, for values separated by bars.
FIELDS = {"status": "normalized_status", "engine": "engine_name", "provider": "metadata_provider_name", "stage": "stage", "sourceType": "source_connection_type", "destinationType": "destination_connection_type", "loadType": "destination_load_type", "operationType": "operation_type"}
FLOW_ONLY = ("stage", "sourceType", "destinationType", "loadType", "operationType", "connection", "dataflow", "destination_table", "dataflow_run_id")
#: Columns that a text search reads.
FLOW_TEXT = ["job_id", "dataflow_run_id", "dataflow_id", "dataflow_name", "stage", "error_message", "source_name", "source_full_table", "source_table", "source_path", "destination_name", "destination_full_table", "destination_table", "destination_path", "engine_name", "metadata_provider_name"]
JOB_TEXT = ["job_id", "engine_name", "metadata_provider_name", "status", "error_message"]


def time_bounds(period: str, as_of: dt.datetime, tz: str = "UTC", start: str | None = None, end: str | None = None) -> tuple[dt.datetime | None, dt.datetime | None]:
    """Inclusive UTC bounds: `24h` from the full hour, days from local midnight, `today`, `custom` or `all`."""
    now = as_of.replace(tzinfo=dt.UTC)
    midnight = now.astimezone(ZoneInfo(tz)).replace(hour=0, minute=0, second=0, microsecond=0)
    naive = lambda x: x.astimezone(dt.UTC).replace(tzinfo=None)
    if period == "all":
        return None, None
    if period == "custom":
        return (dt.datetime.fromisoformat(start) if start else None), (dt.datetime.fromisoformat(end) if end else None)
    if period == "today":
        return naive(midnight), naive(midnight + dt.timedelta(days=1)) - dt.timedelta(microseconds=1)
    if period == "24h":
        return naive(now.replace(minute=0, second=0, microsecond=0) - dt.timedelta(hours=24)), naive(now)
    return naive(midnight - dt.timedelta(days=int(period.rstrip("d")))), naive(now)


def _chosen(value: str | None) -> list[str]:
    return [] if value in (None, "", "all") else [v.strip() for v in value.split("|") if v.strip()]


def _search(columns: list[str], q: str) -> Column:
    """True if a column holds q in any case. Full tables are also read without backticks, and with the name of their destination before them."""
    q = q.strip().lower()
    texts = [F.col(c) for c in columns]
    for c in ("source_full_table", "destination_full_table"):
        if c in columns:
            texts.append(F.replace(c, F.lit("`"), F.lit("")))
    if "destination_full_table" in columns:
        bare = F.coalesce(F.replace("destination_full_table", F.lit("`"), F.lit("")), F.lit(""))
        texts.append(F.concat(F.coalesce("destination_name", F.lit("unknown")), F.lit("::"), bare))
    tests = [F.contains(F.lower(F.coalesce(t.cast("string"), F.lit(""))), F.lit(q)) for t in texts]
    return F.greatest(*tests)


def scope(df: DataFrame, jf: DataFrame, flt: dict[str, str] | None = None, as_of: dt.datetime | None = None, tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Dataflow and job facts within the filter. Filters on dataflows restrict jobs to those with a run that is left.

    Predicates sit directly on the facts, so they reach a Parquet scan; job scoping is a semi-join.
    """
    flt = flt or {}
    start, end = time_bounds(flt.get("range", "all"), as_of or dt.datetime.now(dt.UTC), tz, flt.get("start"), flt.get("end"))
    for bound, op in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            test = getattr(F.col("event_time"), op)(F.lit(bound))
            df, jf = df.filter(test), jf.filter(test)
    for name, column in FIELDS.items():
        if values := _chosen(flt.get(name)):
            df = df.filter(F.col(column).isin(values))
            if name not in FLOW_ONLY:
                jf = jf.filter(F.col(column).isin(values))
    if values := _chosen(flt.get("connection")):
        df = df.filter(F.col("source_name").isin(values) | F.col("destination_name").isin(values))
    if v := flt.get("job_id"):
        df, jf = df.filter(F.col("job_id") == v), jf.filter(F.col("job_id") == v)
    if v := flt.get("dataflow_run_id"):
        df = df.filter(F.col("dataflow_run_id") == v)
    if v := flt.get("dataflow"):
        df = df.filter((F.col("dataflow_id") == v) | (F.col("dataflow_name") == v))
    if v := flt.get("destination_table"):
        df = df.filter(F.lit(v).isin(*[F.col(c) for c in ("destination_full_table", "destination_table", "destination_path", "destination_name")]))
    flow_filters = any(flt.get(n) not in (None, "", "all") for n in FLOW_ONLY)
    if q := flt.get("q"):
        df, jf = df.filter(_search(FLOW_TEXT, q)), jf.filter(_search(JOB_TEXT, q))
    if flow_filters:
        jf = jf.join(df.select("_source_id", "job_id"), ["_source_id", "job_id"], "left_semi")
    return df, jf


SORTS = ("event_time", "duration_seconds", "normalized_status", "stage", "dataflow_name", "source_rows_read", "destination_rows_written", "total_dataflows", "engine_name")


def page(df: DataFrame, sort_by: str, descending: bool, tie: list[str], limit: int, offset: int) -> DataFrame:
    """A page in a total order, nulls last. Only listed columns sort. Count rows separately: a window over all would use one task."""
    if sort_by not in SORTS:
        raise ValueError(f"can't sort by {sort_by}")
    first = F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by)
    return df.orderBy(first, F.desc_nulls_last("event_time"), *tie).limit(offset + limit).offset(offset)


def dataflow_log_page(df: DataFrame, sort_by: str = "event_time", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    out = page(df, sort_by, descending, ["dataflow_run_id"], limit, offset)
    return out.select("dataflow_run_id", "dataflow_id", "dataflow_name", "job_id", "stage", "operation_type", "normalized_status", "event_time", "duration_seconds", "engine_name")


def job_log_page(jf: DataFrame, df: DataFrame, sort_by: str = "event_time", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """Jobs with what their runs add up to; the 95th percentile is the interpolated one. Runs are grouped for the page's jobs only."""
    jobs = page(jf, sort_by, descending, ["job_id"], limit, offset)
    keys = ["_source_id", "job_id"]
    runs = df.join(F.broadcast(jobs.select(*keys)), keys, "left_semi")  # at most a page of jobs
    kids = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("child_runs"), F.count_if(status_is("failed")).alias("child_failed"), F.sum("source_rows_read").alias("child_rows_read"), F.round(F.percentile("duration_seconds", 0.95), 3).alias("child_p95_duration"))
    return jobs.join(kids, keys, "left").select(*keys, "normalized_status", "event_time", "duration_seconds", "engine_name", F.coalesce("child_runs", F.lit(0)).alias("child_runs"), F.coalesce("child_failed", F.lit(0)).alias("child_failed"), F.coalesce("child_rows_read", F.lit(0)).alias("child_rows_read"), "child_p95_duration")


def environment_summary(df: DataFrame, jf: DataFrame, as_of: str) -> DataFrame:
    """Counts, success rate, failures within the last 7, 30 and 365 days, active engines and the range of dates."""
    age = F.datediff(F.to_date(F.lit(as_of)), F.col("run_date"))
    recent = [F.count_if(status_is("failed") & (age >= 0) & (age < d)).alias(f"failed_last_{d}_days") for d in (7, 30, 365)]
    flows = df.agg(F.count(F.lit(1)).alias("dataflow_runs"), F.countDistinct(F.when(has_id(), F.col("dataflow_id"))).alias("dataflows"), rate(F.count_if(status_is("succeeded")), F.count_if(status_is("succeeded", "failed"))).alias("success_rate"), *recent, F.min("run_date").alias("first_date"), F.max("run_date").alias("last_date"))
    jobs = jf.agg(F.count(F.lit(1)).alias("job_runs"), F.countDistinct(F.nullif("engine_name", F.lit(""))).alias("active_engines"))
    return flows.join(jobs)


def environment_overview(df: DataFrame, jf: DataFrame, flt: dict[str, str] | None = None, as_of: dt.datetime | None = None) -> DataFrame:
    """One row of key figures within a filter; its other half is overview.status_trend of the same jobs."""
    df, jf = scope(df, jf, flt, as_of)
    flows = df.agg(F.count(F.lit(1)).alias("dataflow_records"), F.count_if(status_is("succeeded")).alias("dataflow_succeeded"), F.count_if(status_is("failed")).alias("dataflow_failed"), F.max("event_time").alias("latest_dataflow_log_at"), F.min("run_date").alias("__lo"), F.max("run_date").alias("__hi"))
    named = lambda c: F.countDistinct(F.nullif(c, F.lit("")))
    day = utc_date("event_time")
    jobs = jf.agg(F.count(F.lit(1)).alias("job_records"), F.count_if(status_is("failed")).alias("job_failed"), named("engine_name").alias("active_engines"), named("metadata_provider_name").alias("active_metadata_providers"), F.max("event_time").alias("latest_job_log_at"), F.min(day).alias("__jlo"), F.max(day).alias("__jhi"))
    both = flows.join(jobs)
    return both.withColumns({"latest_log_at": F.greatest("latest_dataflow_log_at", "latest_job_log_at"), "date_min": F.least("__lo", "__jlo"), "date_max": F.greatest("__hi", "__jhi")}).drop("__lo", "__hi", "__jlo", "__jhi")
