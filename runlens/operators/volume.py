"""Volume metrics: unusual runs and dataflows, mixes, routes and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket, dominant, estimated_rows_written, has_id, lakehouse, latest_values, mean, nearest_percentiles, rate, status_is, total, with_percentiles, zero
from .performance import record_counts

#: Measures in the order that decides ties, and the columns they read.
MEASURES = {"read": "source_rows_read", "est_rows": "est_rows_written", "lakehouse_rows": "destination_rows_written", "bytes": "net_bytes", "files": "files_changed"}


def volume_rows(df: DataFrame) -> DataFrame:
    net = zero("destination_bytes_added") - zero("destination_bytes_removed")
    return df.withColumns({"est_rows_written": estimated_rows_written(), "is_lakehouse": lakehouse(), "signed_net_bytes": net, "net_bytes": F.abs(net), "files_changed": zero("destination_files_added") + zero("destination_files_removed")})


def scored(rows: DataFrame, measures: dict[str, str] = MEASURES) -> DataFrame:
    """rows with each measure's 95th percentile of positive values, its ratio to that (0 below it), the largest ratio and its name.

    The thresholds are one row, which Spark sends to all tasks.
    """
    limits = nearest_percentiles(rows, [], {f"{m}_p95": (F.when(F.col(c) > 0, F.col(c)), 0.95) for m, c in measures.items()})
    both = rows.join(F.broadcast(limits), how="left")
    ratio = {f"{m}_ratio": F.when((F.col(f"{m}_p95") > 0) & (F.col(c) > 0) & (F.col(c) >= F.col(f"{m}_p95")), F.col(c) / F.col(f"{m}_p95")).otherwise(0.0) for m, c in measures.items()}
    both = both.withColumns(ratio).withColumn("candidate_ratio", F.greatest(*ratio))
    kind = F.when(F.col("candidate_ratio") <= 0, "none")
    for m in measures:
        kind = kind.when(F.col(f"{m}_ratio") == F.col("candidate_ratio"), m)
    return both.withColumn("candidate_kind", kind)


def run_candidates(df: DataFrame, top: int = 100) -> DataFrame:
    out = scored(volume_rows(df)).filter("candidate_ratio > 0").orderBy(F.desc("candidate_ratio"), "dataflow_run_id").limit(top)
    return out.select("dataflow_run_id", "dataflow_id", "candidate_kind", F.round("candidate_ratio", 6).alias("candidate_ratio"))


def dataflow_totals(df: DataFrame) -> DataFrame:
    rows = volume_rows(df).filter(has_id())
    return rows.groupBy("dataflow_id").agg(total("source_rows_read").alias("source_rows_read"), F.sum("est_rows_written").alias("est_rows_written"), total("destination_rows_written").alias("destination_rows_written"), F.abs(F.sum("signed_net_bytes")).alias("net_bytes"), F.sum("files_changed").alias("files_changed"))


def dataflow_candidates(df: DataFrame) -> DataFrame:
    out = scored(dataflow_totals(df))
    return out.select("dataflow_id", *MEASURES.values(), "candidate_kind", F.round("candidate_ratio", 6).alias("candidate_ratio"))


SUMS = ("source_rows_read", "destination_rows_written", "destination_rows_inserted", "destination_rows_updated", "destination_rows_deleted", "destination_bytes_added", "destination_bytes_removed", "destination_files_added", "destination_files_removed")


def _sums() -> list[Column]:
    return [total(c).alias(c) for c in SUMS] + [F.sum("est_rows_written").alias("est_rows_written"), F.sum("signed_net_bytes").alias("net_bytes")]


#: Totals of a summary and the columns they add up.
TOTALS = {"total_rows_read": "source_rows_read", "total_rows_written": "destination_rows_written", "total_est_rows_written": "est_rows_written", "total_rows_inserted": "destination_rows_inserted", "total_rows_updated": "destination_rows_updated", "total_rows_deleted": "destination_rows_deleted", "files_added": "destination_files_added", "files_removed": "destination_files_removed", "total_bytes_added": "destination_bytes_added", "total_bytes_removed": "destination_bytes_removed", "total_bytes_saved": "destination_bytes_saved"}
#: Counts of unusual runs by the measure that is largest.
COUNTED = {"read": "rows", "est_rows": "est_rows", "lakehouse_rows": "lakehouse_rows", "bytes": "bytes", "files": "files"}


def volume_summary(df: DataFrame, jf: DataFrame) -> DataFrame:
    """One row: records, dates and newest times of both logs, totals, shares of lakehouse destinations and skips, unusual runs by measure, and unusual dataflows."""
    rows = scored(volume_rows(df))
    high = F.count_if(F.col("candidate_ratio") > 0)
    kinds = [F.count_if(F.col("candidate_kind") == m).alias(f"high_volume_{n}_count") for m, n in COUNTED.items()]
    skipped, lake, all_rows = F.count_if(status_is("skipped")), F.count_if("is_lakehouse"), F.count(F.lit(1))
    out = rows.agg(*[total(c).alias(n) for n, c in TOTALS.items()], lake.alias("lakehouse_destination_run_count"), rate(lake, all_rows).alias("lakehouse_destination_share"), skipped.alias("skip_count"), rate(skipped, all_rows).alias("skip_rate"), high.alias("high_volume_run_count"), high.alias("high_volume_candidate_run_count"), *kinds)
    per_file = F.coalesce(F.round(F.try_divide("total_bytes_added", "files_added"), 3), F.lit(0.0))
    out = out.withColumns({"total_est_rows_written_non_lakehouse": F.col("total_est_rows_written") - F.col("total_rows_written"), "net_bytes_change": F.col("total_bytes_added") - F.col("total_bytes_removed"), "avg_bytes_per_file_added": per_file})
    flows = scored(dataflow_totals(df)).agg(F.count_if(F.col("candidate_ratio") > 0).alias("high_volume_dataflow_count"))
    return out.join(flows).join(record_counts(df, jf))


def volume_trend(df: DataFrame, grain: str = "day", tz: str = "UTC") -> DataFrame:
    return volume_rows(df).filter("event_time is not null").groupBy(bucket("event_time", grain, tz).alias("bucket_start")).agg(F.count(F.lit(1)).alias("runs"), *_sums())


def load_type() -> Column:
    """How a run loads its destination, else what it does to it."""
    return F.coalesce(F.nullif("destination_load_type", F.lit("")), F.nullif("destination_operation_type", F.lit("")), F.lit("unknown"))


def skips() -> Column:
    return F.count_if(status_is("skipped")).alias("skipped")


def workload_mix(df: DataFrame, top: int = 100) -> DataFrame:
    operation = F.coalesce(F.nullif("operation_type", F.lit("")), F.lit("unknown"))
    mix = volume_rows(df).groupBy(F.concat_ws(" · ", operation, load_type()).alias("workload")).agg(F.count(F.lit(1)).alias("runs"), skips(), *_sums())
    return mix.orderBy(F.desc("source_rows_read"), F.desc("est_rows_written"), F.desc(F.col("destination_bytes_added") + F.col("destination_bytes_removed")), F.desc("runs"), "workload").limit(top)


def load_mix(df: DataFrame, top: int = 100) -> DataFrame:
    mix = volume_rows(df).groupBy(load_type().alias("load_type")).agg(F.count(F.lit(1)).alias("runs"), *_sums())
    return mix.orderBy(F.desc("est_rows_written"), "load_type").limit(top)


def route_volume(df: DataFrame, top: int = 100) -> DataFrame:
    ends = [F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")).alias(c) for c in ("source_name", "destination_name")]
    kinds = [F.coalesce(dominant(F.nullif(c, F.lit(""))), F.lit("unknown")).alias(c) for c in ("source_format", "destination_format", "source_connection_type", "destination_connection_type")]
    routes = volume_rows(df).groupBy(*ends).agg(F.count(F.lit(1)).alias("runs"), skips(), *kinds, *_sums())
    return routes.orderBy(F.desc("source_rows_read"), F.desc("est_rows_written"), F.desc("runs"), "source_name", "destination_name").limit(top)


#: Metrics that dataflows are ranked by, and the columns they add up.
RANKED = {"rows_read": "source_rows_read", "est_rows_written": "est_rows_written", "rows_written": "destination_rows_written", "bytes_added": "destination_bytes_added", "net_bytes": "signed_net_bytes"}


def dataflow_name(df: DataFrame, wanted: dict[str, Column] | None = None) -> DataFrame:
    """dataflow_id, the newest dataflow name, and newest values of other columns."""
    return latest_values(df, "dataflow_id", {"dataflow_name": F.nullif("dataflow_name", F.lit("")), **(wanted or {})})


def top_dataflows_by_metric(df: DataFrame, top: int = 20) -> DataFrame:
    """The largest dataflows by each metric, with their runs; net bytes by size, whatever their sign, shown with it."""
    rows = volume_rows(df).filter(has_id())
    sums = rows.groupBy("dataflow_id").agg(F.count(F.lit(1)).alias("count"), *[total(c).alias(m) for m, c in RANKED.items()]).join(dataflow_name(rows), "dataflow_id", "left")
    long = sums.select("dataflow_id", F.coalesce("dataflow_name", "dataflow_id").alias("name"), "count", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in RANKED])))
    size = F.when(F.col("metric") == "net_bytes", F.abs("value")).otherwise(F.col("value"))
    rank = Window.partitionBy("metric").orderBy(size.desc(), "name", "dataflow_id")
    return long.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top)


#: Measures of a registry row, what they are called (fixed values), and their columns.
SIGNALS = {"read": ("High rows read", "volume_rows_read"), "est_rows": ("High estimated rows written", "volume_est_rows_written"), "lakehouse_rows": ("High lakehouse rows written", "volume_lakehouse_rows_written"), "bytes": ("High lakehouse net bytes", "absolute_net_bytes"), "files": ("High lakehouse file churn", "volume_files_changed")}
#: Sums of a registry row.
SUMMED = {"volume_rows_read": "source_rows_read", "volume_est_rows_written": "est_rows_written", "volume_lakehouse_rows_written": "destination_rows_written", "volume_rows_inserted": "destination_rows_inserted", "volume_rows_updated": "destination_rows_updated", "volume_rows_deleted": "destination_rows_deleted", "volume_bytes_added": "destination_bytes_added", "volume_bytes_removed": "destination_bytes_removed", "volume_net_bytes": "signed_net_bytes", "volume_files_added": "destination_files_added", "volume_files_removed": "destination_files_removed", "volume_files_changed": "files_changed"}
#: What is told of a dataflow's newest run that has it.
NEWEST = ["job_id", "dataflow_run_id", "duration_seconds", *[f"{side}_{c}" for side in ("source", "destination") for c in ("name", "connection_type", "format", "full_table", "table", "path")], "destination_load_type"]


def reason(kind: Column) -> Column:
    out = F.lit("")
    for m, (label, _) in SIGNALS.items():
        out = F.when(kind == m, label).otherwise(out)
    return out


def volume_registry(df: DataFrame) -> DataFrame:
    """One row for each dataflow: newest run and endpoints, totals, peaks, 95th percentiles, unusual runs with their reasons, and the signals of the dataflow itself.

    candidate_run_reasons are in alphabetical order; volume_candidate_signals has a struct (kind, label, value, threshold, ratio) for each measure above its threshold.
    start_time and end_time are null if the runs don't have them.
    """
    rows = volume_rows(df).filter(has_id())
    known_or = lambda c: F.coalesce(c, F.lit("unknown"))
    peaks = {"peak_rows_read": "source_rows_read", "peak_est_rows_written": "est_rows_written", "peak_lakehouse_rows_written": "destination_rows_written"}
    base = rows.groupBy("dataflow_id").agg(F.max("event_time").alias("latest_run_at"), F.count(F.lit(1)).alias("run_count"), *[total(c).alias(n) for n, c in SUMMED.items()], *[F.max(zero(c)).alias(n) for n, c in peaks.items()], mean("duration_seconds").alias("avg_duration_seconds"))
    own = scored(base.withColumn("absolute_net_bytes", F.abs("volume_net_bytes")), {m: c for m, (_, c) in SIGNALS.items()})
    own = with_percentiles(own, rows, ["dataflow_id"], {f"p95_{n[5:]}": (F.col(c), 0.95) for n, c in peaks.items()} | {"p95_duration_seconds": (F.col("duration_seconds"), 0.95)})
    times = {c: F.col(c) if c in df.columns else F.lit(None).cast("timestamp") for c in ("start_time", "end_time")}
    newest = dataflow_name(rows, {"stage": F.nullif("stage", F.lit("")), "status": F.col("normalized_status"), "operation_type": F.nullif("operation_type", F.lit("")), **times, **{c: F.col(c) for c in NEWEST}})
    unusual = scored(volume_rows(df)).filter(has_id() & (F.col("candidate_ratio") > 0)).groupBy("dataflow_id").agg(F.count(F.lit(1)).alias("candidate_run_count"), F.array_sort(F.collect_set(reason(F.col("candidate_kind")))).alias("candidate_run_reasons"))
    signals = F.array(*[F.struct(F.lit(m).alias("kind"), F.lit(label).alias("label"), F.col(c).cast("long").alias("value"), F.col(f"{m}_p95").alias("threshold"), F.round(f"{m}_ratio", 3).alias("ratio")) for m, (label, c) in SIGNALS.items()])
    out = own.join(newest, "dataflow_id", "left").join(unusual, "dataflow_id", "left")
    out = out.withColumns({
        "dataflow_name": F.coalesce("dataflow_name", "dataflow_id"), "stage": known_or("stage"), "operation_type": known_or("operation_type"), "latest_run_status": F.col("status"),
        "candidate_run_count": F.coalesce("candidate_run_count", F.lit(0)), "candidate_run_reasons": F.coalesce("candidate_run_reasons", F.array().cast("array<string>")),
        "volume_candidate_kind": F.col("candidate_kind"), "volume_candidate_reason": reason(F.col("candidate_kind")), "volume_candidate_priority": F.round("candidate_ratio", 3), "volume_candidate_signals": F.filter(signals, lambda x: x["ratio"] > 0),
    })
    return out.drop("candidate_kind", "candidate_ratio", "absolute_net_bytes", *[f"{m}_{x}" for m in SIGNALS for x in ("p95", "ratio")])


def evidence_page(df: DataFrame, sort_by: str = "volume_candidate_priority", ascending: bool = False, limit: int = 25, offset: int = 0) -> DataFrame:
    """A page of the registry by one of its columns, nulls last."""
    order = F.asc_nulls_last(sort_by) if ascending else F.desc_nulls_last(sort_by)
    return volume_registry(df).orderBy(order, "dataflow_id").limit(limit + offset).offset(offset)
