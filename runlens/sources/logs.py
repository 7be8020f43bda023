"""Log sources and sinks: scans with provenance, partition paths, incremental plans, conforming, replacing and auditing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import filled, utc_date
from ..functions.dealing import dealt_join
from ..functions.graph import settled

JOB_RUN_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    *[(c, T.StringType()) for c in ("_type", "job_id", "status", "start_time", "end_time", "error_message", "engine_name", "metadata_provider_name", "platform_name", "stages", "operation_types")],
    ("duration_seconds", T.DoubleType()),
    *[(f"total_{c}", T.LongType()) for c in ("dataflows", "succeeded", "failed", "skipped", "running", "pending", "rows_read", "rows_written")],
)])


def with_provenance(df: DataFrame, source_id: int, kind: str) -> DataFrame:
    """File, kind, size and time of change of each row's file. df must come straight from a file source."""
    return df.select("*", F.lit(source_id).alias("_source_id"), F.col("_metadata.file_path").alias("_file_uri"), F.lit(kind).alias("_file_kind"), F.col("_metadata.file_size").alias("_source_size"), F.col("_metadata.file_modification_time").alias("_source_mtime"))


def read_dataflow_runs(spark: SparkSession, paths: list[str], source_id: int = 1) -> DataFrame:
    """Parquet files united by column name. Directories below the paths are not columns; the date in them serves conform_runs."""
    df = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*paths)
    return with_provenance(df, source_id, "dataflow_parquet")


def read_job_runs(spark: SparkSession, paths: list[str], source_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of JSON-lines files. Blank lines are skipped; a line that doesn't parse is a row of the second: uri and text."""
    lines = with_provenance(spark.read.option("recursiveFileLookup", True).text(paths), source_id, "job_jsonl").filter(F.trim("value") != "")
    schema = T.StructType([*JOB_RUN_SCHEMA, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.filter("r._bad is null").select("r.*", "_source_id", "_file_uri", "_file_kind", "_source_size", "_source_mtime").drop("_bad")
    return good, parsed.filter("r._bad is not null").select(F.col("_file_uri").alias("uri"), F.col("value").alias("line"), F.lit("invalid_jsonl").alias("code"))


def read_system_logs(spark: SparkSession, paths: list[str], job_id: str | None = None, dataflow_id: str | None = None, level: str | None = None, q: str | None = None) -> DataFrame:
    """System log lines; job id and time come from the file name. Without dataflow_id only lines of the job itself."""
    lines = spark.read.option("recursiveFileLookup", True).text(paths).select("value", F.col("_metadata.file_name").alias("file")).filter(F.trim("value") != "")
    row = F.from_json("value", "level string, dataflow_id string, job_id string, message string, timestamp string")
    name = r"system_log_(\d{8}_\d{6})_(.+)\.jsonl$"
    out = lines.withColumn("r", row).select("file", "value", F.upper("r.level").alias("level"), filled("r.dataflow_id").alias("dataflow_id"), F.coalesce(filled("r.job_id"), F.nullif(F.regexp_extract("file", name, 2), F.lit(""))).alias("job_id"), F.try_to_timestamp(F.regexp_extract("file", name, 1), F.lit("yyyyMMdd_HHmmss")).alias("file_time"), F.col("r.message").alias("message"))
    out = out.filter(F.col("dataflow_id") == dataflow_id) if dataflow_id else out.filter("dataflow_id is null")
    if job_id:
        out = out.filter(F.col("job_id") == job_id)
    if level:
        out = out.filter(F.col("level") == level.upper())
    return out.filter(F.lower("value").contains(q.lower())) if q else out


#: Directory patterns from the longest to the shortest, with what they tell.
SHAPES = [
    ("hour", r"(?:^|/)[^/\d]*(\d{4})[^\d/]*[/-]?[^/\d]*(\d{2})[^\d/]*[/-]?[^/\d]*(\d{2})[^\d]*[/T-]?[^/\d]*(\d{2})(?:/|$)"),
    ("day", r"(?:^|/)[^/\d]*(\d{4})[^\d/]*[/-]?[^/\d]*(\d{2})[^\d/]*[/-]?[^/\d]*(\d{2})(?:/|$)"),
    ("month", r"(?:^|/)[^/\d]*(\d{4})[^\d/]*[/-]?[^/\d]*(\d{2})(?:/|$)"),
    ("year", r"(?:^|/)[^/\d]*(\d{4})(?:/|$)"),
]


#: What completes the digits of a shape to a date and hour.
REST = {"hour": "", "day": "00", "month": "0100", "year": "010100"}


def parse_partition_path(df: DataFrame, path: str) -> DataFrame:
    """df with granularity, partition_value and partition_format of the directories in `path`; the longest shape that is a date wins.

    Directories are parsed once each, as a directory holds many files, and joined back as a table, so that filters on what was parsed
    read that table and aren't pushed down as patterns over every file.
    """
    listed = df.withColumn("__folder", F.regexp_replace(path, "[^/]*$", ""))
    seen = listed.select("__folder").distinct()
    seen = seen.withColumns({f"__{g}": F.regexp_extract("__folder", pattern, 0) for g, pattern in SHAPES})
    seen = seen.withColumns({f"__at_{g}": F.try_to_timestamp(F.concat(F.regexp_replace(f"__{g}", r"\D", ""), F.lit(REST[g])), F.lit("yyyyMMddHH")) for g, _ in SHAPES})
    found = [F.when(F.col(f"__at_{g}").isNotNull(), F.struct(F.lit(g).alias("granularity"), F.col(f"__at_{g}").alias("value"), F.regexp_replace(f"__{g}", r"\d", "0").alias("format"))) for g, _ in SHAPES]
    parsed = seen.select("__folder", F.coalesce(*found).alias("__p"))
    out = listed.join(settled(parsed), "__folder", "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__p.granularity").alias("granularity"), F.col("__p.value").alias("partition_value"), F.col("__p.format").alias("partition_format"))


def partition_layout_check(parsed: DataFrame, root: str, persisted: DataFrame | None = None) -> DataFrame:
    """Each root's formats, and whether they are `ok`, `mixed` or `changed` from the persisted one (root, format)."""
    out = parsed.groupBy(root).agg(F.count_distinct("partition_format").alias("formats"), F.min("partition_format").alias("format"), F.count(F.lit(1)).alias("files"))
    if persisted is not None:
        out = out.join(persisted.select(root, F.col("format").alias("was")), root, "left")
    changed = F.col("was").isNotNull() & (F.col("was") != F.col("format")) if persisted is not None else F.lit(False)
    return out.withColumn("layout", F.when(F.col("formats") > 1, "mixed").when(changed, "changed").otherwise("ok"))


def plan_incremental(files: DataFrame, manifest: DataFrame, scanned_from: str | None, as_of: str, lookback_days: int | None = None) -> DataFrame:
    """Files to load: those whose partition is within the range and that are new or have another revision.

    files: uri, revision, partition_value; manifest: uri, revision. The range goes from the checkpoint's partition, and the hour
    before it, to as_of; a lookback in days overrides it. Of a uri that is listed twice the latest revision counts. The result's largest partition_value, if later, is the
    next checkpoint; plan_partitions keeps one for each root.
    """
    start = F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {lookback_days} DAYS") if lookback_days is not None else (F.to_timestamp(F.lit(scanned_from)) - F.expr("INTERVAL 1 HOUR") if scanned_from else None)
    inside = files.filter(F.col("partition_value") <= F.to_timestamp(F.lit(as_of)))
    if start is not None:
        inside = inside.filter(F.col("partition_value") >= start)
    return latest_revisions(inside).join(manifest.select("uri", "revision"), ["uri", "revision"], "left_anti")


def latest_revisions(files: DataFrame) -> DataFrame:
    """One row a uri: that of its largest revision."""
    rest = [c for c in files.columns if c != "uri"]
    own = files.groupBy("uri").agg(F.max_by(F.struct(*rest), "revision").alias("__r"))
    return own.select(*[F.col("uri") if c == "uri" else F.col(f"__r.{c}").alias(c) for c in files.columns])


def plan_partitions(files: DataFrame, manifest: DataFrame, state: DataFrame, as_of: str, lookback: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files to load with `via`, next state) of roots whose late files are looked for in few partitions.

    files: root, uri, revision, modified, granularity and partition_value (see parse_partition_path); manifest: uri, revision of what is loaded; state: one row a
    root with checkpoint, boundary_modified and last_scanned. A root without state is read whole. Others are read from the partition that was last scanned, else the checkpoint, to
    that of as_of, and at the checkpoint, where files may still be replaced; hourly ones also in the hour before as_of, as a run may close after the next hour has
    begun. A lookback (first and last day) reads its partitions besides, without moving the state. Files that the manifest has at this revision aren't loaded again.

    The state is: the latest partition that held files, the newest change in it, and the latest partition that was looked at. Partitions are chosen in a table of
    them, not by file. Roots without files keep their state.
    """
    now = F.to_timestamp(F.lit(as_of))
    grains = ("hour", "day", "month", "year")
    trunc = lambda c: F.coalesce(*[F.when(F.col("granularity") == g, F.date_trunc(g, c)) for g in grains])
    listed = latest_revisions(files)
    places = settled(listed.groupBy("root", "partition_value").agg(F.max("granularity").alias("granularity"), F.max("modified").alias("newest")))
    known = places.join(state.withColumn("known", F.lit(True)), "root", "left").withColumns({"current": trunc(now), "at": trunc(F.col("checkpoint"))})
    value = F.col("partition_value")
    start = trunc(F.coalesce("last_scanned", "checkpoint", now))
    forward = (value >= start) & (value <= F.col("current"))
    hour_before = (F.col("granularity") == "hour") & (value == F.col("current") - F.expr("INTERVAL 1 HOUR"))
    regular = F.col("known").isNull() | forward | F.coalesce(value == F.col("at"), F.lit(False)) | hour_before
    back = F.lit(False)
    if lookback is not None:
        first, last = (F.to_timestamp(F.lit(d)) for d in lookback)
        until = F.when(F.col("granularity") == "hour", last + F.expr("INTERVAL 23 HOURS")).otherwise(last)
        back = (value >= trunc(first)) & (value <= trunc(until)) & F.col("known").isNotNull()
    wanted = known.withColumn("via", F.when(regular, "incremental").when(back, "lookback")).filter("via is not null")
    plan = dealt_join(listed, wanted.select("root", "partition_value", "via"), ["root", "partition_value"], F.xxhash64("uri"), "inner").join(manifest.select("uri", "revision"), ["uri", "revision"], "left_anti")
    seen = F.when(F.col("via") == "incremental", value)
    own = wanted.groupBy("root").agg(F.max(seen).alias("held"), F.max_by("newest", seen).alias("held_newest"), F.max("at").alias("at"))
    base = known.groupBy("root").agg(F.max("current").alias("current"), F.max("known").alias("had"))
    both = state.join(base.join(own, "root", "left"), "root", "full_outer")
    checkpoint = F.greatest("at", "held")
    scanned = F.greatest("last_scanned", "current", "at", F.when(F.col("had").isNull(), F.col("held")))
    newest = F.when(F.col("held") == checkpoint, F.col("held_newest"))
    following = both.select("root", F.coalesce(checkpoint, "checkpoint").alias("checkpoint"), F.greatest("boundary_modified", newest).alias("boundary_modified"), scanned.alias("last_scanned"))
    return plan, following


def pending_changes(planned: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether each source has a file to load."""
    return sources.select("_source_id").join(planned.groupBy("_source_id").agg(F.count(F.lit(1)).alias("n")), "_source_id", "left").select("_source_id", (F.coalesce("n", F.lit(0)) > 0).alias("pending"))


def conform_runs(df: DataFrame, partition_date: Column | None = None) -> DataFrame:
    """Event time from __event_time, end_time, else start_time; run date from the partition, __run_date, else the event time's UTC date."""
    have = set(df.columns)
    stamp = lambda c: F.try_to_timestamp(F.col(c).cast("string")) if c in have else F.lit(None).cast("timestamp")
    event = F.coalesce(stamp("__event_time"), stamp("end_time"), stamp("start_time"))
    given = F.col("__run_date").cast("date") if "__run_date" in have else F.lit(None).cast("date")
    date = F.coalesce(partition_date.cast("date") if partition_date is not None else F.lit(None).cast("date"), given, F.col("__utc_date"))
    timed = df.withColumn("__at", event).withColumn("__utc_date", utc_date("__at"))
    return timed.withColumns({"event_time": F.col("__at"), "run_date": date}).drop("__event_time", "__run_date", "__at", "__utc_date", "transform_missing_column_policy")


def schema_compatibility(source: T.StructType, target: T.StructType) -> dict[str, str]:
    """same, widened, lossless_check, incompatible or unknown for each source column: schemas, not rows, so plain Python."""
    wanted, out = {f.name: f.dataType for f in target}, {}
    whole, real, when = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType, T.DecimalType), (T.TimestampType, T.TimestampNTZType, T.DateType)
    for f in source:
        t = wanted.get(f.name)
        if t is None:
            out[f.name] = "unknown"
        elif f.dataType == t:
            out[f.name] = "same"
        elif isinstance(f.dataType, whole) and isinstance(t, (*whole, *real)) or isinstance(f.dataType, when) and isinstance(t, when) or isinstance(f.dataType, real) and isinstance(t, T.DoubleType):
            out[f.name] = "widened"
        elif isinstance(f.dataType, real) and isinstance(t, whole):
            out[f.name] = "lossless_check"
        else:
            out[f.name] = "incompatible"
    return out


def lossless_integer_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that a 64-bit integer can't hold, and the range, of each column."""
    bad = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.abs(c) >= F.lit(9.2233720368547758e18)) | (F.col(c) != F.floor(c)))
    one = df.agg(*[x for i, c in enumerate(columns) for x in (F.count_if(bad(c)).alias(f"b{i}"), F.count(c).alias(f"n{i}"), F.min(c).cast("double").alias(f"l{i}"), F.max(c).cast("double").alias(f"h{i}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("values"), F.col(f"b{i}").alias("lossy"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high")) for i, c in enumerate(columns)])))


def replace_by_file(current: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("_source_id", "_file_uri")) -> DataFrame:
    """current with the rows of new's files replaced. Files that vanished keep their rows; applying it twice changes nothing."""
    return current.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def source_revision_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("_source_id").agg(F.count(F.lit(1)).alias("files"), F.max("modified").alias("latest"), F.sum("size").alias("size"))


#: Worst first.
FRESHNESS = ["missing", "sync_failed", "not_cached", "unknown", "current"]


def source_freshness(sources: DataFrame, observed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status of each source: missing (not found), sync_failed, not_cached (no file loaded), unknown (never observed) or current.

    sources: environment, _source_id; observed: _source_id, found, sync_ok.
    """
    files = manifest.groupBy("_source_id").agg(F.count(F.lit(1)).alias("files"))
    both = sources.join(observed, "_source_id", "left").join(files, "_source_id", "left")
    status = F.when(F.col("found") == F.lit(False), "missing").when(F.col("sync_ok") == F.lit(False), "sync_failed").when(F.col("files").isNull(), "not_cached").when(F.col("found").isNull(), "unknown").otherwise("current")
    return both.select("environment", "_source_id", status.alias("status"))


def environment_freshness(freshness: DataFrame) -> DataFrame:
    """The worst status of an environment's sources."""
    rank = F.array_position(F.array(*map(F.lit, FRESHNESS)), F.col("status"))
    return freshness.groupBy("environment").agg(F.min_by("status", rank).alias("status"), F.count(F.lit(1)).alias("sources"))


def purge_sources(df: DataFrame, gone: DataFrame) -> DataFrame:
    return df.join(gone.select("_source_id"), "_source_id", "left_anti")


def retention_candidates(runs: DataFrame, as_of: str, days: int = 30, keep: int = 100) -> DataFrame:
    """Finished runs that are older than `days` and not among a source's newest `keep`."""
    newest = Window.partitionBy("_source_id").orderBy(F.desc("finished_at"), F.desc("run_id"))
    done = runs.filter("finished_at is not null").withColumn("r", F.row_number().over(newest))
    return done.filter((F.col("r") > keep) & (F.col("finished_at") < F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS"))).drop("r")


def publish(facts: DataFrame, report: DataFrame, folder: str) -> None:
    """Writes facts by run date, clustered by source and time, if the one-row validation report allows it; dates of many rows are split, and small ones share a task."""
    if not report.first()["valid"]:
        raise ValueError("facts don't match their source; nothing was published")
    facts.hint("rebalance", F.col("run_date")).sortWithinPartitions("_source_id", "event_time").write.mode("overwrite").partitionBy("run_date").parquet(folder)


def schema_repair(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns cast to bigint; raises at run time on the first value that it would change."""
    cast = lambda c: F.when(F.col(c).isNull() | (F.col(c) == F.floor(c)), F.col(c).cast("bigint")).otherwise(F.raise_error(F.concat(F.lit(f"{c} isn't integral: "), F.col(c).cast("string"))))
    return df.withColumns({c: cast(c) for c in columns})


def read_metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(section, record as JSON text) of metadata documents: an object with sections, or a list or record whose path names the section."""
    docs = spark.read.option("wholetext", True).text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    sections = ("connections", "dataflows", "schema_hints")
    body = F.from_json("value", ", ".join(f"{s} array<string>" for s in sections))
    inside = [docs.select(F.lit(s).alias("section"), F.explode(body[s]).alias("record")) for s in sections]
    named = F.coalesce(*[F.when(F.col("path").contains(s), F.lit(s)) for s in sections])
    alone = docs.filter(~F.coalesce(*[body[s].isNotNull() & F.lit(True) for s in sections], F.lit(False)))
    listed = alone.filter(F.trim("value").startswith("[")).select(named.alias("section"), F.explode(F.from_json("value", "array<string>")).alias("record"))
    single = alone.filter(~F.trim("value").startswith("[")).select(named.alias("section"), F.col("value").alias("record"))
    out = inside[0]
    for x in (*inside[1:], listed, single):
        out = out.unionByName(x)
    return out
