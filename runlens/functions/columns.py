"""Column helpers shared by all metrics: statuses, rates, percentiles, buckets, identities."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled

STATUSES = ("succeeded", "failed", "skipped", "running", "pending")
EXECUTABLE = ("succeeded", "failed")
#: Identifiers that stand for none.
NO_ID = ("", "unknown", "none", "null", "nan")
PHASES = ("source", "transform", "destination", "overhead")


def filled(c: Column | str) -> Column:
    """Trimmed text, null if blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def known(c: Column | str) -> Column:
    """Text, `unknown` if blank."""
    return F.coalesce(filled(c), F.lit("unknown"))


def normalized_status(c: Column | str) -> Column:
    return F.lower(known(c))


def status_is(*names: str) -> Column:
    return F.col("normalized_status").isin(*names)


def has_id(c: str = "dataflow_id") -> Column:
    return F.col(c).isNotNull() & ~F.trim(c).isin(*NO_ID)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def total(c: Column | str) -> Column:
    """Sum, 0 if there is none."""
    return F.coalesce(F.sum(c), F.lit(0))


def rate(part: Column, whole: Column) -> Column:
    """Percentage with two digits, null if there is no whole."""
    return F.round(F.try_divide(part * 100.0, whole), 2)


def status_counts(unknown: bool = True) -> list[Column]:
    """One count for each status."""
    out = [count_where(status_is(s)).alias(s) for s in STATUSES]
    return [*out, count_where(~status_is(*STATUSES)).alias("unknown")] if unknown else out


def success_rate(of: tuple[str, ...] = EXECUTABLE, name: str = "succeeded") -> Column:
    return rate(count_where(status_is(name)), count_where(status_is(*of)))


def mean(c: str, digits: int = 3) -> Column:
    return F.coalesce(F.round(F.avg(c), digits), F.lit(0.0))


def latest(c: Column | str) -> Column:
    """Newest non-null value: by event time, then run id; rows without a value or a time don't count."""
    c = F.col(c) if isinstance(c, str) else c
    return F.max_by(c, F.when(c.isNotNull() & F.col("event_time").isNotNull(), F.struct("event_time", "dataflow_run_id")))


def dominant(c: Column | str) -> Column:
    """Most frequent non-null value, the lowest on ties."""
    return F.mode(c, deterministic=True)


#: Columns whose newest times one pass finds. More make generated methods that the JVM doesn't compile, which is slower than another pass.
AT_ONCE = 8


def latest_values(df: DataFrame, key: str, wanted: dict[str, Column], at_once: int = AT_ONCE) -> DataFrame:
    """key and the newest non-null value of each column, by event time, then run id; keys without any timed value have no row.

    Times are found first, in buffers of fixed width, so the runs are hashed and not sorted. They are a table with one row a key, which Spark
    broadcasts where it is small, so the runs aren't shuffled to meet it; only runs of one of these times are derived and compared as text.
    """
    timed, names = df.filter("event_time is not null"), list(wanted)
    parts = [names[a : a + at_once] for a in range(0, len(names), at_once)]
    found = [timed.groupBy(key).agg(*[F.max(F.when(wanted[n].isNotNull(), F.col("event_time"))).alias(f"__{n}") for n in part]) for part in parts]
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    newest = settled(every.groupBy(key).agg(*[F.max(f"__{n}").alias(f"__{n}") for n in names]))
    moments = newest.select(key, F.array_distinct(F.array_compact(F.array(*[f"__{n}" for n in names]))).alias("__moments"))
    rows = timed.join(moments, key).filter(F.array_contains("__moments", F.col("event_time"))).drop("__moments").join(newest, key)
    hits = {n: c.isNotNull() & (F.col("event_time") == F.col(f"__{n}")) for n, c in wanted.items()}
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(hits[n], F.col("dataflow_run_id"))).alias(n) for n, c in wanted.items()])


def coarse(value: Column) -> Column:
    """A bucket's number that never falls as the value rises, about 500 to each power of e."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * 512)).cast("long")


def nearest_percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """keys and one column for each wanted (value, p): the sorted value at index round_half_even((n - 1) p), nulls left out.

    Counts by coarse bucket are walked in order within each group, and after them only the values of those buckets that hold an index, each bucket by
    itself: no task has more different values of a group than are in one bucket, and nothing is collected. With keys, values are counted before, as both steps read them;
    without, the bucket counts are few, and the rows are read again with a filter on the buckets that were found. Columns that are wanted more than once are read once.
    Groups without values have no row for them; join with `with_percentiles` to get 0.
    """
    measures: dict[str, tuple[Column, dict[str, float]]] = {}
    for name, (value, p) in wanted.items():
        measures.setdefault(str(value), (value, {}))[1][name] = p
    if len(measures) == 1:
        value = next(iter(measures.values()))[0]
        long = df.select(*keys, F.lit(0).alias("what"), value.cast("double").alias("value"))
    else:
        pairs = F.array(*[F.struct(F.lit(i).alias("what"), value.cast("double").alias("value")) for i, (value, _) in enumerate(measures.values())])
        long = df.select(*keys, F.inline(pairs))
    counted = long.filter("value is not null").withColumn("n", F.lit(1).cast("long"))
    if keys:
        counted = counted.groupBy(*keys, "what", "value").agg(F.sum("n").alias("n"))
    shares = {i: ps for i, (_, ps) in enumerate(measures.values())}
    chosen = None
    for i, ps in shares.items():
        found = F.array(*[F.struct(F.lit(n).alias("name"), F.bround((F.col("of") - 1) * F.lit(p)).cast("long").alias("index")) for n, p in ps.items()])
        chosen = F.when(F.col("what") == i, found) if chosen is None else chosen.when(F.col("what") == i, found)

    def walked(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        own = Window.partitionBy(*by)
        return rows.withColumn("upto", F.sum("n").over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    by = [*keys, "what"]
    buckets = counted.groupBy(*by, coarse(F.col("value")).alias("bucket")).agg(F.sum("n").alias("n"))
    buckets = walked(buckets, by, "bucket").withColumn("of", F.sum("n").over(Window.partitionBy(*by)))
    held = buckets.select(*by, "bucket", (F.col("upto") - F.col("n")).alias("before"), "upto", F.inline(chosen)).filter("upto > index and before <= index").drop("upto")
    rows = counted.withColumn("bucket", coarse(F.col("value")))
    if keys:
        held = held.withColumnsRenamed({k: f"__{k}" for k in [*by, "bucket"]})
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(k) == F.col(f"__{k}") for k in ("what", "bucket")]
        rows = rows.join(held, same).drop(*[f"__{k}" for k in [*by, "bucket"]])
    else:
        # at most one row a percentile; only rows of these buckets are counted by value
        rows = rows.join(F.broadcast(held), ["what", "bucket"]).groupBy("what", "bucket", "before", "name", "index", "value").agg(F.sum("n").alias("n"))
    hit = walked(rows, [*keys, "name", "bucket"], "value").filter("before + upto > index and before + upto - n <= index")
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in wanted])


def with_percentiles(base: DataFrame, df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """base (one row for each keys) with the nearest percentiles of df; 0 where there are no values."""
    found = nearest_percentiles(df, keys, wanted)
    if not keys:
        return base.join(found, how="left").fillna(0.0, list(wanted))
    renamed = found.select(*[F.col(k).alias(f"__{k}") for k in keys], *wanted)
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return base.join(renamed, on, "left").drop(*[f"__{k}" for k in keys]).fillna(0.0, list(wanted))


def bucket(ts: Column | str, grain: str, tz: str = "UTC") -> Column:
    """Start of the local hour, day, week or month."""
    return F.date_trunc(grain, F.from_utc_timestamp(ts, tz))


def bucket_label(start: Column | str, grain: str) -> Column:
    start = F.col(start) if isinstance(start, str) else start
    if grain == "week":
        return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), start), F.weekofyear(start))
    return F.date_format(start, {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}[grain])


def bucket_end(start: Column | str, grain: str) -> Column:
    step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}[grain]
    return (F.col(start) if isinstance(start, str) else start) + F.expr(step)


GRAINS = ("hour", "day", "week", "month")


def effective_grain(requested: str | None, days: float) -> str:
    """Finest grain for a span: hours to 3 days, days to 90, weeks to 365, else months; a finer request is coarsened."""
    least = "hour" if days <= 3 else "day" if days <= 90 else "week" if days <= 365 else "month"
    if requested not in GRAINS:
        return least
    return GRAINS[max(GRAINS.index(least), GRAINS.index(requested))]


def span_days(df: DataFrame, ts: str = "event_time") -> float:
    """Days between the first and the last event: one row to the driver."""
    r = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    return (r["b"] - r["a"]).total_seconds() / 86400 if r["a"] else 0.0


def listish(c: Column | str) -> Column:
    """Array from a JSON list or a list with commas, semicolons or bars, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.split(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]\"']", "")), r"\s*[,;|]\s*")


def _said(c: str) -> Column:
    return ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "unknown", "none", "null", "n/a")


def lakehouse() -> Column:
    """True if the destination is a lakehouse table: by type and format if either says something, else by name and path."""
    words = "lakehouse|delta|iceberg|onelake"
    typed = F.lower(F.concat_ws(" ", "destination_connection_type", "destination_format")).rlike(words)
    named = F.lower(F.concat_ws(" ", "destination_name", "destination_path")).rlike(words)
    return F.when(_said("destination_connection_type") | _said("destination_format"), typed).otherwise(named)


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def estimated_rows_written() -> Column:
    written = zero("destination_rows_written")
    read = F.coalesce(F.nullif(F.col("source_rows_read"), F.lit(0)), F.col("destination_rows_written"), F.lit(0))
    return F.when(lakehouse(), written).when(status_is("succeeded"), read).otherwise(written)


def rows_processed() -> Column:
    return F.greatest(zero("source_rows_read"), zero("destination_rows_written"), zero("destination_rows_inserted") + zero("destination_rows_updated") + zero("destination_rows_deleted"))


def maintenance_bytes() -> Column:
    return F.greatest(F.lit(0), zero("destination_bytes_added") + zero("destination_bytes_removed") + zero("destination_bytes_saved"))


def maintenance_files() -> Column:
    return F.greatest(F.lit(0), zero("destination_files_added") + zero("destination_files_removed"))


def phase_sum() -> Column:
    return zero("source_duration_seconds") + zero("transform_duration_seconds") + zero("destination_duration_seconds")


def derived_overhead() -> Column:
    """Explicit overhead, else what the phases leave of the run's time; null without either."""
    rest = F.when(F.col("duration_seconds").isNotNull(), F.greatest(F.lit(0.0), F.col("duration_seconds") - phase_sum()))
    return F.coalesce(F.col("overhead_duration_seconds"), rest)


def is_maintenance() -> Column:
    """True if a run maintains a table, by its own operation or that of its destination."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return (low("operation_type") == "maintenance") | low("destination_operation_type").isin("compact", "cleanup", "maintenance")


def maintenance_target() -> Column:
    table = F.coalesce(filled("destination_full_table"), filled("destination_table"), filled("destination_path"))
    return F.concat(known("destination_name"), F.when(table.isNotNull(), F.concat(F.lit("::"), table)).otherwise(":unknown"))


def compact_text(c: Column | str, n: int) -> Column:
    """White space collapsed; text of more than n characters is cut so that it ends in three dots and has n."""
    one = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(one) > n, F.concat(F.substring(one, 1, n - 3), F.lit("..."))).otherwise(one)


def endpoint_display(side: str) -> Column:
    """What a reader calls an endpoint: full table without backticks, qualified name, last two parts of the path, function, query or name."""
    qualified = F.nullif(F.concat_ws(".", *[filled(f"{side}_{p}") for p in ("catalog", "database", "schema", "table")]), F.lit(""))
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(f"{side}_path", F.lit("")), "\\\\", "/"), "/"), lambda x: x != "")
    tail = F.nullif(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/"), F.lit(""))
    own = [F.replace(filled(f"{side}_full_table"), F.lit("`"), F.lit("")), qualified, tail]
    if side == "source":
        own += [filled("source_python_function"), F.nullif(compact_text("source_query", 80), F.lit(""))]
    return F.coalesce(*own, filled(f"{side}_name"), F.lit("unknown"))


def job_key() -> Column:
    """16 hexadecimal digits that tell job shapes apart: their sorted different operation types and stages."""
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(listish(c), lambda x: x != "")))
    return F.substring(F.sha1(F.to_json(F.struct(clean("operation_types").alias("operation_types"), clean("stages").alias("stages")))), 1, 16)


def name_uuid(c: Column | str, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """Version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(c, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int") % 64) + 128))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def utc_date(ts: str) -> Column:
    """The UTC date of an instant, whatever the session's time zone."""
    return F.to_date(F.to_utc_timestamp(ts, F.current_timezone()))


def rendered(df: DataFrame) -> DataFrame:
    """Timestamps and dates as text, so that results of other engines compare."""
    kinds = dict(df.dtypes)
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if k.startswith("timestamp") else F.col(c).cast("string").alias(c) if k == "date" else F.col(c) for c, k in kinds.items()])
