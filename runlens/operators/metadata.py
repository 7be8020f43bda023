"""Pipeline metadata: normalising, resolving endpoints, validating and comparing edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import filled, name_uuid

ENDPOINT = ("connection_name", "schema_name", "table", "query", "python_function")


def normalize(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(connections, dataflows, schema hints) of documents (document, connections, dataflows, schema_hints arrays).

    Inactive dataflows are dropped; a dataflow without name takes that of its destination table; without id, one made of its name.
    """
    one = lambda c: docs.select("document", F.posexplode(c).alias("position", "r")).select("document", "position", "r.*")
    flows = one("dataflows").filter(F.coalesce("is_active", F.lit(True)))
    name = F.coalesce(filled("name"), F.concat_ws("_", "source.table", "destination.table"))
    flows = flows.withColumn("name", name).withColumn("dataflow_id", F.coalesce(filled("dataflow_id"), name_uuid("name")))
    return one("connections"), flows, one("schema_hints")


def resolve_endpoints(flows: DataFrame, connections: DataFrame) -> DataFrame:
    """Flattened dataflows with the attributes of their two connections; of connections with one name the last document's wins.

    The path of an endpoint is base path, schema and table.
    """
    last = Window.partitionBy("name").orderBy(F.desc("document"), F.desc("position"))
    conns = connections.withColumn("r", F.row_number().over(last)).filter("r = 1").select("name", "connection_type", "format", "catalog", "database", "base_path")
    out = flatten(flows)
    for side in ("source", "destination"):
        c = conns.select(F.col("name").alias(f"{side}_connection_name"), *[F.col(x).alias(f"{side}_{x}") for x in conns.columns[1:]])
        out = out.join(c, f"{side}_connection_name", "left")
        base = F.regexp_replace(f"{side}_base_path", "/+$", "")
        out = out.withColumn(f"{side}_path", F.when(filled(f"{side}_base_path").isNotNull(), F.concat_ws("/", base, filled(f"{side}_schema_name"), filled(f"{side}_table"))))
        out = out.withColumn(f"{side}_resolved", F.col(f"{side}_connection_type").isNotNull())
    return out


def flatten(flows: DataFrame) -> DataFrame:
    """Nested endpoints as `source_*` and `destination_*` columns."""
    fields = {s: flows.schema[s].dataType.names for s in ("source", "destination")}
    plain = [c for c in flows.columns if c not in fields]
    return flows.select(*plain, *[F.col(f"{s}.{n}").alias(f"{s}_{n}") for s, names in fields.items() for n in names])


def unflatten(flat: DataFrame, sides: tuple[str, ...] = ("source", "destination")) -> DataFrame:
    """The reverse of flatten."""
    own = {s: [c for c in flat.columns if c.startswith(f"{s}_")] for s in sides}
    used = {c for cs in own.values() for c in cs}
    return flat.select(*[c for c in flat.columns if c not in used], *[F.struct(*[F.col(c).alias(c[len(s) + 1 :]) for c in cs]).alias(s) for s, cs in own.items()])


def flatten_hints(groups: DataFrame) -> DataFrame:
    return groups.select("connection_name", "schema_name", "table_name", F.explode("hints").alias("h")).select("connection_name", "schema_name", "table_name", "h.*")


def group_hints(rows: DataFrame) -> DataFrame:
    keys = ["connection_name", "schema_name", "table_name"]
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ordinal_position", *[c for c in rest if c != "ordinal_position"]))).alias("hints"))


def issue(df: DataFrame, code: str, severity: str, kind: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def validate(connections: DataFrame, flows: DataFrame, hints: DataFrame) -> DataFrame:
    """Issues of flattened metadata: missing names, later duplicates, unknown connections, no destination, malformed JSON."""
    again = lambda df, c: df.withColumn("r", F.row_number().over(Window.partitionBy(F.lower(F.trim(c))).orderBy("position"))).filter((F.col("r") > 1) & filled(c).isNotNull())
    names = connections.select(F.col("name").alias("known")).distinct()
    out = [
        issue(connections.filter(filled("name").isNull()), "required", "error", "connection", F.col("position"), F.lit("name")),
        issue(again(connections, "name"), "duplicate", "error", "connection", F.col("position"), F.col("name")),
        issue(flows.filter(filled("name").isNull()), "required", "error", "dataflow", F.col("position"), F.lit("name")),
        issue(again(flows, "dataflow_id"), "duplicate", "error", "dataflow", F.col("position"), F.col("dataflow_id")),
        issue(flows.filter(filled("destination_table").isNull()), "missing_destination", "warning", "dataflow", F.col("position"), F.col("name")),
        issue(hints.join(names, F.col("connection_name") == F.col("known"), "left_anti"), "unknown_connection", "warning", "schema_hint", F.col("table_name"), F.col("connection_name")),
    ]
    for side in ("source", "destination"):
        used = flows.filter(filled(f"{side}_connection_name").isNotNull())
        out.append(issue(used.join(names, F.col(f"{side}_connection_name") == F.col("known"), "left_anti"), "unknown_connection", "error", "dataflow", F.col("position"), F.col(f"{side}_connection_name")))
    for kind, df in (("connection", connections), ("dataflow", flows)):
        if "configure" in df.columns:
            out.append(issue(df.filter(filled("configure").isNotNull() & F.try_parse_json("configure").isNull()), "malformed_json", "error", kind, F.col("position"), F.col("name")))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def new_issues(before: DataFrame, after: DataFrame) -> DataFrame:
    """Issues that an edit adds, as many times as it adds them."""
    return after.exceptAll(before)


def rename_connections(before: DataFrame, after: DataFrame, flows: DataFrame) -> DataFrame:
    """flows with the connections renamed that have one id and another name in `after`."""
    key = lambda df: F.coalesce(filled("connection_id"), F.concat(F.lit("#"), F.col("position").cast("string")))  # noqa: E731, ARG005
    both = before.select(key(before).alias("k"), F.col("name").alias("old")).join(after.select(key(after).alias("k"), F.col("name").alias("new")), "k").filter("old <> new").select("old", "new")
    for side in ("source", "destination"):
        c = f"{side}_connection_name"
        flows = flows.join(both.withColumnsRenamed({"old": c, "new": "__new"}), c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return flows


STAGES = ("source", "bronze", "silver", "gold")


def natural_key(c: str) -> Column:
    """Text that sorts digit runs as numbers."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def canonical_order(flows: DataFrame) -> DataFrame:
    """flows with their rank: family of stages, stage, group, order and name, digits as numbers. Ranks count rows before, by sorted sample-free keys."""
    low = F.lower(F.coalesce("stage", F.lit("")))
    family = F.lit(len(STAGES))
    for i, s in reversed(list(enumerate(STAGES))):
        family = F.when(low.startswith(s), i).otherwise(family)
    return flows.withColumn("sort_key", F.concat_ws("|", family.cast("string"), natural_key("stage"), F.lpad(F.coalesce("group_number", F.lit(0)).cast("string"), 10, "0"), natural_key("name")))


def changed_sheets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that an edit adds and removes by (source, sheet); rows: source, sheet, record."""
    gone, new = before.exceptAll(after), after.exceptAll(before)
    both = gone.select("source", "sheet", F.lit(1).alias("g"), F.lit(0).alias("n")).unionByName(new.select("source", "sheet", F.lit(0).alias("g"), F.lit(1).alias("n")))
    return both.groupBy("source", "sheet").agg(F.sum("g").alias("removed"), F.sum("n").alias("added"))


def summary(connections: DataFrame, flows: DataFrame) -> DataFrame:
    """Counts of connections by type and of dataflows by stage and load type."""
    count = lambda df, what, c: df.groupBy(F.lit(what).alias("what"), F.coalesce(filled(c), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("records"))
    return count(connections, "connection_type", "connection_type").unionByName(count(flows, "stage", "stage")).unionByName(count(flows, "load_type", "destination_load_type"))
