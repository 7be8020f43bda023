"""Asset and reference pages, their details and filter options, and summaries of projects and sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count(df: DataFrame, by: str, name: str) -> DataFrame:
    return df.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("asset")).agg(F.count(F.lit(1)).alias(name))


def position(upstream: str, downstream: str) -> Column:
    """Where an asset stands in the graph."""
    fed, feeds = F.col(upstream) > 0, F.col(downstream) > 0
    return F.when(fed & feeds, "transit").when(feeds, "entry").when(fed, "exit").otherwise("isolated")


def asset_rows(assets: DataFrame, flows: DataFrame, dependencies: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """assets with counts of neighbours, dataflows and dependencies, roles, attention and position.

    flows: dataflow, source, target. dependencies: reference, target (the asset that reads), resolved (the asset read, or null).
    diagnostics: severity, code, asset or else dataflow. Neighbours are counted once, over dataflows and resolved dependencies;
    a diagnostic of a dataflow counts for both of its ends, and equal ones count once. Roles of assets, if it is a column, stay.
    """
    known = dependencies.filter("resolved is not null")
    pairs = flows.select("source", "target").union(known.select("resolved", "target")).filter("source is not null and target is not null").distinct()
    ends = flows.select("dataflow", F.explode(F.array("source", "target")).alias("asset")).filter("asset is not null").distinct()
    own = diagnostics.filter("asset is not null").select("asset", "severity", "code", F.lit(None).cast("string").alias("dataflow"))
    of_flows = diagnostics.filter("asset is null").select(F.col("dataflow").cast("string").alias("dataflow"), "severity", "code").join(ends.withColumn("dataflow", F.col("dataflow").cast("string")), "dataflow")
    attention = _count(own.unionByName(of_flows).distinct(), "asset", "attention_count")
    parts = [_count(pairs, "target", "upstream_count"), _count(pairs, "source", "downstream_count"), _count(flows, "target", "input_dataflow_count"), _count(flows, "source", "output_dataflow_count"), _count(dependencies, "target", "depends_on_count"), _count(known, "resolved", "used_by_count"), attention]
    names = [p.columns[1] for p in parts]
    out = reduce(lambda a, b: a.join(b, "asset", "left"), parts, assets).fillna(0, names)
    held = F.col("roles") if "roles" in assets.columns else F.array().cast("array<string>")
    roles = F.array_compact(F.concat(held, F.array(F.when(F.col("output_dataflow_count") > 0, "source"), F.when(F.col("input_dataflow_count") > 0, "destination"))))
    return out.withColumns({"roles": F.array_sort(F.array_distinct(roles)), "position": position("upstream_count", "downstream_count")})


def _attention(state: str | None) -> Column:
    has = F.col("attention_count") > 0
    return {None: F.lit(True), "with_attention": has, "clean": ~has}[state]


def _page(df: DataFrame, sorts: dict[str, Column], sort_by: str, descending: bool, key: str, limit: int, offset: int) -> DataFrame:
    if sort_by not in sorts:
        raise ValueError(f"can't sort by {sort_by}")
    first = sorts[sort_by]
    return df.orderBy(first.desc() if descending else first.asc(), key).limit(offset + limit).offset(offset)


def _holds(df: DataFrame, columns: list[str], q: str | None) -> Column:
    texts = [F.concat_ws(" ", c) for c in columns if c in df.columns]
    return F.contains(F.lower(F.concat_ws(" ", *texts)), F.lit((q or "").strip().lower()))


SEARCHED = ["asset", "title", "friendly_name", "full_identity", "kind", "format", "connection_name", "catalog", "database", "schema_name", "table", "path", "query", "python_function", "roles", "identifiers"]


def asset_page(rows: DataFrame, q: str | None = None, role: str | None = None, attention: str | None = None, scope: str | None = None, sort_by: str = "title", descending: bool = False, limit: int = 25, offset: int = 0, **equal: str | None) -> DataFrame:
    """A page of asset_rows: text search over names, identifiers and roles, filters by role, attention, position, and equal columns (connection_name, format, kind)."""
    test = _holds(rows, SEARCHED, q) & _attention(attention)
    if role:
        test &= F.array_contains("roles", role)
    if scope:
        test &= F.col("position") == scope
    for column, value in equal.items():
        if value:
            test &= F.col(column) == value
    text = {c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("title", "kind", "connection_name") if c in rows.columns}
    counts = {c: F.col(c) for c in ("upstream_count", "downstream_count", "attention_count")}
    return _page(rows.filter(test), text | counts, sort_by, descending, "asset", limit, offset)


def reference_page(rows: DataFrame, q: str | None = None, reference_type: str | None = None, provenance: str | None = None, state: str | None = None, attention: str | None = None, sort_by: str = "display_name", descending: bool = False, limit: int = 25, offset: int = 0) -> DataFrame:
    """A page of references (reference, display_name, reference_type, provenances, state, dependency_count, attention_count)."""
    test = _holds(rows, ["reference", "display_name", "normalized_value", "reference_type", "state", "reason", "provenances", "resolved"], q) & _attention(attention)
    for column, value in (("reference_type", reference_type), ("state", state)):
        if value:
            test &= F.col(column) == value
    if provenance:
        test &= F.array_contains("provenances", provenance)
    text = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("display_name", "reference_type", "state")}
    return _page(rows.filter(test), text | {c: F.col(c) for c in ("dependency_count", "attention_count")}, sort_by, descending, "reference", limit, offset)


def filter_options(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(option, value): the different values that filters offer, of arrays each item, and the states of attention."""
    kinds = dict(rows.dtypes)
    one = lambda c: F.col(c) if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))
    said = F.array(F.when(F.col("attention_count") > 0, "with_attention").otherwise("clean"))
    pairs = F.array(*[F.struct(F.lit(c).alias("option"), one(c).alias("values")) for c in columns], F.struct(F.lit("attention").alias("option"), said.alias("values")))
    listed = rows.select(F.inline(pairs)).select("option", F.explode("values").alias("value"))
    return listed.filter("value is not null and value <> ''").distinct()


def asset_flows(flows: DataFrame) -> DataFrame:
    """(asset, direction, dataflow, other): dataflows that an asset is the source or the destination of, for all assets at once."""
    ends = F.array(F.struct(F.col("target").alias("asset"), F.lit("input").alias("direction"), F.col("source").alias("other")), F.struct(F.col("source").alias("asset"), F.lit("output").alias("direction"), F.col("target").alias("other")))
    return flows.select("dataflow", F.inline(ends)).filter("asset is not null")


def asset_dependencies(dependencies: DataFrame) -> DataFrame:
    """(asset, direction, reference, other): what an asset depends on, resolved or not, and what uses it."""
    ends = F.array(F.struct(F.col("target").alias("asset"), F.lit("depends_on").alias("direction"), F.col("resolved").alias("other")), F.struct(F.col("resolved").alias("asset"), F.lit("used_by").alias("direction"), F.col("target").alias("other")))
    return dependencies.select("reference", F.inline(ends)).filter("asset is not null")


def source_summary(sources: DataFrame) -> DataFrame:
    """One row of sources (source_kind, enabled, validation): configured and enabled by kind, and validation errors and warnings."""
    kinds = [c for k in ("metadata", "logs") for c in (F.count_if(F.col("source_kind") == k).alias(f"{k}_configured"), F.count_if((F.col("source_kind") == k) & F.col("enabled")).alias(f"{k}_enabled"))]
    seen = F.col("source_kind").isin("metadata", "logs")
    return sources.agg(*kinds, *[F.count_if(seen & (F.col("validation") == v)).alias(f"validation_{v}s") for v in ("error", "warning")])


def project_summaries(projects: DataFrame, environments: DataFrame, sources: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row a project: environments with their sources by kind, in order of name, and reference mappings.

    projects: project, name; environments: environment, project, name; sources: environment, source_kind; mappings: project. A project
    without environments stays, with zeros and an empty list.
    """
    kinds = sources.groupBy("environment").agg(*[F.count_if(F.col("source_kind") == k).alias(f"{k}_count") for k in ("metadata", "logs", "code")])
    own = environments.join(kinds, "environment", "left").fillna(0, ["metadata_count", "logs_count", "code_count"])
    listed = F.array_sort(F.collect_list(F.struct("name", "environment", "metadata_count", "logs_count", "code_count")))
    grouped = own.groupBy("project").agg(F.count(F.lit(1)).alias("environment_count"), F.sum("metadata_count").alias("metadata_source_count"), F.sum("logs_count").alias("etl_log_path_count"), listed.alias("environments"))
    mapped = mappings.groupBy("project").agg(F.count(F.lit(1)).alias("reference_mapping_count"))
    out = projects.join(grouped, "project", "left").join(mapped, "project", "left")
    counts = ["environment_count", "metadata_source_count", "etl_log_path_count", "reference_mapping_count"]
    return out.fillna(0, counts).select("project", "name", *counts, F.coalesce("environments", F.array().cast(grouped.schema["environments"].dataType)).alias("environments"))
