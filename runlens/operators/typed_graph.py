"""The typed lineage graph: assets, references, occurrences, dataflow and dependency edges with digests as ids, and views of it that a trace reaches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dealing import dealt_join
from ..functions.graph import settled
from .resolution import CANDIDATES, digest, group_resolution, reason_rank

#: Assets that may depend on what they read (fixed values).
READERS = ("sql_query", "python_function")
LABEL = 80


def compact(c: str) -> Column:
    """Text on one line, cut to 80 characters."""
    line = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(line) <= LABEL, line).otherwise(F.concat(F.substring(line, 1, LABEL - 3), F.lit("...")))


def typed_dataflows(flows: DataFrame) -> DataFrame:
    """flows (position, source_id, dataflow_id, name, source, target, stage) with an id: the digest of what they connect and how many alike come before."""
    alike = Window.partitionBy("source_id", "dataflow_id", "source", "target").orderBy("position")
    n = (F.row_number().over(alike) - 1).cast("string")
    return flows.withColumn("id", digest("dataflow", F.col("source_id").cast("string"), F.col("dataflow_id"), F.col("source"), F.col("target"), F.lit("occurrence"), n))


def evidence(resolved: DataFrame, flows: DataFrame) -> DataFrame:
    """Resolved references of dataflows, each with the asset that reads it, and self-references rejected.

    resolved: the columns of resolution.resolve, with dataflow (the position of the flow), provenance and location; order is that of `reference`.
    The reader of a dataflow's references is its source asset. One that resolves to its own reader is open, with the method self_reference_rejected.
    """
    readers = flows.select(F.col("position").alias("dataflow"), F.col("source").alias("reader"), "dataflow_id")
    own = resolved.join(readers, "dataflow")
    own_self = F.coalesce(F.col("asset") == F.col("reader"), F.lit(False))
    provenance = F.when(F.col("provenance").isin("sql", "python_sql"), F.col("provenance")).otherwise("python")
    told = own.withColumn("self", own_self)
    new = {"state": F.when(F.col("self"), "unresolved").otherwise(F.col("state")), "reason": F.when(F.col("self"), "no_match").otherwise(F.col("reason")), "method": F.when(F.col("self"), "self_reference_rejected").otherwise(F.col("method")), "asset": F.when(~F.col("self"), F.col("asset")), "provenance": provenance}
    out = told.withColumns(new)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    place = F.concat_ws("|", *[F.lower(F.trim(text(c))) for c in ("catalog", "database", "schema_name")])
    key = [F.col("reader"), F.col("reference_id"), F.col("provenance"), F.lower(F.trim("value")), place, text("location"), text("context_scope"), text("context_scope_source"), text("addressing_mode"), text("qualification_level")]
    dynamic = F.col("reference_type") == "unknown"
    occurrence = F.when(dynamic, digest("reference-occurrence", F.col("reference_id"), F.col("reader"), F.col("provenance"), F.lower(F.trim("value")))).otherwise(digest("reference-occurrence", *key))
    return out.filter("reference_id is not null").withColumn("occurrence_id", occurrence)


def occurrences(found: DataFrame) -> DataFrame:
    """One row for each occurrence of a reference: the first evidence's text and method, all evidence's resolution, and how often it was seen.

    Any open evidence leaves it open, for the most telling reason; else one manual row makes it manual. A repeated occurrence costs one row in the map-side part of the aggregation.
    """
    open_ = F.col("state") == "unresolved"
    first = F.min(F.struct("reference", "reference_id", "reference_type", "normalized_value", "value", "provenance", "reader", "method", "context_scope", "addressing_mode", "qualification_level", "candidates"))
    own = found.groupBy("occurrence_id").agg(first.alias("f"), F.count(F.lit(1)).alias("seen"), F.min(F.when(open_, F.struct(reason_rank().alias("rank"), F.coalesce("reason", F.lit("incomplete")).alias("reason")))).alias("open"), F.bool_or(F.col("state") == "manual").alias("manual"), F.min_by("asset", F.when(F.col("asset").isNotNull(), F.col("reference"))).alias("asset"), F.max_by("asset", F.when(F.col("asset").isNotNull(), F.col("reference"))).alias("last"))
    state = F.when(F.col("open").isNotNull(), "unresolved").when(F.col("manual"), "manual").otherwise("automatic")
    return own.select("occurrence_id", *[F.col(f"f.{c}") for c in ("reference_id", "reference_type", "normalized_value", "provenance", "reader", "method", "context_scope", "addressing_mode", "qualification_level", "candidates")], F.col("f.reference").alias("first"), F.col("f.value").alias("raw_value"), state.alias("state"), F.col("open.reason").alias("reason"), "asset", "last", "seen").withColumn("display_name", compact("raw_value"))


def dependencies(occurred: DataFrame) -> DataFrame:
    """The edge from what an occurrence reads, its asset or else the reference, to its reader."""
    return occurred.select(digest("dependency", F.lit("reference"), F.col("occurrence_id"), F.col("reader"), F.lit("reads")).alias("id"), F.coalesce("last", "reference_id").alias("source"), F.col("reader").alias("target"), "provenance", "state", "reason", "method", "reference_id", "occurrence_id", F.col("last").alias("asset"))


def graph_diagnostics(flows: DataFrame, edges: DataFrame, assets: DataFrame) -> DataFrame:
    """code, severity and relation of flows and dependencies with a missing end, and of dependencies of an asset that doesn't read (assets: asset, asset_type)."""
    kinds = assets.select(F.col("asset").alias("end"), "asset_type")
    salt = lambda c: F.xxhash64(c)
    ends = flows.select("id", F.explode(F.array("source", "target")).alias("end"))
    bad = dealt_join(ends, kinds, ["end"], salt("id")).filter("asset_type is null").select("id").distinct().select(F.lit("dangling_dataflow").alias("code"), "id")
    at = dealt_join(edges.select("id", F.col("target").alias("end"), "asset"), kinds, ["end"], salt("id")).withColumnsRenamed({"end": "target", "asset": "end", "asset_type": "of_target"})
    both = dealt_join(at, kinds, ["end"], salt("id"))
    gone = F.col("of_target").isNull() | (F.col("end").isNotNull() & F.col("asset_type").isNull())
    code = F.when(gone, "dangling_dependency").when(~F.col("of_target").isin(*READERS), "invalid_dependency_target")
    return bad.unionByName(both.select(code.alias("code"), "id").filter("code is not null")).select("code", F.lit("error").alias("severity"), F.col("id").alias("relation"))


def resolution_diagnostics(found: DataFrame, flows: DataFrame) -> DataFrame:
    """code, severity and subject of evidence that stays open or refers to its reader, and of dataflow ids that connect several pairs."""
    code = F.concat(F.lit("dependency_"), F.coalesce("reason", F.lit("unresolved")))
    grave = F.col("reason").isin("multiple_matches", "target_missing")
    open_ = found.filter((F.col("asset").isNull()) & (F.col("reference_type") != "unknown")).select(code.alias("code"), F.when(grave, "warning").otherwise("info").alias("severity"), F.col("occurrence_id").alias("subject"))
    own = found.filter("self").select(F.lit("dependency_self_reference").alias("code"), F.lit("warning").alias("severity"), F.col("occurrence_id").alias("subject"))
    pairs = flows.groupBy("dataflow_id").agg(F.min(F.struct("source", "target")).alias("low"), F.max(F.struct("source", "target")).alias("high")).filter("low <> high")
    return open_.unionByName(own).unionByName(pairs.select(F.lit("dataflow_identity_conflict").alias("code"), F.lit("warning").alias("severity"), F.col("dataflow_id").alias("subject")))


def references(occurred: DataFrame, edges: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """One row a reference, folded over its occurrences, resolved as the valid dependencies are; `limit` candidates are listed."""
    first = F.min(F.struct("first", "reference_type", "normalized_value", "display_name"))
    own = occurred.groupBy("reference_id").agg(first.alias("f"), F.count(F.lit(1)).alias("occurrence_count"), F.count_distinct("reader").alias("consumer_count"), F.array_sort(F.collect_set("provenance")).alias("provenances"))
    listed = occurred.select("reference_id", F.explode("candidates").alias("c")).distinct().withColumn("r", F.row_number().over(Window.partitionBy("reference_id").orderBy("c"))).filter(F.col("r") <= limit).groupBy("reference_id").agg(F.array_sort(F.collect_list("c")).alias("candidates"))
    state = group_resolution(edges, ["reference_id"]).withColumnRenamed("occurrences", "dependency_count")
    out = own.join(listed, "reference_id", "left").join(state, "reference_id", "left")
    return out.select("reference_id", "f.reference_type", "f.normalized_value", "f.display_name", "occurrence_count", "consumer_count", F.coalesce("dependency_count", F.lit(0)).alias("dependency_count"), "provenances", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"), F.coalesce("state", F.lit("unresolved")).alias("state"), F.when(F.col("state").isNull(), "no_match").otherwise(F.col("reason")).alias("reason"), "asset")


def build(assets: DataFrame, flows: DataFrame, resolved: DataFrame) -> dict[str, DataFrame]:
    """The typed graph as tables: dataflows, occurrences, dependencies, references and diagnostics.

    assets: asset and asset_type; flows: see typed_dataflows; resolved: see evidence. Flows and dependencies that a diagnostic calls wrong aren't edges,
    and references are resolved by the dependencies that are left.
    """
    made = settled(typed_dataflows(flows))
    found = settled(evidence(resolved, made))
    seen = settled(occurrences(found))
    edges = settled(dependencies(seen))
    wrong = settled(graph_diagnostics(made, edges, assets))
    bad = wrong.select(F.col("relation").alias("id")).distinct()
    kept = edges.join(bad, "id", "left_anti")
    told = wrong.withColumnRenamed("relation", "subject").unionByName(resolution_diagnostics(found, made))
    return {"dataflows": made.join(bad, "id", "left_anti"), "occurrences": seen, "dependencies": kept, "references": references(seen, kept), "diagnostics": told}


def summary(graph: dict[str, DataFrame], assets: DataFrame) -> DataFrame:
    """One row of counts (assets: asset, asset_type, sources)."""
    count = lambda df, **c: df.agg(*[v.alias(k) for k, v in c.items()])
    by = lambda s: F.count_if(F.col("state") == s)
    rows = [
        count(assets, assets=F.count(F.lit(1)), stitched_assets=F.count_if(F.col("sources") > 1)),
        count(graph["references"], references=F.count(F.lit(1)), **{f"{s}_references": by(s) for s in ("automatic", "manual", "unresolved")}),
        count(graph["dataflows"], dataflows=F.count(F.lit(1))),
        count(graph["dependencies"], dependencies=F.count(F.lit(1)), **{f"{s}_dependencies": by(s) for s in ("automatic", "manual", "unresolved")}),
        count(graph["diagnostics"], diagnostics=F.count(F.lit(1))),
    ]
    return reduce(lambda a, b: a.crossJoin(b), rows)  # one row each


# views


def relations(dataflows: DataFrame, edges: DataFrame) -> DataFrame:
    """Both kinds of edges: id, source, target, type, stage of dataflows, and asset and state of dependencies."""
    none = lambda c: F.lit(None).cast("string").alias(c)
    return dataflows.select("id", "source", "target", F.lit("dataflow").alias("type"), "stage", none("asset"), none("state"), none("reference_id")).unionByName(edges.select("id", "source", "target", F.lit("dependency").alias("type"), none("stage"), "asset", "state", "reference_id"))


def meet(ways: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """(label, source, target): the ways whose `end` is one of nodes (label, node, all different), of the same label where ways have labels, else once for each label of the node."""
    nodes, salt = nodes.withColumnRenamed("node", end), F.xxhash64("source" if end == "target" else "target")
    if "label" in ways.columns:
        return dealt_join(ways, nodes, ["label", end], salt, "inner").select("label", "source", "target")
    labels = nodes.groupBy(end).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return dealt_join(ways, labels, [end], salt, "inner").select(F.explode("labels").alias("label"), "source", "target")


def touched(ways: DataFrame, starts: DataFrame, direction: str) -> DataFrame:
    """(label, source, target): the ways, which are all different, on paths upstream, downstream or both from starts (label, up, down), for each label apart.

    Goes on until nothing new is reached. Each round meets the ways at the nodes that were reached last. A way stands for all relations between its
    ends, so rows grow with labels and ways, not with labels and relations. Ways may have labels that they hold for.
    """
    found = []
    for end, other, start in (("target", "source", "up"), ("source", "target", "down")):
        if direction == ("downstream" if start == "up" else "upstream"):
            continue
        front = seen = settled(starts.select("label", F.col(start).alias("node")).filter("node is not null").distinct())
        while not front.isEmpty():
            met = meet(ways, front, end).select("label", F.col(other).alias("node")).filter("node is not null").distinct()
            front = settled(met.join(seen, ["label", "node"], "left_anti"))
            seen = settled(seen.unionByName(front))
        found.append(meet(ways, seen, end))
    return settled(reduce(DataFrame.unionByName, found).distinct())


def at_ways(rows: DataFrame, ways: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows at one of ways, by label, source and target as far as ways have them; with left_anti those at none."""
    key = F.struct(*[c for c in ("label", "source", "target") if c in ways.columns])  # null ends are alike in it
    return rows.withColumn("__way", key).join(ways.select(key.alias("__way")), "__way", how).select(*rows.columns)


def spread(edges: DataFrame, ways: DataFrame) -> DataFrame:
    """(label, id) of the relations (id, source, target) at each of ways (label, source, target).

    A way's labels meet each of its relations as one list, so what is shuffled grows with the relations and not with the result.
    """
    ends = F.struct("source", "target").alias("ends")
    labels = ways.groupBy(ends).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return dealt_join(edges.select("id", ends).distinct(), labels, ["ends"], F.xxhash64("id"), "inner").select(F.explode("labels").alias("label"), "id")


def matches(edges: DataFrame, assets: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    """Relations that meet all filters: connections, formats and resolutions of an asset at either end, stages of a dataflow, resolutions of a dependency too.

    assets: asset, connection_name, format, endpoint_kind, declaration_status.
    """
    tests = {"connections": lambda v: F.col("connection_name").isin(v), "formats": lambda v: F.col("format").isin(v) | F.col("endpoint_kind").isin(v), "resolutions": lambda v: F.col("declaration_status").isin(v)}
    wanted = {k: v for k, v in filters.items() if v}
    flags = assets.select(F.col("asset").alias("end"), *[F.coalesce(tests[k](v), F.lit(False)).alias(k) for k, v in wanted.items() if k in tests])
    out = edges
    for side in ("source", "target"):
        named = flags.withColumnsRenamed({"end": side} | {k: f"__{side}_{k}" for k in tests})
        out = dealt_join(out, named, [side], F.xxhash64("id"))
    test = F.lit(True)
    for k, v in wanted.items():
        if k == "stages":
            test &= F.coalesce((F.col("type") == "dataflow") & F.col("stage").isin(v), F.lit(False))
            continue
        own = F.coalesce(f"__source_{k}", F.lit(False)) | F.coalesce(f"__target_{k}", F.lit(False))
        test &= own | F.coalesce(F.col("state").isin(v), F.lit(False)) if k == "resolutions" else own
    return out.filter(test).select(*edges.columns)


def visible(edges: DataFrame, assets: DataFrame, focuses: DataFrame | None = None, direction: str = "both", filters: dict[str, list[str]] | None = None, show_references: bool = False) -> DataFrame:
    """(label, id): the relations of a view of the graph, each once.

    edges: see relations; an id has one source and target. Relations between the same ends are walked as one way. focuses (label, kind, focus): assets, references, dataflows or dependencies to trace from, each label apart; without any, the whole graph
    is one view with the label 0. filters: connections, stages, formats, resolutions; the relations in the trace that meet all of them are the seeds of a second trace
    within the first. Dependencies on references that nothing resolves show only if there is a focus, if asked for, or if resolutions
    asks for `unresolved`. direction: upstream, downstream or both.
    """
    filters = {k: v for k, v in (filters or {}).items() if v}
    shown = focuses is not None or show_references or "unresolved" in filters.get("resolutions", [])
    open_ = edges if shown else edges.filter((F.col("type") == "dataflow") | F.col("asset").isNotNull())
    if focuses is None and not filters:
        return open_.select(F.lit(0).alias("label"), "id")
    ways, at = settled(open_.select("source", "target").distinct()), None
    if focuses is None:
        scope = ways.select(F.lit(0).alias("label"), "source", "target")
    else:
        nodes = focuses.filter("kind = 'asset'").select("label", F.col("focus").alias("up"), F.col("focus").alias("down"))
        own = focuses.filter(F.col("kind").isin("dataflow", "dependency")).select("label", "kind", F.col("focus").alias("id")).join(open_, "id").filter(F.col("kind") == F.col("type"))
        # a reference stands for the dependencies that it is read by, resolved or not
        read = focuses.filter(F.col("kind") == "reference").select("label", F.col("focus").alias("reference_id")).join(open_, "reference_id")
        at = settled(own.select("label", "id", "source", "target").unionByName(read.select("label", "id", "source", "target")).distinct())
        scope = touched(ways, nodes.unionByName(at.select("label", F.col("source").alias("up"), F.col("target").alias("down"))), direction)
        # of a way that isn't in the scope only the relations in focus are
        at = settled(at_ways(at, scope, "left_anti"))
        if not filters:
            return spread(open_, scope).unionByName(at.select("label", "id"))
    hits = settled(matches(open_, assets, filters).select("id", "source", "target"))
    seeds = settled(at_ways(scope, hits.select("source", "target").distinct()))
    starts, inside = seeds, scope
    if at is not None:
        at_hits = at.join(hits.select("id").distinct(), "id", "left_semi")
        starts, inside = starts.unionByName(at_hits.select("label", "source", "target")), settled(scope.unionByName(at.select("label", "source", "target").distinct()))
    # inside a label's scope only
    traced = touched(inside, starts.select("label", F.col("source").alias("up"), F.col("target").alias("down")), direction)
    # all relations of a traced way, of another those that match
    found = spread(open_, at_ways(scope, traced)).unionByName(spread(hits, at_ways(seeds, traced, "left_anti")))
    if at is None:
        return found
    return found.unionByName(at_ways(at, traced).select("label", "id").unionByName(at_hits.select("label", "id")).distinct())


def view_entities(shown: DataFrame, edges: DataFrame, focuses: DataFrame | None = None) -> DataFrame:
    """(label, entity, issues): the ends of the shown relations, focused nodes, and how many open references each reads."""
    on = shown.join(edges, "id").select("label", F.explode(F.array("source", "target")).alias("entity"))
    if focuses is not None:
        on = on.unionByName(focuses.filter(F.col("kind").isin("asset", "reference")).select("label", F.col("focus").alias("entity")))
    issues = edges.filter("state = 'unresolved'").groupBy(F.col("target").alias("entity")).agg(F.count_distinct("reference_id").alias("issues"))
    return on.distinct().join(issues, "entity", "left").select("label", "entity", F.coalesce("issues", F.lit(0)).alias("issues"))
