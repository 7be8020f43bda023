"""Assets, references and lineage as joins over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import filled
from ..functions.dealing import dealt_join
from ..functions.graph import components


def normalize_path(c: Column | str) -> Column:
    """Scheme in lower case (s3a and s3n as s3), single slashes, none at the end; the path's case stays."""
    c = F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\\", "/"))
    scheme = F.regexp_replace(F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), "^s3[an]$", "s3")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "/+", "/"), "(?<=.)/$", "")
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), rest)).otherwise(rest)


def normalize_api_url(url: Column | str, method: Column | str | None = None) -> Column:
    """`METHOD https://host/path` with scheme and host in lower case, without query and end slash."""
    url = F.trim(F.col(url) if isinstance(url, str) else url)
    host = F.lower(F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/+", "/"), "/$", "")
    verb = F.upper(F.coalesce(filled(method) if method is not None else F.lit(None), F.lit("GET")))
    return F.when(host != "", F.concat(verb, F.lit(" "), host, path))


def storage_authority(c: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]+)", 1)), F.lit(""))


def connection_instance(side: str = "") -> Column:
    """What tells two connections to different systems apart: explicit name, host and port, API or storage authority, catalog or database."""
    p = f"{side}_" if side else ""
    return F.lower(F.coalesce(filled(f"{p}connection_instance"), F.when(filled(f"{p}host").isNotNull(), F.concat_ws(":", filled(f"{p}host"), F.col(f"{p}port").cast("string"))), storage_authority(f"{p}base_url"), storage_authority(f"{p}base_path"), filled(f"{p}catalog"), filled(f"{p}database"), filled(f"{p}connection_name")))


def asset_identifiers(endpoints: DataFrame) -> DataFrame:
    """endpoints (node, instance, catalog, database, schema_name, table, path, url, method) with one row an identifier.

    Tables are named within their connection's instance.
    """
    table = F.lower(F.concat_ws(".", *[filled(c) for c in ("catalog", "database", "schema_name", "table")]))
    ids = F.array_compact(F.array(
        F.when(filled("table").isNotNull(), F.struct(F.lit("logical_table").alias("kind"), F.concat_ws("::", "instance", table).alias("value"), F.lit(1).alias("priority"))),
        F.when(filled("path").isNotNull(), F.struct(F.lit("physical_path").alias("kind"), normalize_path("path").alias("value"), F.lit(2).alias("priority"))),
        F.when(filled("url").isNotNull(), F.struct(F.lit("api_endpoint").alias("kind"), normalize_api_url("url", "method").alias("value"), F.lit(3).alias("priority"))),
    ))
    return endpoints.select("node", F.inline(ids)).filter("value is not null")


def asset_identity(endpoints: DataFrame) -> DataFrame:
    """node, kind and digest of what an endpoint is: a query, a function, an API, a table, a path or unresolved."""
    kind = F.when(filled("query").isNotNull(), "query").when(filled("python_function").isNotNull(), "function").when(filled("url").isNotNull(), "api").when(filled("table").isNotNull(), "table").when(filled("path").isNotNull(), "path").otherwise("unresolved")
    text = F.when(filled("query").isNotNull(), F.regexp_replace(F.lower("query"), r"\s+", " ")).when(filled("python_function").isNotNull(), F.col("python_function")).when(filled("url").isNotNull(), normalize_api_url("url", "method")).when(filled("table").isNotNull(), F.lower(F.concat_ws(".", *[filled(c) for c in ("catalog", "database", "schema_name", "table")]))).when(filled("path").isNotNull(), normalize_path("path")).otherwise(F.col("node").cast("string"))
    return endpoints.select("node", kind.alias("kind"), F.sha1(F.concat_ws("|", kind, F.coalesce("instance", F.lit("")), text)).alias("asset_key"))


def stitch_assets(identifiers: DataFrame) -> DataFrame:
    """node, asset (smallest node of its group) and whether the node conflicts with those it shares an identifier with.

    Nodes that share any identifier are one asset, through chains too, unless their first identifiers (the lowest priority number) are
    of one kind and differ, as two tables that name one path: then the group of its smallest node keeps the nodes that agree with
    it or have no such identifier, and the others are assets of their own, marked as conflicts. Pairs aren't made: each node is linked to the
    smallest that has its identifier.
    """
    heads = identifiers.groupBy("kind", "value").agg(F.min("node").alias("head"))
    edges = identifiers.join(heads, ["kind", "value"]).select(F.col("head").alias("a"), F.col("node").alias("b"))
    placed = components(edges)
    first = identifiers.filter("priority = 1").groupBy("node").agg(F.min("value").alias("named"))
    both = placed.join(first, "node", "left")
    lead = both.filter("named is not null").groupBy("component").agg(F.min_by("named", "node").alias("lead"))
    both = both.join(lead, "component", "left").withColumn("conflict", F.coalesce(F.col("named") != F.col("lead"), F.lit(False)))
    part = F.when(F.col("conflict"), F.col("named")).otherwise("")
    own = both.groupBy("component", part.alias("part")).agg(F.min("node").alias("asset"))
    return both.withColumn("part", part).join(own, ["component", "part"]).select("node", "asset", "conflict")


def sql_table_references(queries: DataFrame) -> DataFrame:
    """query_id, position, name and qualification of tables that SQL texts (query_id, sql) read or write, without their own CTEs.

    Comments and literals are blanked first. Texts in which nothing is found give one row with the diagnostic `no_table`.
    """
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("sql", r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " "), r"'(?:[^']|'')*'", "''")
    clean = F.regexp_replace(clean, r"\s+", " ")
    ident = r'((?:[`"\[]?[A-Za-z_][\w$]*[`"\]]?)(?:\.[`"\[]?[A-Za-z_][\w$]*[`"\]]?)*)'
    strip = lambda a: F.transform(a, lambda x: F.lower(F.regexp_replace(x, r'[`"\[\]]', "")))
    found = strip(F.regexp_extract_all(clean, F.lit(rf"(?i)\b(?:from|join|using|into|update|table)\s+{ident}(?!\s*\()"), F.lit(1)))
    ctes = strip(F.regexp_extract_all(clean, F.lit(rf"(?i)(?:\bwith|,)\s*(?:recursive\s+)?{ident}\s+as\s*\("), F.lit(1)))
    noise = F.array(*map(F.lit, ("select", "values", "lateral", "unnest")))
    named = queries.select("query_id", F.filter(F.array_except(F.array_distinct(found), ctes), lambda x: ~F.array_contains(noise, x)).alias("names"))
    rows = named.select("query_id", F.posexplode_outer("names").alias("position", "name"))
    level = F.size(F.split("name", r"\."))
    return rows.select("query_id", F.coalesce("position", F.lit(0)).alias("position"), "name", F.when(F.col("name").isNull(), 0).otherwise(level).alias("qualification"), F.when(F.col("name").isNull(), "no_table").alias("diagnostic"))


#: Call names whose first literal argument names what is read, by kind.
CALLS = {"table": r"(?:read\.table|spark\.table|\.table|saveAsTable|insertInto)", "path": r"(?:\.parquet|\.csv|\.json|\.orc|\.load|\.save|open)", "sql": r"(?:spark\.sql|\.sql|read_sql|execute)"}


def code_references(files: DataFrame) -> DataFrame:
    """file, function, kind and value of literal arguments of reading calls in Python sources (file, code); others give `dynamic_<kind>`."""
    clean = F.regexp_replace("code", r"(?m)#[^\n]*$", "")
    parts = files.select("file", F.explode(F.split(clean, r"(?m)^(?=\s*(?:async\s+)?def\s)")).alias("body")).withColumn("function", F.coalesce(F.nullif(F.regexp_extract("body", r"^\s*(?:async\s+)?def\s+(\w+)", 1), F.lit("")), F.lit("<module>")))
    out = None
    for kind, call in CALLS.items():
        args = F.regexp_extract_all("body", F.lit(rf"{call}\(\s*([^,)]+)"), F.lit(1))
        one = parts.select("file", "function", F.explode(args).alias("arg"))
        text = F.regexp_extract("arg", r"""^[rb]?["']+([^"'{}]*)["']+\s*$""", 1)
        one = one.select("file", "function", F.when(text == "", f"dynamic_{kind}").otherwise(kind).alias("kind"), F.when(text != "", text).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def reference_signature(refs: DataFrame) -> DataFrame:
    """refs (reference_type, value, scope) with addressing mode, qualification level and a digest that names the reference."""
    mode = F.when(F.col("reference_type") == "path", F.when(F.col("value").rlike("^[A-Za-z][A-Za-z0-9+.-]*://|^/"), "absolute_path").otherwise("relative_path")).otherwise("qualified_name")
    level = F.when(F.col("reference_type") == "path", 0).otherwise(F.size(F.split("value", r"\.")))
    return refs.withColumns({"addressing": mode, "qualification": level, "signature": F.sha1(F.concat_ws("|", "reference_type", F.lower("value"), F.coalesce("scope", F.lit(""))))})


def suffixes(c: str) -> Column:
    """Every dotted suffix of a name."""
    parts = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def resolve_references(refs: DataFrame, tables: DataFrame) -> DataFrame:
    """reference, status and asset: refs (reference, name, instance) against tables (asset, instance, full_name).

    A name fits a table whose full name ends with it. One within the reference's own instance is `resolved`, several are `ambiguous`;
    else the only one anywhere is `cross_connection`, several are `out_of_scope`, none is `no_match`.

    Tables are brought to the first and last asset of each suffix, and of each suffix and instance, before references meet them: one asset is first and last,
    several aren't, so a reference meets at most two rows however many tables share its name. References of one name are dealt over salts.
    """
    within = F.coalesce(F.concat(F.lit("="), F.col("instance").cast("string")), F.lit(""))  # no instance is an instance of its own
    ends = tables.filter("asset is not null").select("asset", within.alias("__of"), F.explode(suffixes("full_name")).alias("name"))
    own = ends.groupBy("name", "__of").agg(F.min("asset").alias("__own_first"), F.max("asset").alias("__own_last"))
    anywhere = own.groupBy("name").agg(F.min("__own_first").alias("__first"), F.max("__own_last").alias("__last"))
    salt = F.xxhash64("reference")
    hits = dealt_join(dealt_join(refs.withColumn("__of", within), anywhere, ["name"], salt), own, ["name", "__of"], salt)
    sums = hits.groupBy("reference").agg(F.min("__own_first").alias("a"), F.max("__own_last").alias("b"), F.min("__first").alias("c"), F.max("__last").alias("d"))
    none, nowhere = F.col("a").isNull(), F.col("c").isNull()
    one, only = F.coalesce(F.col("a") == F.col("b"), F.lit(False)), F.coalesce(F.col("c") == F.col("d"), F.lit(False))
    status = F.when(one, "resolved").when(~none, "ambiguous").when(only, "cross_connection").when(~nowhere, "out_of_scope").otherwise("no_match")
    return sums.select("reference", status.alias("status"), F.when(one, F.col("a")).when(none & only, F.col("c")).alias("asset"))


def apply_mappings(resolved: DataFrame, mappings: DataFrame, assets: DataFrame) -> DataFrame:
    """Manual mappings (reference, target) win: `manual`, `manual_ambiguous` for several targets, `target_missing` without asset."""
    m = mappings.groupBy("reference").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
    both = resolved.join(m, "reference", "left").join(assets.select(F.col("asset").alias("target"), F.lit(True).alias("there")).distinct(), "target", "left")
    status = F.when(F.col("n") > 1, "manual_ambiguous").when((F.col("n") == 1) & F.col("there").isNull(), "target_missing").when(F.col("n") == 1, "manual").otherwise(F.col("status"))
    return both.select("reference", status.alias("status"), F.when(F.col("n").isNull(), F.col("asset")).when((F.col("n") == 1) & F.col("there"), F.col("target")).alias("asset"))


def merge_resolution(rows: DataFrame) -> DataFrame:
    """One status for each signature over its occurrences: any unresolved wins, several targets conflict."""
    found = F.col("status").isin("resolved", "cross_connection", "manual")
    out = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("occurrences"), F.bool_and(found).alias("all"), F.count_distinct("asset").alias("targets"), F.min_by("status", F.struct(found, "status")).alias("worst"), F.min("asset").alias("asset"))
    status = F.when(~F.col("all"), F.col("worst")).when(F.col("targets") > 1, "conflicting").otherwise("resolved")
    return out.select("signature", "occurrences", status.alias("status"), F.when(F.col("all") & (F.col("targets") == 1), F.col("asset")).alias("asset"))


def build_edges(flows: DataFrame, dependencies: DataFrame) -> DataFrame:
    """source, target, kind and number of occurrences: dataflow edges and dependencies of assets on what they read; none on itself."""
    both = flows.select("source", "target", F.lit("dataflow").alias("kind")).unionByName(dependencies.select("source", "target", F.lit("dependency").alias("kind")))
    return both.filter("source is not null and target is not null and source <> target").groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("occurrences"))


def lineage_diagnostics(flows: DataFrame, assets: DataFrame, stitched: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """code and subject: dataflows with a dangling end, edges from an asset to itself, identity conflicts, and references (reference, kind, status) made at run time that nothing resolves."""
    known = assets.select(F.col("asset").alias("k"))
    ends = flows.select("dataflow", F.explode(F.array("source", "target")).alias("end"))
    dangling = ends.join(known, F.col("end") == F.col("k"), "left_anti").select(F.lit("dangling").alias("code"), F.col("dataflow").cast("string").alias("subject"))
    loops = flows.filter("source = target").select(F.lit("self_reference").alias("code"), F.col("dataflow").cast("string").alias("subject"))
    odd = stitched.filter("conflict").select(F.lit("identity_conflict").alias("code"), F.col("asset").cast("string").alias("subject"))
    found = dangling.unionByName(loops).unionByName(odd)
    if references is not None:
        open_ = references.filter(F.col("kind").startswith("dynamic") & ~F.col("status").isin("resolved", "manual"))
        found = found.unionByName(open_.select(F.lit("unresolved_dynamic").alias("code"), F.col("reference").cast("string").alias("subject")))
    return found.distinct()


def valid_relations(flows: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """flows without those that a diagnostic calls wrong: a dangling end or an edge to itself."""
    wrong = diagnostics.filter(F.col("code").isin("dangling", "self_reference")).select(F.col("subject").alias("__wrong")).distinct()
    return flows.join(wrong, F.col("dataflow").cast("string") == F.col("__wrong"), "left_anti")


def relation_filter(edges: DataFrame, assets: DataFrame, **wanted: list[str]) -> DataFrame:
    """Edges one of whose ends has each wanted attribute (connection, stage, format)."""
    for column, values in wanted.items():
        chosen = assets.filter(F.col(column).isin(values)).select(F.col("asset").alias("n"))
        near = edges.join(chosen, F.col("source") == F.col("n"), "left_semi").unionByName(edges.join(chosen, F.col("target") == F.col("n"), "left_semi"))
        edges = near.distinct()
    return edges


def search(assets: DataFrame, q: str, top: int = 8) -> DataFrame:
    """Assets that hold every token, by exact id, exact title, prefix of the title, then title."""
    tokens = [t for t in q.lower().split() if t]
    text = F.lower(F.concat_ws(" ", "asset", "title", "kind"))
    out = assets
    for t in tokens:
        out = out.filter(text.contains(t))
    rank = F.when(F.lower(F.col("asset").cast("string")) == q.lower(), 0).when(F.lower("title") == q.lower(), 1).when(F.lower("title").startswith(q.lower()), 2).otherwise(3)
    return out.withColumn("rank", rank).orderBy("rank", "title", "asset").limit(top)


def asset_inventory(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """assets with their numbers of different upstream and downstream neighbours and their position in the graph."""
    pairs = edges.select("source", "target").distinct()
    up = pairs.groupBy(F.col("target").alias("asset")).agg(F.count(F.lit(1)).alias("upstream"))
    down = pairs.groupBy(F.col("source").alias("asset")).agg(F.count(F.lit(1)).alias("downstream"))
    out = assets.join(up, "asset", "left").join(down, "asset", "left").fillna(0, ["upstream", "downstream"])
    u, d = F.col("upstream") > 0, F.col("downstream") > 0
    return out.withColumn("position", F.when(u & d, "transit").when(d, "entry").when(u, "exit").otherwise("isolated"))


def lineage_summary(inventory: DataFrame, edges: DataFrame) -> DataFrame:
    a = inventory.agg(F.count(F.lit(1)).alias("assets"), *[F.count_if(F.col("position") == p).alias(p) for p in ("entry", "transit", "exit", "isolated")])
    return a.join(edges.agg(F.count_if(F.col("kind") == "dataflow").alias("dataflow_edges"), F.count_if(F.col("kind") == "dependency").alias("dependency_edges")))


def project_registry(resolutions: DataFrame) -> DataFrame:
    """References over environments (environment, signature, status, asset): manual only if manual everywhere, conflicting with several targets."""
    manual = F.col("status") == "manual"
    out = resolutions.groupBy("signature").agg(F.count_distinct("environment").alias("environments"), F.count_distinct(F.when(F.col("asset").isNotNull(), F.col("environment"))).alias("covered"), F.bool_and(manual).alias("manual"), F.count_distinct("asset").alias("targets"))
    status = F.when(F.col("targets") > 1, "conflicting").when(F.col("targets") == 0, "unresolved").when(F.col("manual"), "manual").when(F.col("covered") < F.col("environments"), "partial").otherwise("resolved")
    return out.withColumn("status", status)


def lineage_latest_status(flows: DataFrame, latest: DataFrame) -> DataFrame:
    """flows (dataflow, name) with their newest run: by id, else by a name that only one id has."""
    by_id = latest.filter("identity like 'id:%'").select(F.col("dataflow_id").alias("dataflow"), F.col("normalized_status").alias("s1"), F.col("event_time").alias("t1"))
    newest = Window.partitionBy("n").orderBy(F.desc_nulls_last("event_time"), F.desc("dataflow_run_id"))
    by_name = latest.filter("not ambiguous_name").withColumn("n", F.lower(F.trim("dataflow_name"))).filter("n <> ''").withColumn("r", F.row_number().over(newest)).filter("r = 1").select("n", F.col("normalized_status").alias("s2"), F.col("event_time").alias("t2"))
    out = flows.join(by_id, "dataflow", "left").withColumn("n", F.lower(F.trim("name"))).join(by_name, "n", "left")
    return out.select("dataflow", "name", F.coalesce("s1", "s2", F.lit("unknown")).alias("status"), F.coalesce("t1", "t2").alias("event_time"))


def asset_detail(edges: DataFrame) -> DataFrame:
    """Every asset's neighbours on both sides as sorted text, of dataflows and dependencies apart."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    flow = F.col("kind") == "dataflow"
    up = edges.groupBy(F.col("target").alias("asset")).agg(listed(F.when(flow, F.col("source"))).alias("fed_by"), listed(F.when(~flow, F.col("source"))).alias("used_by"))
    down = edges.groupBy(F.col("source").alias("asset")).agg(listed(F.when(flow, F.col("target"))).alias("feeds"), listed(F.when(~flow, F.col("target"))).alias("depends_on"))
    return up.join(down, "asset", "full_outer").fillna("")
