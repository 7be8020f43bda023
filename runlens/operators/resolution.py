"""Identities of endpoints and references, the registry of assets, and the cascade that resolves references to assets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..functions.dealing import dealt_join, smallest
from ..functions.graph import settled

#: Columns that describe an endpoint's connection and place; endpoints without one of them have null there.
ENDPOINT = ["connection_instance", "connection_type", "database_type", "host", "port", "workspace_id", "base_path", "base_url", "catalog", "database", "schema_name", "table", "path", "api_endpoint", "method"]
#: Kinds of identifiers, in the order in which the first names an asset (fixed values).
KINDS = ("api_endpoint", "logical_table", "physical_path")
#: Reasons for an open reference, the most telling first (fixed values).
REASONS = ("target_missing", "conflicting_targets", "multiple_matches", "out_of_scope", "incomplete", "no_match")
API = ("api", "http", "rest")
CANDIDATES = 20


def clean(c: str | Column) -> Column:
    """Trimmed text, empty for null."""
    return F.coalesce(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")), F.lit(""))


def joined(separator: str, *parts: Column) -> Column:
    """The parts that aren't empty."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def physical_path(c: str | Column) -> Column:
    """Slashes, scheme in lower case (s3a as s3), none of them repeated after it or at the end."""

    def tidy(c: Column) -> Column:
        at = F.locate("://", c)
        scheme, rest = F.lower(F.substring(c, F.lit(1), at - 1)), F.regexp_replace(F.substring(c, at + 3, F.length(c)), "/{2,}", "/")
        whole = F.concat(F.regexp_replace(scheme, "^s3a$", "s3"), F.lit("://"), rest)
        return F.regexp_replace(F.when(at > 0, whole).otherwise(F.regexp_replace(c, "/{2,}", "/")), "/+$", "")

    return let(F.regexp_replace(clean(c), r"\\", "/"), tidy)


def authority(path: str | Column) -> Column:
    """Scheme and host of a path, the volume or `dbfs` of a local one, empty if there is none."""
    volume = lambda v: F.when(F.size(v) >= 4, F.concat(F.lit("databricks-volume:"), F.array_join(F.slice(v, 1, 4), "/"))).otherwise("databricks-volume")
    parts = lambda p: F.filter(F.split(p, "/"), lambda x: x != "")
    return let(physical_path(path), lambda p: F.when(p.contains("://"), F.lower(F.regexp_extract(p, r"^([^:]*://[^/?#]*)", 1))).when(p.startswith("/Volumes/"), volume(parts(p))).when(p.startswith("dbfs:/"), "dbfs").otherwise(""))


def api_url(c: Column) -> Column:
    """Scheme and host in lower case, single slashes without one at the end, query kept; of text without scheme only the path."""
    tidy = lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), "/{2,}", "/"), "(?<=.)/$", "")
    host = lambda c: F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    rest = lambda c: F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = lambda c: F.regexp_extract(c, r"^[^?#]*(\?[^#]+)", 1)
    bare = lambda c: F.regexp_replace(tidy(c), "^$", "/")
    return let(F.regexp_replace(clean(c), r"\\", "/"), lambda c: F.when(c == "", "").when(c.contains("://"), F.concat(host(c), tidy(rest(c)), query(c))).otherwise(bare(c)))


def api_authority(base: str | Column) -> Column:
    """A base URL without query; empty without a scheme."""
    return let(api_url(F.col(base) if isinstance(base, str) else base), lambda url: F.when(url.contains("://"), F.regexp_extract(url, r"^([^?#]*?)/?(?:[?#]|$)", 1)).otherwise(""))


def connection_scope(prefix: str = "") -> tuple[Column, Column]:
    """(instance, resolution scope) of an endpoint's connection, from the first evidence there is: an explicit name, the database's type, host
    and port, the API's base, the workspace, the storage's authority, catalog and database.

    Two databases of one server share an instance, which identifiers are made of, but not a scope, within which names are looked up.
    """
    c = lambda name: clean(f"{prefix}{name}")
    low = lambda name: F.lower(c(name))
    is_db = (low("connection_type") == "database") | (low("database_type") != "")
    server = joined(":", F.coalesce(F.nullif(low("database_type"), F.lit("")), F.lit("database")), F.coalesce(F.nullif(low("host"), F.lit("")), F.lit("local")), c("port"))
    storage = authority(f"{prefix}base_path")
    place = F.when((low("catalog") != "") | (low("database") != ""), F.concat(F.lit("catalog:"), F.coalesce(F.nullif(low("catalog"), F.lit("")), F.lit("_")), F.lit(":"), F.coalesce(F.nullif(low("database"), F.lit("")), F.lit("_")))).otherwise("")
    api = low("connection_type").isin(*API) & (c("base_url") != "")
    instance = (
        F.when(c("connection_instance") != "", c("connection_instance"))
        .when(is_db, server)
        .when(api, api_authority(f"{prefix}base_url"))
        .when(low("workspace_id") != "", F.concat(F.lit("workspace:"), low("workspace_id")))
        .when(storage != "", storage)
        .otherwise(place)
    )
    selected = lambda name: F.when(low(name) != "", F.concat(F.lit(f"{name}:"), low(name))).otherwise("")
    inside = lambda i: joined("|", F.coalesce(F.nullif(i, F.lit("")), F.nullif(low("database_type"), F.lit("")), F.lit("database")), selected("catalog"), selected("database"))
    return instance, let(F.lower(F.trim(instance)), lambda i: F.when(is_db, inside(i)).otherwise(i))


def endpoint_keys(endpoints: DataFrame) -> DataFrame:
    """endpoints (environment, node, position, the columns of ENDPOINT) with api_endpoint, logical_table and physical_path as they identify an asset, null where an
    endpoint has none, and its scope.
    """
    made = connection_scope()
    endpoints = endpoints.withColumns({"__instance": made[0], "__scope": made[1]})
    instance, scope = F.col("__instance"), F.col("__scope")
    is_api = F.lower(clean("connection_type")).isin(*API)
    names = [clean(c) for c in ("catalog", "database", "schema_name", "table")]
    named = (names[3] != "") & (F.concat(*names[:3]) != "") & ~is_api
    table = F.concat(F.when(instance != "", F.concat(instance, F.lit("|"))).otherwise(""), F.lower(joined(".", *names)))
    route, base = clean("api_endpoint"), clean("base_url")
    url = F.when(route.contains("://"), api_url(route)).when(base == "", "").when(route != "", api_url(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(route, "^/+", "")))).otherwise(api_url(base))
    verb = F.coalesce(F.nullif(F.upper(clean("method")), F.lit("")), F.lit("GET"))
    endpoints = endpoints.withColumns({"__url": url, "__space": api_authority("base_url")})
    url, space = F.col("__url"), F.col("__space")
    api = F.concat(F.when(space != "", F.concat(space, F.lit("|"))).otherwise(""), verb, F.lit(" "), url)
    path = F.nullif(physical_path("path"), F.lit(""))
    return endpoints.select("environment", "node", "position", F.when(is_api & (url != ""), api).alias("api_endpoint"), F.when(named, table).alias("logical_table"), path.alias("physical_path"), F.nullif(scope, F.lit("")).alias("scope"))


def digest(prefix: str, *parts: Column | str) -> Column:
    """prefix and the first 20 digits of the SHA-1 of the parts joined by colons."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha1(text.cast("binary")), 1, 20))


def register_assets(keys: DataFrame) -> DataFrame:
    """(environment, node, asset, conflict, reason, candidates) of keys (environment, node, position, api_endpoint, logical_table, physical_path), as if the nodes of each environment were registered one by one in the order of position.

    A node that holds no known identifier founds an asset; one whose known identifiers all belong to one asset joins it, and brings its
    other identifiers, unless it has another value of a kind that the asset has; in that case, or if it meets several assets, it is an asset of
    its own, marked as a conflict, with the assets it met as candidates, and its identifiers stay free. Position has to be unique over all environments.

    Nodes alike in all identifiers are decided once. In each round all those are decided that no earlier open one can influence: those that are the first open holder
    of each identifier that is still free, and, if they join, the first to bring one to that asset; conflicts are known at once and hold nobody up. Founding, joining and conflicts are
    final, as owners and values of an asset never change, so a popular identifier is settled in a few rounds. What a node in conflict met is read from the
    identifiers that earlier nodes registered. Nodes without identifiers are assets of their own. No nodes give none.
    """
    has_any = F.coalesce(*[F.col(k) for k in KINDS]).isNotNull()
    tuples = settled(keys.filter(has_any).groupBy("environment", *KINDS).agg(F.min("position").alias("t")))
    ids = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"))) for k in KINDS]))
    on = ["environment", "kind", "value"]
    open_ = tuples.select("t", "environment", *KINDS)
    owners = settled(open_.limit(0).select("environment", F.lit("").alias("kind"), F.lit("").alias("value"), F.col("t").alias("asset"), F.col("t").alias("by")))
    groups = settled(open_.limit(0).select(F.col("t").alias("asset"), *KINDS))
    done = settled(open_.limit(0).select("t", F.col("t").alias("asset")))
    while not open_.isEmpty():
        held = dealt_join(open_.select("t", "environment", F.inline(ids)), owners, on, F.col("t"))
        free = F.array_compact(F.collect_list(F.when(F.col("asset").isNull(), F.struct("kind", "value"))))
        met = held.groupBy("t").agg(F.min("asset").alias("asset"), F.max("asset").alias("other"), free.alias("free"))
        known = dealt_join(open_.join(met, "t"), groups.select("asset", *[F.col(k).alias(f"own_{k}") for k in KINDS]), ["asset"], F.col("t"))
        clash = reduce(Column.__or__, [F.coalesce(F.col(k) != F.col(f"own_{k}"), F.lit(False)) for k in KINDS])
        conflict = F.coalesce(F.col("asset") != F.col("other"), F.lit(False)) | clash
        state = settled(known.withColumn("conflict", conflict).select("t", "environment", *KINDS, "free", "asset", "conflict"))
        live = state.filter("not conflict")
        # the first open holder of each free identifier, and the first that is to bring one to an asset
        holder = live.select("t", "environment", F.inline("free")).groupBy(*on).agg(F.min("t").alias("first"))
        behind = dealt_join(live.select("t", "environment", F.inline("free")), holder, on, F.col("t")).groupBy("t").agg(F.bool_or(F.col("first") < F.col("t")).alias("behind"))
        bringer = live.filter((F.size("free") > 0) & F.col("asset").isNotNull()).groupBy("asset").agg(F.min("t").alias("bringer"))
        turn = dealt_join(live, bringer, ["asset"], F.col("t")).join(behind, "t", "left")
        ready = ~F.coalesce("behind", F.lit(False)) & (F.col("asset").isNull() | (F.size("free") == 0) | (F.col("bringer") == F.col("t")))
        decided = settled(turn.withColumn("ready", ready).select("t", "environment", *KINDS, "free", F.coalesce("asset", "t").alias("asset"), "ready"))
        won = decided.filter("ready")
        done = settled(done.unionByName(won.select("t", "asset")).unionByName(state.filter("conflict").select("t", F.lit(None).cast("long").alias("asset"))))
        owners = settled(owners.unionByName(won.select("environment", F.inline("free"), "asset", F.col("t").alias("by"))))
        groups = settled(groups.unionByName(won.select("asset", *KINDS)).groupBy("asset").agg(*[F.max(k).alias(k) for k in KINDS]))
        open_ = decided.filter("not ready").select("t", "environment", *KINDS)
    # names: an asset's is the digest of the first identifier of the node that founded it
    founders = tuples.select(F.col("t").alias("asset"), asset_name(primary_kind(), primary_value()).alias("name"))
    named = tuples.join(done, "t").join(founders, "asset", "left").select("environment", *KINDS, "name", F.col("asset").isNull().alias("conflict"))
    # as JSON, null and empty identifiers differ
    keyed = lambda d: d.withColumn("__key", F.to_json(F.struct("environment", *KINDS)))
    all_ = settled(dealt_join(keyed(keys.select("environment", "node", "position", *KINDS)), keyed(named).drop("environment", *KINDS), ["__key"], F.xxhash64("node")))
    at_odds = dealt_join(all_.filter("conflict").select("position", "environment", F.inline(ids)), owners, on, F.col("position")).filter("by < position")
    met = at_odds.join(founders, "asset").groupBy("position").agg(F.array_sort(F.collect_set("name")).alias("candidates"))
    apart = asset_name(F.coalesce(primary_kind(), F.lit("unresolved")), F.concat(F.lit("conflict:"), F.col("node").cast("string"), F.lit(":"), F.coalesce(primary_value(), F.lit(""))))
    reason = F.when(F.size("candidates") > 1, "identifiers resolve to different assets").when(F.col("conflict"), "asset identifiers conflict")
    out = all_.join(met, "position", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    return out.select("environment", "node", F.coalesce("name", apart).alias("asset"), F.coalesce("conflict", F.lit(False)).alias("conflict"), reason.alias("reason"), "candidates")


def asset_name(kind: Column, value: Column) -> Column:
    return digest("asset", F.col("environment").cast("string"), kind, value)


def primary_kind() -> Column:
    return F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in KINDS])


def primary_value() -> Column:
    return F.coalesce(*[F.col(k) for k in KINDS])


def identifier_index(keys: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, value, asset) and (asset, scope) of nodes that aren't in conflict."""
    both = keys.join(registered.filter("not conflict").select("node", "asset"), "node")
    ids = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"))) for k in KINDS]))
    return both.select(F.inline(ids), "asset").distinct(), both.filter("scope is not null").select("asset", "scope").distinct()


def json_text(c: Column) -> Column:
    """Text as it is quoted in JSON."""
    made = F.to_json(F.struct(c.alias("v")))
    return F.substring(made, F.lit(6), F.length(made) - 6)


def reference_identity(refs: DataFrame) -> DataFrame:
    """References with their type, normalized value, digest, scope and where it is from, addressing mode, qualification and parts of their name.

    refs: reference, kind (table, path, api or other), value, catalog, database, schema_name, table, api_method, and the connection of the endpoint that
    refers, in columns of ENDPOINT that start with `context_`. A table's scope is its context's; a path's or API's is in itself. Blank values have no identity: all results are null.
    """
    kind = F.when(F.col("kind") == "table", "table_reference").when(F.col("kind") == "path", "path_reference").when(F.col("kind").isin("api", "api_endpoint", "http"), "api_endpoint_reference").otherwise("unknown")
    refs = refs.withColumn("reference_type", kind)
    kind = F.col("reference_type")
    own = F.filter(F.array(*[clean(c) for c in ("catalog", "database", "schema_name", "table")]), lambda x: x != "")
    split = F.filter(F.transform(F.split(clean("value"), r"\."), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.when(F.col("kind") == "table", F.when(F.size(own) > 0, own).otherwise(split)).otherwise(F.array().cast("array<string>"))
    refs = refs.withColumn("name_parts", parts)
    parts = F.col("name_parts")
    first, rest = F.regexp_extract("value", r"^\s*(\S+)\s+\S", 1), F.regexp_extract("value", r"^\s*\S+\s+(\S.*?)\s*$", 1)
    told = first.rlike(r"^\p{L}+$")
    verb = F.when(told, F.upper(first)).otherwise(F.coalesce(F.nullif(F.upper(clean("api_method")), F.lit("")), F.lit("GET")))
    refs = refs.withColumns({"__url": api_url(F.when(told, rest).otherwise(F.col("value"))), "__inside": connection_scope("context_")[1]})
    url = F.col("__url")
    value = (
        F.when(kind == "table_reference", F.lower(F.array_join(F.filter(F.transform(F.split(F.array_join(parts, "."), r"\."), lambda x: F.trim(x)), lambda x: x != ""), ".")))
        .when(kind == "path_reference", physical_path("value"))
        .when(kind == "api_endpoint_reference", F.concat(verb, F.lit(" "), url))
        .otherwise(F.lower(F.regexp_replace(clean("value"), r"\s+", " ")))
    )
    level = F.when(F.size(parts) >= 3, "fully_qualified").when(F.size(parts) == 2, "schema_table").otherwise("table")
    bound = (F.lower(clean("context_connection_type")) == "database") | (clean("context_database_type") != "")
    mode = F.when(kind.isin("path_reference", "api_endpoint_reference"), "physical_exact").when(kind == "unknown", "weak_logical").when(bound, "connection_bound").when(level != "table", "qualified_logical").otherwise("weak_logical")
    inside = F.nullif(F.lower(F.trim("__inside")), F.lit(""))
    host = F.nullif(F.regexp_extract(url, r"^([^:/]+://[^/?#]+)", 1), F.lit(""))
    scope = F.when(kind == "table_reference", inside).when(kind == "path_reference", F.nullif(F.lower(authority("value")), F.lit(""))).when(kind == "api_endpoint_reference", host)
    out = refs.withColumns({"normalized_value": value, "context_scope": scope, "addressing_mode": mode, "qualification_level": level}).drop("__url", "__inside")
    source = F.when(F.col("context_scope").isNotNull(), F.when(F.col("reference_type") == "table_reference", "metadata_context").otherwise("detected"))
    text = F.concat(F.lit('{"normalized_value": '), json_text(F.col("normalized_value")), F.lit(', "reference_type": "'), F.col("reference_type"), F.lit('"}'))
    blank = (clean("value") == "") & (F.size("name_parts") == 0)
    made = out.withColumns({"context_scope_source": source, "reference_id": F.concat(F.lit("reference:"), F.substring(F.sha1(text.cast("binary")), 1, 20))})
    results = ["reference_type", "normalized_value", "reference_id", "context_scope", "context_scope_source", "addressing_mode", "qualification_level"]
    return made.withColumns({c: F.when(~blank, F.col(c)) for c in results})


def resolve(refs: DataFrame, identifiers: DataFrame, scopes: DataFrame, candidates: int = CANDIDATES) -> DataFrame:
    """refs (of reference_identity) with state, reason, asset, method, candidates and how many candidates there are.

    The cascade, each step on what the one before left: a path that is an identifier; tables whose name ends with the reference's, or equals it if it is
    fully qualified, within its scope, where one resolves it and several leave it open; the only table anywhere for qualified names; and else what is known of
    tables out of scope. Without a scope every table is in it.

    Names are counted by suffix, and by suffix and scope, before references meet them, so a suffix that many tables share is one row; of its tables
    the `candidates` smallest are listed. References of one name are dealt over salts.
    """
    paths = identifiers.filter("kind = 'physical_path'").select(F.col("value").alias("path_key"), F.col("asset").alias("path_asset"))
    tables = identifiers.filter("kind = 'logical_table'").select("asset", F.regexp_replace("value", r"^[^|]*\|", "").alias("name"))
    parts = F.split("name", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, k, F.size(parts)), ".").alias("suffix"), (k == 1).alias("whole")))
    named = tables.select("asset", F.inline(ends))
    # a fully qualified name meets whole names only: they have a key of their own
    named = settled(named.filter("whole").select("asset", F.concat(F.lit("="), "suffix").alias("key")).unionByName(named.select("asset", F.concat(F.lit("."), "suffix").alias("key"))).distinct())

    def counted(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_n"))
        return n.join(smallest(df, keys, "asset", candidates).withColumnRenamed("values", name), keys)

    anywhere = counted(named, ["key"], "any")
    within = counted(named.join(scopes, "asset").select("asset", "key", F.col("scope").alias("context_scope")).distinct(), ["key", "context_scope"], "own")
    exact = F.col("qualification_level") == "fully_qualified"
    suffix = F.lower(F.array_join("name_parts", "."))
    is_table = (F.col("kind") == "table") & (clean("table") != "")
    keyed = refs.withColumns({"key": F.when(is_table & F.col("reference_id").isNotNull(), F.concat(F.when(exact, "=").otherwise("."), suffix)), "path_key": F.when(F.col("kind") == "path", F.col("normalized_value"))})
    salt = F.xxhash64("reference")
    met = dealt_join(dealt_join(dealt_join(keyed, paths, ["path_key"], salt), anywhere, ["key"], salt), within, ["key", "context_scope"], salt)
    free = F.col("context_scope").isNull()
    n, m = F.coalesce("any_n", F.lit(0)), F.coalesce(F.when(free, F.col("any_n")).otherwise(F.col("own_n")), F.lit(0))
    own = F.when(free, F.col("any")).otherwise(F.col("own"))
    across = ((F.col("addressing_mode") == "qualified_logical") | exact) & (n == 1)
    bound = ~free & F.col("addressing_mode").isin("connection_bound", "weak_logical")
    method = (
        F.when(F.col("path_asset").isNotNull(), "exact_identifier")
        .when(m == 1, "connection_scoped_table")
        .when(m > 1, "multiple_connection_table_matches")
        .when(across, "qualified_cross_connection")
        .when((n > 1) & bound, "out_of_scope_table_candidates")
        .when(n > 1, "multiple_table_suffix_matches")
        .when(n == 1, "out_of_scope_table_candidate")
        .otherwise("no_declared_asset_match")
    )
    out = met.withColumns({"method": method, "listed": F.when(F.col("path_asset").isNotNull(), F.array("path_asset")).when(m > 0, own).when(n > 0, F.col("any")).otherwise(F.array().cast("array<string>")), "candidate_count": F.when(F.col("path_asset").isNotNull(), 1).when(m > 0, m).otherwise(n).cast("long")})
    done = F.col("method").isin("exact_identifier", "connection_scoped_table", "qualified_cross_connection")
    reason = F.when(F.col("method").isin("multiple_connection_table_matches", "multiple_table_suffix_matches"), "multiple_matches").when(F.col("method").startswith("out_of_scope"), "out_of_scope").when(F.col("method") == "no_declared_asset_match", "no_match")
    results = {"state": F.when(done, "automatic").otherwise("unresolved"), "reason": reason, "asset": F.when(done, F.col("listed")[0]), "candidates": F.col("listed")}
    return out.withColumns(results).select(*refs.columns, *results, "method", "candidate_count")


def map_references(resolved: DataFrame, mappings: DataFrame, identifiers: DataFrame) -> DataFrame:
    """resolved with manual mappings (mapping, reference_type, reference_value, target_kind, target_value, normalized) applied.

    One that fits a reference's type and value decides it, whatever the cascade found: `manual`, or open because the target isn't an identifier. If
    several fit, the cascade's result stays, with the method `manual_mapping_ambiguous`. mapping_status is applied, target_missing, ambiguous or null.
    """
    own = mappings.groupBy("reference_type", F.col("reference_value").alias("normalized_value")).agg(F.count(F.lit(1)).alias("fits"), F.min(F.struct("mapping", "target_kind", "target_value")).alias("m"))
    aim = own.join(identifiers.select(F.col("kind").alias("k"), F.col("value").alias("v"), F.col("asset").alias("target")), F.expr("m.target_kind = k and m.target_value = v"), "left")
    both = dealt_join(resolved, aim.select("reference_type", "normalized_value", "fits", F.col("m.mapping").alias("mapping"), "target"), ["reference_type", "normalized_value"], F.xxhash64("reference"))
    one, hit = F.col("fits") == 1, F.col("target").isNotNull()
    status = F.when(F.col("fits") > 1, "ambiguous").when(one & hit, "applied").when(one, "target_missing")
    out = both.withColumn("mapping_status", status)
    s = F.col("mapping_status")
    new = {
        "state": F.when(s == "applied", "manual").when(s == "target_missing", "unresolved").otherwise(F.col("state")),
        "reason": F.when(s == "target_missing", "target_missing").when(s == "applied", None).otherwise(F.col("reason")),
        "asset": F.when(s == "applied", F.col("target")).when(s == "target_missing", None).otherwise(F.col("asset")),
        "method": F.when(s == "applied", "manual_mapping").when(s == "target_missing", "manual_target_missing").when(s == "ambiguous", "manual_mapping_ambiguous").otherwise(F.col("method")),
        "candidates": F.when(s == "applied", F.array("target")).otherwise(F.col("candidates")),
        "candidate_count": F.when(s == "applied", F.lit(1).cast("long")).otherwise(F.col("candidate_count")),
        "mapping": F.when(s.isin("applied", "target_missing"), F.col("mapping")),
    }
    return out.withColumns(new).drop("fits", "target")


def reason_rank() -> Column:
    """Place of `reason` in REASONS, for the most telling one of a group."""
    return F.array_position(F.array(*map(F.lit, REASONS)), F.coalesce("reason", F.lit("incomplete")))


def group_resolution(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, occurrences, state, reason and asset of rows (state, reason, asset): several targets conflict, any open row leaves the group open for
    the most telling reason of those rows, one manual row makes it manual.
    """
    open_ = F.col("state") == "unresolved"
    own = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"), F.min("asset").alias("low"), F.max("asset").alias("high"), F.min(F.when(open_, reason_rank())).alias("rank"), F.bool_or(F.col("state") == "manual").alias("manual"))
    told = F.element_at(F.array(*map(F.lit, REASONS)), F.col("rank").cast("int"))
    conflict = F.col("low") != F.col("high")
    left = F.col("low").isNull() | F.col("rank").isNotNull()
    return own.select(
        *keys, "occurrences",
        F.when(conflict | left, "unresolved").when(F.col("manual"), "manual").otherwise("automatic").alias("state"),
        F.when(conflict, "conflicting_targets").when(F.col("rank").isNotNull(), told).when(F.col("low").isNull(), "no_match").alias("reason"),
        F.when(~conflict, F.col("low")).alias("asset"),
    )
