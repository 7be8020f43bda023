"""Registered queries of identities, the registry of assets, the resolution cascade and the typed graph, over endpoints derived from parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rendered
from ..functions.graph import settled
from ..operators import resolution as R
from ..operators import typed_graph as G
from .published import kept

def text(prefix: str, n: F.Column, suffix: str = "") -> F.Column:
    return F.concat(F.lit(prefix), n.cast("string"), F.lit(suffix))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An endpoint for each part: databases, lakehouses, APIs, files and connections that say little, many of which name the same tables and paths."""
    K = F.col("p_partkey")  # noqa: N806
    made = {
        "connection_instance": F.when(K % 11 == 0, text(" Main-", K % 2)),
        "connection_type": F.when(K % 6 == 0, "database").when(K % 6 == 1, "lakehouse").when(K % 6 == 2, "api").when(K % 6 == 3, "file").when(K % 6 == 4, "Database "),
        "database_type": F.when(K % 12 == 0, "MSSQL").when(K % 12 == 5, "postgres"),
        "host": F.when(K % 4 == 1, text("Db.Host", K % 3)),
        "port": F.when(K % 8 == 1, "1433"),
        "workspace_id": F.when((K % 6 == 1) & (K % 10 < 3), text("WS", K % 3)),
        "base_path": F.when(K % 9 != 2, text("S3A://Bucket", K % 4, "//base/")),
        "base_url": F.when(K % 6 == 2, text("HTTPS://Api.Host", K % 3, "/v1//?x=1")),
        "catalog": F.when(K % 5 != 3, "Cat"),
        "database": F.when(K % 7 != 3, text("Db", K % 4)),
        "schema_name": text("s", K % 3),
        "table": F.when(K % 10 != 9, text("T", K % 40)),
        "path": F.when(K % 3 != 1, text("S3A://Bucket/x//", K % 50, "/")),
        "api_endpoint": F.when(K % 18 != 2, text("/orders//", K % 20, "/")),
        "method": F.when(K % 4 == 2, "post"),
    }
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.floor(K / 50).alias("environment"), K.alias("node"), K.alias("position"), *[c.alias(n) for n, c in made.items()])


#: The same in SQL, with what the contract makes of it: instance, scope and identifiers.
ENDPOINTS = r"""ep AS (SELECT p_partkey AS k,
  CASE WHEN p_partkey % 11 = 0 THEN 'Main-' || p_partkey % 2 ELSE '' END AS explicit, CASE p_partkey % 6 WHEN 0 THEN 'database' WHEN 1 THEN 'lakehouse' WHEN 2 THEN 'api' WHEN 3 THEN 'file' WHEN 4 THEN 'database' ELSE '' END AS ctype,
  CASE p_partkey % 12 WHEN 0 THEN 'mssql' WHEN 5 THEN 'postgres' ELSE '' END AS dtype, CASE WHEN p_partkey % 4 = 1 THEN 'db.host' || p_partkey % 3 ELSE 'local' END AS host, CASE WHEN p_partkey % 8 = 1 THEN ':1433' ELSE '' END AS port,
  CASE WHEN p_partkey % 6 = 1 AND p_partkey % 10 < 3 THEN 'workspace:ws' || p_partkey % 3 ELSE '' END AS workspace, CASE WHEN p_partkey % 9 <> 2 THEN 's3://bucket' || p_partkey % 4 ELSE '' END AS storage,
  'https://api.host' || p_partkey % 3 || '/v1' AS api_base, CASE WHEN p_partkey % 5 <> 3 THEN 'cat' END AS cat, CASE WHEN p_partkey % 7 <> 3 THEN 'db' || p_partkey % 4 END AS db, 's' || p_partkey % 3 AS sch, CASE WHEN p_partkey % 10 <> 9 THEN 't' || p_partkey % 40 END AS tab,
  CASE WHEN p_partkey % 3 <> 1 THEN 's3://Bucket/x/' || p_partkey % 50 END AS path, CASE WHEN p_partkey % 4 = 2 THEN 'POST ' ELSE 'GET ' END AS verb, CASE WHEN p_partkey % 18 <> 2 THEN '/v1/' END AS routed FROM part),
 ei AS (SELECT *, (ctype = 'database' OR dtype <> '') AS is_db, CASE WHEN explicit <> '' THEN explicit WHEN ctype = 'database' OR dtype <> '' THEN COALESCE(NULLIF(dtype, ''), 'database') || ':' || host || port WHEN ctype = 'api' THEN api_base
   WHEN workspace <> '' THEN workspace WHEN storage <> '' THEN storage WHEN cat IS NOT NULL OR db IS NOT NULL THEN 'catalog:' || COALESCE(cat, '_') || ':' || COALESCE(db, '_') ELSE '' END AS instance FROM ep),
 ek AS (SELECT *, CASE WHEN is_db THEN concat_ws('|', COALESCE(NULLIF(LOWER(instance), ''), 'database'), 'catalog:' || cat, 'database:' || db) ELSE NULLIF(LOWER(instance), '') END AS scope,
   CASE WHEN ctype <> 'api' AND tab IS NOT NULL THEN CASE WHEN instance <> '' THEN instance || '|' ELSE '' END || concat_ws('.', cat, db, sch, tab) END AS logical_table,
   CASE WHEN ctype = 'api' THEN api_base || '|' || verb || CASE WHEN routed IS NULL THEN api_base || '?x=1' ELSE api_base || '?x=1/orders//' || k % 20 || '/' END END AS api_endpoint FROM ei)"""


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table, as all that follows reads it more than once."""
    return settled(R.endpoint_keys(endpoints(spark, sf_dir)))


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registries of environments of 50 endpoints each."""
    return R.register_assets(keys(spark, sf_dir))


#: Nodes one by one: who owns each identifier, and which value an asset has of each kind.
REGISTER = ENDPOINTS + r""", ids AS (SELECT k // 50 AS environment, k, row_number() OVER (PARTITION BY k // 50 ORDER BY k) AS i, list_filter([{'kind': 'api_endpoint', 'value': api_endpoint}, {'kind': 'logical_table', 'value': logical_table}, {'kind': 'physical_path', 'value': path}], lambda x: x.value IS NOT NULL) AS own FROM ek),
 walk AS (SELECT environment, 0::BIGINT AS i, MAP {}::MAP(VARCHAR, BIGINT) AS owner, MAP {}::MAP(VARCHAR, VARCHAR) AS held, NULL::BIGINT AS asset, NULL::VARCHAR AS reason, []::BIGINT[] AS met FROM (SELECT DISTINCT environment FROM ids)
  UNION ALL SELECT n.environment, n.i, CASE WHEN n.reason IS NULL AND len(own) > 0 THEN map_concat(owner, map_from_entries(list_transform(own, lambda x: {'k': x.kind || '=' || x.value, 'v': n.asset}))) ELSE owner END,
   CASE WHEN n.reason IS NULL AND len(own) > 0 THEN map_concat(held, map_from_entries(list_transform(own, lambda x: {'k': n.asset || '=' || x.kind, 'v': x.value}))) ELSE held END, n.asset, n.reason, n.met
  FROM (SELECT s.*, CASE WHEN len(s.met) = 1 THEN s.met[1] ELSE k END AS asset,
     CASE WHEN len(s.met) > 1 THEN 'identifiers resolve to different assets' WHEN len(s.met) = 1 AND len(list_filter(own, lambda x: held[s.met[1] || '=' || x.kind] <> x.value)) > 0 THEN 'asset identifiers conflict' END AS reason
    FROM (SELECT ids.*, owner, held, list_sort(list_distinct(list_filter(list_transform(own, lambda x: owner[x.kind || '=' || x.value]), lambda g: g IS NOT NULL))) AS met FROM walk JOIN ids ON ids.environment = walk.environment AND ids.i = walk.i + 1) s) n),
 nm AS (SELECT environment, k, i, own[1].kind AS pk, own[1].value AS pv FROM ids),
 cd AS (SELECT w.environment, w.i, list_sort(list('asset:' || sha1(w.environment || ':' || x.pk || ':' || x.pv)[1:20])) AS candidates FROM (SELECT environment, i, unnest(met) AS g FROM walk WHERE reason IS NOT NULL) w JOIN nm x ON x.k = w.g GROUP BY 1, 2),
 rg AS (SELECT n.environment, n.k AS node, CASE WHEN reason IS NULL AND n.pk IS NOT NULL THEN 'asset:' || sha1(n.environment || ':' || f.pk || ':' || f.pv)[1:20] ELSE 'asset:' || sha1(n.environment || ':' || COALESCE(n.pk, 'unresolved') || ':conflict:' || n.k || ':' || COALESCE(n.pv, ''))[1:20] END AS asset,
   reason IS NOT NULL AS conflict, reason, COALESCE(cd.candidates, []) AS candidates FROM walk w JOIN nm n USING (environment, i) LEFT JOIN nm f ON f.k = w.asset LEFT JOIN cd USING (environment, i))"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference for each part, made by the endpoint of another: tables by bare, qualified and full names, paths, APIs and expressions."""
    K = F.col("p_partkey")  # noqa: N806
    kind = F.when(K % 8 < 5, "table").when(K % 8 == 5, "path").when(K % 8 == 6, "api").otherwise("expression")
    table = F.when(K % 8 < 5, F.concat(F.lit(" T"), (K % 43).cast("string")))
    part = {
        "value": F.when(K % 8 == 5, text("s3a://Bucket//x/", K % 60, "//")).when(K % 8 == 6, text(" get HTTPS://Api.Host", K % 3, "/v1/?x=1")).when(K % 8 == 7, text("load(  Path", K % 9, ")")).otherwise(F.concat(F.lit("s"), (K % 3).cast("string"), F.lit(".t"), (K % 43).cast("string"))),
        "catalog": F.when(K % 8 == 4, "CAT"), "database": F.when(K % 8 == 4, text("Db", K % 4)), "schema_name": F.when(K % 8 > 1, text("S", K % 3)), "table": table, "api_method": F.lit(None).cast("string"),
    }
    own = endpoints(spark, sf_dir)
    refs = spark.read.parquet(f"{sf_dir}/part.parquet").select(K.alias("reference"), (K - 1 - (K - 1) % 3).alias("node"), kind.alias("kind"), *[c.alias(n) for n, c in part.items()])
    told = own.select("node", *[F.col(c).alias(f"context_{c}") for c in R.ENDPOINT])
    return settled(R.reference_identity(refs.join(told, "node", "left")))


REFERENCES = r"""rf AS (SELECT p.p_partkey AS reference, p.p_partkey - 1 - (p.p_partkey - 1) % 3 AS node, CASE WHEN p.p_partkey % 8 < 5 THEN 'table_reference' WHEN p.p_partkey % 8 = 5 THEN 'path_reference' WHEN p.p_partkey % 8 = 6 THEN 'api_endpoint_reference' ELSE 'unknown' END AS reference_type,
   CASE WHEN p.p_partkey % 8 < 5 THEN concat_ws('.', CASE WHEN p.p_partkey % 8 = 4 THEN 'cat.db' || p.p_partkey % 4 END, CASE WHEN p.p_partkey % 8 > 1 THEN 's' || p.p_partkey % 3 END, 't' || p.p_partkey % 43) WHEN p.p_partkey % 8 = 5 THEN 's3://Bucket/x/' || p.p_partkey % 60
     WHEN p.p_partkey % 8 = 6 THEN 'GET https://api.host' || p.p_partkey % 3 || '/v1?x=1' ELSE 'load( path' || p.p_partkey % 9 || ')' END AS normalized_value,
   CASE WHEN p.p_partkey % 8 = 4 THEN 'fully_qualified' WHEN p.p_partkey % 8 IN (2, 3) THEN 'schema_table' ELSE 'table' END AS qualification_level FROM part p),
 ri AS (SELECT r.*, 'reference:' || sha1('{"normalized_value": "' || normalized_value || '", "reference_type": "' || reference_type || '"}')[1:20] AS reference_id,
   CASE reference_type WHEN 'table_reference' THEN ek.scope WHEN 'path_reference' THEN 's3://bucket' WHEN 'api_endpoint_reference' THEN 'https://api.host' || reference % 3 END AS context_scope,
   CASE WHEN reference_type IN ('path_reference', 'api_endpoint_reference') THEN 'physical_exact' WHEN reference_type = 'unknown' THEN 'weak_logical' WHEN ek.is_db THEN 'connection_bound' WHEN qualification_level <> 'table' THEN 'qualified_logical' ELSE 'weak_logical' END AS addressing_mode FROM rf r LEFT JOIN ek ON ek.k = r.node)"""


def assets_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered nodes as if each identifier named one asset: that of the first node that has it."""
    own = keys(spark, sf_dir)
    first = own.withColumn("id", F.coalesce(*R.KINDS)).filter("id is not null").groupBy("id").agg(F.min("node").alias("first"))
    named = own.withColumn("id", F.coalesce(*R.KINDS)).join(first, "id")
    return named.select("node", R.digest("asset", "1", F.col("id")).alias("asset"), F.lit(False).alias("conflict"))


def index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tables by logical name only, paths only of endpoints without a table: so that each identifier has one asset."""
    k = keys(spark, sf_dir)
    identifiers, scopes = R.identifier_index(k, assets_by_name(spark, sf_dir))
    first = identifiers.groupBy("kind", "value").agg(F.min("asset").alias("asset"))
    return settled(first), settled(scopes)


INDEX = r"""an AS (SELECT k, 'asset:' || sha1('1:' || COALESCE(api_endpoint, logical_table, path))[1:20] AS asset, scope, api_endpoint, logical_table, path FROM ek WHERE COALESCE(api_endpoint, logical_table, path) IS NOT NULL),
 ix AS (SELECT kind, value, MIN(asset) AS asset FROM (SELECT 'api_endpoint' AS kind, api_endpoint AS value, asset FROM an UNION ALL SELECT 'logical_table', logical_table, asset FROM an UNION ALL SELECT 'physical_path', path, asset FROM an) WHERE value IS NOT NULL GROUP BY 1, 2),
 sc AS (SELECT DISTINCT asset, scope FROM an WHERE scope IS NOT NULL),
 tb AS (SELECT DISTINCT asset, regexp_replace(value, '^[^|]*\|', '') AS name FROM ix WHERE kind = 'logical_table'),
 hit AS (SELECT DISTINCT r.reference, t.asset, r.context_scope IS NULL OR s.asset IS NOT NULL AS inside FROM ri r JOIN tb t ON r.reference_type = 'table_reference' AND (t.name = r.normalized_value OR (r.qualification_level <> 'fully_qualified' AND ends_with(t.name, '.' || r.normalized_value))) LEFT JOIN sc s ON s.asset = t.asset AND s.scope = r.context_scope),
 hn AS (SELECT reference, COUNT(*) AS n, COUNT(*) FILTER (inside) AS m, list_sort(list(asset))[1:20] AS every, list_sort(list(asset) FILTER (inside))[1:20] AS own FROM hit GROUP BY 1),
 rs AS (SELECT r.*, COALESCE(n, 0) AS n, COALESCE(m, 0) AS m, every, own, x.asset AS path_asset,
   CASE WHEN x.asset IS NOT NULL THEN 'exact_identifier' WHEN m = 1 THEN 'connection_scoped_table' WHEN m > 1 THEN 'multiple_connection_table_matches'
     WHEN n = 1 AND (addressing_mode = 'qualified_logical' OR qualification_level = 'fully_qualified') THEN 'qualified_cross_connection'
     WHEN n > 1 AND context_scope IS NOT NULL AND addressing_mode IN ('connection_bound', 'weak_logical') THEN 'out_of_scope_table_candidates' WHEN n > 1 THEN 'multiple_table_suffix_matches' WHEN n = 1 THEN 'out_of_scope_table_candidate' ELSE 'no_declared_asset_match' END AS method
   FROM ri r LEFT JOIN hn USING (reference) LEFT JOIN ix x ON r.reference_type = 'path_reference' AND x.kind = 'physical_path' AND x.value = r.normalized_value),
 rv AS (SELECT *, CASE WHEN method IN ('exact_identifier', 'connection_scoped_table', 'qualified_cross_connection') THEN 'automatic' ELSE 'unresolved' END AS state,
   CASE WHEN method LIKE 'multiple%' THEN 'multiple_matches' WHEN method LIKE 'out%' THEN 'out_of_scope' WHEN method LIKE 'no_%' THEN 'no_match' END AS reason,
   CASE method WHEN 'exact_identifier' THEN path_asset WHEN 'connection_scoped_table' THEN own[1] WHEN 'qualified_cross_connection' THEN every[1] END AS asset,
   CASE WHEN path_asset IS NOT NULL THEN [path_asset] WHEN m > 0 THEN own WHEN n > 0 THEN every ELSE [] END AS candidates, CASE WHEN path_asset IS NOT NULL THEN 1 WHEN m > 0 THEN m ELSE n END AS candidate_count FROM rs)"""

RESOLVED = ["reference", "state", "reason", "asset", "method", "candidate_count"]


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve(references(spark, sf_dir), *index(spark, sf_dir))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual mappings of tables and APIs to paths, some to paths that aren't there, some twice."""
    K = F.col("p_partkey")  # noqa: N806
    row = lambda n, kind, value, target: spark.read.parquet(f"{sf_dir}/part.parquet").filter(n).select(K.alias("mapping"), F.lit(kind).alias("reference_type"), value.alias("reference_value"), F.lit("physical_path").alias("target_kind"), target.alias("target_value"))
    path = text("s3://Bucket/x/", K % 70)
    tables = row("p_partkey <= 12", "table_reference", F.concat(F.lit("s"), (K % 3).cast("string"), F.lit(".t"), (K % 43).cast("string")), path)
    again = row("p_partkey in (4, 5)", "table_reference", F.concat(F.lit("s"), (K % 3).cast("string"), F.lit(".t"), (K % 43).cast("string")), path)
    return tables.unionByName(again).unionByName(row("p_partkey in (61, 64)", "api_endpoint_reference", text("GET https://api.host", K % 3, "/v1?x=1"), path))


MAPPINGS = r"""mg AS (SELECT p_partkey AS mapping, 'table_reference' AS t, 's' || p_partkey % 3 || '.t' || p_partkey % 43 AS v, 's3://Bucket/x/' || p_partkey % 70 AS target FROM part WHERE p_partkey <= 12
   UNION ALL SELECT p_partkey, 'table_reference', 's' || p_partkey % 3 || '.t' || p_partkey % 43, 's3://Bucket/x/' || p_partkey % 70 FROM part WHERE p_partkey IN (4, 5)
   UNION ALL SELECT p_partkey, 'api_endpoint_reference', 'GET https://api.host' || p_partkey % 3 || '/v1?x=1', 's3://Bucket/x/' || p_partkey % 70 FROM part WHERE p_partkey IN (61, 64)),
 mq AS (SELECT t, v, COUNT(*) AS fits, MIN(mapping) AS mapping, arg_min(target, mapping) AS target FROM mg GROUP BY 1, 2),
 ms AS (SELECT rv.*, mq.mapping, x.asset AS aim, CASE WHEN fits > 1 THEN 'ambiguous' WHEN x.asset IS NOT NULL THEN 'applied' WHEN fits = 1 THEN 'target_missing' END AS status FROM rv LEFT JOIN mq ON t = reference_type AND v = normalized_value LEFT JOIN ix x ON x.kind = 'physical_path' AND x.value = mq.target),
 mv AS (SELECT reference, CASE status WHEN 'applied' THEN 'manual' WHEN 'target_missing' THEN 'unresolved' ELSE state END AS state, CASE status WHEN 'applied' THEN NULL WHEN 'target_missing' THEN 'target_missing' ELSE reason END AS reason, CASE status WHEN 'applied' THEN aim WHEN 'target_missing' THEN NULL ELSE asset END AS asset,
   CASE status WHEN 'applied' THEN 'manual_mapping' WHEN 'target_missing' THEN 'manual_target_missing' WHEN 'ambiguous' THEN 'manual_mapping_ambiguous' ELSE method END AS method, CASE WHEN status = 'applied' THEN 1 ELSE candidate_count END AS candidate_count, CASE WHEN status IN ('applied', 'target_missing') THEN mapping END AS mapping, status AS mapping_status FROM ms)"""


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.map_references(resolved(spark, sf_dir), mappings(spark, sf_dir), index(spark, sf_dir)[0])


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    instance, scope = R.connection_scope()
    return endpoints(spark, sf_dir).select("node", instance.alias("instance"), F.nullif(scope, F.lit("")).alias("scope"))


def graph_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of the endpoints, of four types, with what views are filtered by."""
    own = assets_by_name(spark, sf_dir).groupBy("asset").agg(F.min("node").alias("n"), F.count_distinct(F.col("node") % 3).alias("sources"))
    kind = F.element_at(F.array(*map(F.lit, ("sql_query", "python_function", "table", "path"))), (F.col("n") % 4 + 1).cast("int"))
    return own.select("asset", kind.alias("asset_type"), "sources", text("conn-", F.col("n") % 9).alias("connection_name"), F.when(F.col("n") % 2 == 0, "delta").alias("format"), F.when(F.col("n") % 3 == 0, "table").otherwise("file").alias("endpoint_kind"), F.when(F.col("n") % 5 == 0, "discovered_only").otherwise("declared").alias("declaration_status"))


def graph_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataflow from each endpoint to the next, some to one that isn't there, and some ids of two."""
    K = F.col("p_partkey")  # noqa: N806
    own = settled(assets_by_name(spark, sf_dir).select("node", "asset"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(K.alias("position"))
    n = F.col("position")
    ends = part.join(own.select(F.col("node").alias("position"), F.col("asset").alias("source")), "position", "left").join(own.select((F.col("node") - 1).alias("position"), F.col("asset").alias("target")), "position", "left")
    gone = lambda c: F.coalesce(c, F.lit("asset:none"))
    return ends.select("position", (n % 3).alias("source_id"), text("f", n - F.when(n % 9 == 4, 1).otherwise(0)).alias("dataflow_id"), text("flow ", n).alias("name"), gone("source").alias("source"), gone("target").alias("target"), F.when(n % 3 == 0, "silver").when(n % 3 == 1, "bronze").alias("stage"))


def graph_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolved references of the dataflows, each fourth of them seen twice."""
    n = F.col("reference")
    own = settled(mapped(spark, sf_dir).withColumns({"dataflow": n, "provenance": F.when(n % 3 == 0, "sql").when(n % 3 == 1, "python_sql").otherwise("python_ast"), "location": F.when(n % 2 == 0, F.lit('{"line": 1}'))}))
    return own.unionByName(own.filter(n % 4 == 0).withColumn("reference", n + 100_000_000))


def graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The typed graph, published for the session like the facts, anew if the parts' files change."""
    return kept(spark, "typed graph", f"{sf_dir}/part.parquet", lambda: G.build(settled(graph_assets(spark, sf_dir)), graph_flows(spark, sf_dir), graph_evidence(spark, sf_dir)))


GRAPH = r"""ga AS (SELECT asset, ['sql_query', 'python_function', 'table', 'path'][MIN(k) % 4 + 1] AS asset_type, COUNT(DISTINCT k % 3) AS sources, 'conn-' || MIN(k) % 9 AS connection_name, CASE WHEN MIN(k) % 2 = 0 THEN 'delta' END AS format, CASE WHEN MIN(k) % 3 = 0 THEN 'table' ELSE 'file' END AS endpoint_kind, CASE WHEN MIN(k) % 5 = 0 THEN 'discovered_only' ELSE 'declared' END AS declaration_status FROM an GROUP BY 1),
 gf0 AS (SELECT p.p_partkey AS position, p.p_partkey % 3 AS source_id, 'f' || p.p_partkey - CASE WHEN p.p_partkey % 9 = 4 THEN 1 ELSE 0 END AS dataflow_id, COALESCE(a.asset, 'asset:none') AS source, COALESCE(b.asset, 'asset:none') AS target, ['silver', 'bronze', NULL::VARCHAR][p.p_partkey % 3 + 1] AS stage FROM part p LEFT JOIN an a ON a.k = p.p_partkey LEFT JOIN an b ON b.k = p.p_partkey + 1),
 gf AS (SELECT *, 'dataflow:' || sha1(source_id || ':' || dataflow_id || ':' || source || ':' || target || ':occurrence:' || row_number() OVER (PARTITION BY source_id, dataflow_id, source, target ORDER BY position) - 1)[1:20] AS id FROM gf0),
 ge0 AS (SELECT mv.*, ri.reference_type, ri.normalized_value, ri.reference_id, ri.context_scope, ri.addressing_mode, ri.qualification_level, gf.source AS reader, gf.dataflow_id, COALESCE(mv.asset = gf.source, false) AS self, CASE reference % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'python_sql' ELSE 'python' END AS provenance, CASE WHEN reference % 2 = 0 THEN '{"line": 1}' ELSE '' END AS location,
   CASE WHEN reference % 8 < 5 THEN 's' || reference % 3 || '.t' || reference % 43 WHEN reference % 8 = 5 THEN 's3a://bucket//x/' || reference % 60 || '//' WHEN reference % 8 = 6 THEN 'get https://api.host' || reference % 3 || '/v1/?x=1' ELSE 'load(  path' || reference % 9 || ')' END AS raw,
   CASE WHEN reference % 8 = 4 THEN 'cat|db' || reference % 4 || '|s' || reference % 3 WHEN reference % 8 > 1 THEN '||s' || reference % 3 ELSE '||' END AS place FROM mv JOIN ri USING (reference) JOIN gf ON gf.position = reference),
 ge1 AS (SELECT * REPLACE (CASE WHEN self THEN 'unresolved' ELSE state END AS state, CASE WHEN self THEN 'no_match' ELSE reason END AS reason, CASE WHEN self THEN 'self_reference_rejected' ELSE method END AS method, CASE WHEN NOT self THEN asset END AS asset),
   'reference-occurrence:' || sha1(CASE WHEN reference_type = 'unknown' THEN reference_id || ':' || reader || ':' || provenance || ':' || raw ELSE concat_ws(':', reader, reference_id, provenance, raw, place, location, COALESCE(context_scope, ''), CASE WHEN context_scope IS NULL THEN '' WHEN reference_type = 'table_reference' THEN 'metadata_context' ELSE 'detected' END, addressing_mode, qualification_level) END)[1:20] AS occurrence_id,
   list_position(['target_missing', 'conflicting_targets', 'multiple_matches', 'out_of_scope', 'incomplete', 'no_match'], COALESCE(CASE WHEN self THEN 'no_match' ELSE reason END, 'incomplete')) AS rank FROM ge0),
 ge AS (SELECT * FROM ge1 UNION ALL SELECT * REPLACE (reference + 100000000 AS reference) FROM ge1 WHERE reference % 4 = 0),
 go AS (SELECT occurrence_id, arg_min(reference_id, reference) AS reference_id, arg_min(reference_type, reference) AS reference_type, arg_min(normalized_value, reference) AS normalized_value, arg_min(provenance, reference) AS provenance, arg_min(reader, reference) AS reader, arg_min(method, reference) AS method, CASE WHEN BOOL_OR(state = 'unresolved') THEN 'unresolved' WHEN BOOL_OR(state = 'manual') THEN 'manual' ELSE 'automatic' END AS state,
   arg_min(reason, rank) FILTER (state = 'unresolved') AS reason, arg_min(asset, reference) FILTER (asset IS NOT NULL) AS asset, arg_max(asset, reference) FILTER (asset IS NOT NULL) AS latest, COUNT(*) AS seen FROM ge GROUP BY 1),
 gd0 AS (SELECT 'dependency:' || sha1('reference:' || occurrence_id || ':' || reader || ':reads')[1:20] AS id, COALESCE(latest, reference_id) AS source, reader AS target, provenance, state, reason, method, reference_id, occurrence_id, latest AS asset FROM go),
 gb AS (SELECT 'dangling_dataflow' AS code, 'error' AS severity, id AS subject FROM gf WHERE source NOT IN (SELECT asset FROM ga) OR target NOT IN (SELECT asset FROM ga)
   UNION ALL SELECT CASE WHEN t.asset IS NULL OR (d.asset IS NOT NULL AND o.asset IS NULL) THEN 'dangling_dependency' ELSE 'invalid_dependency_target' END, 'error', id FROM gd0 d LEFT JOIN ga t ON t.asset = d.target LEFT JOIN ga o ON o.asset = d.asset WHERE t.asset IS NULL OR (d.asset IS NOT NULL AND o.asset IS NULL) OR t.asset_type NOT IN ('sql_query', 'python_function')),
 gd AS (SELECT * FROM gd0 WHERE id NOT IN (SELECT subject FROM gb)), gv AS (SELECT * FROM gf WHERE id NOT IN (SELECT subject FROM gb)),
 gx AS (SELECT * FROM gb UNION ALL SELECT 'dependency_' || reason, CASE WHEN reason IN ('multiple_matches', 'target_missing') THEN 'warning' ELSE 'info' END, occurrence_id FROM ge WHERE asset IS NULL AND reference_type <> 'unknown'
   UNION ALL SELECT 'dependency_self_reference', 'warning', occurrence_id FROM ge WHERE self UNION ALL SELECT 'dataflow_identity_conflict', 'warning', dataflow_id FROM gf GROUP BY dataflow_id HAVING COUNT(DISTINCT source || ' ' || target) > 1),
 gs AS (SELECT reference_id, COUNT(*) AS n, CASE WHEN COUNT(DISTINCT asset) <> 1 OR BOOL_OR(state = 'unresolved') THEN 'unresolved' WHEN BOOL_OR(state = 'manual') THEN 'manual' ELSE 'automatic' END AS state,
   CASE WHEN COUNT(DISTINCT asset) > 1 THEN 'conflicting_targets' WHEN BOOL_OR(state = 'unresolved') THEN arg_min(reason, list_position(['target_missing', 'conflicting_targets', 'multiple_matches', 'out_of_scope', 'incomplete', 'no_match'], reason)) FILTER (state = 'unresolved') END AS reason, CASE WHEN COUNT(DISTINCT asset) = 1 THEN MIN(asset) END AS asset FROM gd GROUP BY 1),
 gr AS (SELECT o.reference_id, MIN(reference_type) AS reference_type, MIN(normalized_value) AS normalized_value, COUNT(*) AS occurrence_count, COUNT(DISTINCT reader) AS consumer_count, COALESCE(ANY_VALUE(n), 0) AS dependency_count, array_to_string(list_sort(list_distinct(list(provenance))), ',') AS provenances, COALESCE(ANY_VALUE(gs.state), 'unresolved') AS state, CASE WHEN ANY_VALUE(gs.state) IS NULL THEN 'no_match' ELSE ANY_VALUE(gs.reason) END AS reason, ANY_VALUE(gs.asset) AS asset FROM go o LEFT JOIN gs USING (reference_id) GROUP BY 1),
 ge2 AS (SELECT id, source, target, 'dataflow' AS type, stage, NULL::VARCHAR AS asset, NULL::VARCHAR AS state FROM gv UNION ALL SELECT id, source, target, 'dependency', NULL::VARCHAR, asset, state FROM gd)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return settled(G.relations(g["dataflows"], g["dependencies"]))


def view(spark: SparkSession, sf_dir: str, direction: str, filters: dict[str, list[str]] | None = None, focus: str | None = None) -> DataFrame:
    """What shows from the first assets that have a certain stage's dataflows, each a view of its own, or of the whole graph."""
    edges, assets = relations(spark, sf_dir), settled(graph_assets(spark, sf_dir))
    seeds = None
    if focus == "asset":
        seeds = assets.filter("connection_name = 'conn-3'").select(F.col("asset").alias("label"), F.lit("asset").alias("kind"), F.col("asset").alias("focus"))
    elif focus:
        seeds = edges.filter((F.col("type") == focus) & F.col("id").like("%:a%")).select(F.lit("all").alias("label"), F.lit(focus).alias("kind"), F.col("id").alias("focus"))
    return G.visible(edges, assets, seeds, direction, filters)


def view_sql(direction: str, test: str = "", seeds: str = "", shown: bool = False) -> str:
    """A walk by nodes within labels, twice where relations are filtered."""
    open_ = "ge2" if shown else "(SELECT * FROM ge2 WHERE type = 'dataflow' OR asset IS NOT NULL)"
    ways = [(a, b) for a, b, d in (("target", "source", "upstream"), ("source", "target", "downstream")) if direction in (d, "both")]

    def walk(name: str, at: str, rel: str) -> str:
        """Relations on the ways from the starts (label, up, down) at `at`, over rel (label or null, id, source, target)."""
        parts = [f"{name}{i} AS (SELECT label, {'up' if here == 'target' else 'down'} AS node FROM {at} UNION SELECT w.label, r.{there} FROM {name}{i} w JOIN {rel} r ON r.{here} = w.node AND (r.label IS NULL OR r.label = w.label))" for i, (here, there) in enumerate(ways)]
        found = " UNION ".join(f"SELECT w.label, r.id FROM {name}{i} w JOIN {rel} r ON r.{here} = w.node AND (r.label IS NULL OR r.label = w.label)" for i, (here, _) in enumerate(ways))
        return ", ".join([*parts, f"{name} AS ({found})"])

    ctes = [f"op AS (SELECT NULL::VARCHAR AS label, * FROM {open_})"]
    if seeds:
        ctes += [f"st AS ({seeds})", walk("wk", "st", "op"), "scp AS (SELECT * FROM wk UNION SELECT label, id FROM st WHERE id IS NOT NULL)"]
    else:
        ctes.append("scp AS (SELECT '0' AS label, id FROM op)")
    if test:
        ctes += [f"sd AS (SELECT s.label, r.id, r.source AS up, r.target AS down FROM scp s JOIN op r USING (id) LEFT JOIN ga a ON a.asset = r.source LEFT JOIN ga b ON b.asset = r.target WHERE {test})", "ins AS (SELECT s.label, r.id, r.source, r.target FROM scp s JOIN op r USING (id))", walk("wz", "sd", "ins"), "fin AS (SELECT * FROM wz UNION SELECT label, id FROM sd)"]
    last = "fin" if test else "scp"
    return f"WITH RECURSIVE {ENDPOINTS}, {REFERENCES}, {INDEX}, {MAPPINGS}, {GRAPH}, {', '.join(ctes)} SELECT DISTINCT label, id FROM {last}"


ON_ASSETS = "SELECT asset AS label, asset AS up, asset AS down, NULL AS id FROM ga WHERE connection_name = 'conn-3'"
ON_RELATIONS = "SELECT 'all' AS label, source AS up, target AS down, id FROM ge2 WHERE type = '{}' AND id LIKE '%:a%'"


def typed(columns: str, table: str) -> str:
    return f"WITH {ENDPOINTS}, {REFERENCES}, {INDEX}, {MAPPINGS}, {GRAPH} SELECT {columns} FROM {table}"


FLOW = "id, position, source_id, dataflow_id, source, target, stage"
OCCURRENCE = "occurrence_id, reference_id, reference_type, normalized_value, provenance, reader, method, state, reason, asset, seen"
DEPENDENCY = "id, source, target, provenance, state, reason, method, reference_id, occurrence_id, asset"
REFERENCE = "reference_id, reference_type, normalized_value, occurrence_count, consumer_count, dependency_count, provenances, state, reason, asset"
COUNTS = ", ".join(["(SELECT COUNT(*) FROM ga) AS assets, (SELECT COUNT(*) FROM ga WHERE sources > 1) AS stitched_assets, (SELECT COUNT(*) FROM gr) AS references, (SELECT COUNT(*) FROM gv) AS dataflows, (SELECT COUNT(*) FROM gd) AS dependencies, (SELECT COUNT(*) FROM gx) AS diagnostics", *[f"(SELECT COUNT(*) FROM {t} WHERE state = '{x}') AS {x}_{n}" for t, n in (("gr", "references"), ("gd", "dependencies")) for x in ("automatic", "manual", "unresolved")]])
IDENTITY = ["reference", "reference_type", "normalized_value", "reference_id", "context_scope", "addressing_mode", "qualification_level"]
listed = lambda c: F.array_join(c, ",")

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "l06_resolution_scope": (instances, f"WITH {ENDPOINTS} SELECT k AS node, instance, scope FROM ek"),
    "l05_endpoint_keys": (lambda s, d: keys(s, d).select("node", "api_endpoint", "logical_table", "physical_path"), f"WITH {ENDPOINTS} SELECT k AS node, api_endpoint, logical_table, path AS physical_path FROM ek"),
    "l09_register_assets": (lambda s, d: registered(s, d).withColumn("candidates", listed("candidates")), f"WITH RECURSIVE {REGISTER} SELECT environment, node, asset, conflict, reason, array_to_string(candidates, ',') AS candidates FROM rg"),
    "l12_reference_identity": (lambda s, d: references(s, d).select(*IDENTITY), f"WITH {ENDPOINTS}, {REFERENCES} SELECT {', '.join(IDENTITY)} FROM ri"),
    "l13_resolution_cascade": (lambda s, d: resolved(s, d).select(*RESOLVED, listed("candidates").alias("candidates")), f"WITH {ENDPOINTS}, {REFERENCES}, {INDEX} SELECT {', '.join(RESOLVED)}, array_to_string(candidates, ',') AS candidates FROM rv"),
    "l14_map_references": (lambda s, d: mapped(s, d).select(*RESOLVED, "mapping", "mapping_status"), f"WITH {ENDPOINTS}, {REFERENCES}, {INDEX}, {MAPPINGS} SELECT {', '.join(RESOLVED)}, mapping, mapping_status FROM mv"),
    "l16_group_resolution": (lambda s, d: R.group_resolution(mapped(s, d), ["reference_id"]), f"WITH {ENDPOINTS}, {REFERENCES}, {INDEX}, {MAPPINGS}, mw AS (SELECT mv.*, ri.reference_id, list_position(['target_missing', 'conflicting_targets', 'multiple_matches', 'out_of_scope', 'incomplete', 'no_match'], COALESCE(mv.reason, 'incomplete')) AS rank FROM mv JOIN ri USING (reference)) SELECT reference_id, COUNT(*) AS occurrences, CASE WHEN COUNT(DISTINCT asset) <> 1 OR BOOL_OR(state = 'unresolved') THEN 'unresolved' WHEN BOOL_OR(state = 'manual') THEN 'manual' ELSE 'automatic' END AS state, CASE WHEN COUNT(DISTINCT asset) > 1 THEN 'conflicting_targets' WHEN BOOL_OR(state = 'unresolved') THEN arg_min(reason, rank) FILTER (state = 'unresolved') END AS reason, CASE WHEN COUNT(DISTINCT asset) = 1 THEN MIN(asset) END AS asset FROM mw GROUP BY 1"),
    "l15_typed_dataflows": (lambda s, d: graph(s, d)["dataflows"].select(*FLOW.split(", ")), typed(FLOW, "gv")),
    "l15_occurrences": (lambda s, d: graph(s, d)["occurrences"].select(*OCCURRENCE.split(", ")), typed(OCCURRENCE, "go")),
    "l15_dependencies": (lambda s, d: graph(s, d)["dependencies"].select(*DEPENDENCY.split(", ")), typed(DEPENDENCY, "gd")),
    "l15_references": (lambda s, d: graph(s, d)["references"].withColumn("provenances", listed("provenances")).select(*REFERENCE.split(", ")), typed(REFERENCE, "gr")),
    "l17_graph_diagnostics": (lambda s, d: graph(s, d)["diagnostics"].select("code", "severity", "subject"), typed("code, severity, subject", "gx")),
    "l18_typed_summary": (lambda s, d: G.summary(graph(s, d), graph_assets(s, d)), typed(COUNTS, "(SELECT 1)")),
    "l19_view_of_assets": (lambda s, d: view(s, d, "downstream", None, "asset"), view_sql("downstream", "", ON_ASSETS, True)),
    "l19_view_of_dataflows": (lambda s, d: view(s, d, "upstream", None, "dataflow"), view_sql("upstream", "", ON_RELATIONS.format("dataflow"), True)),
    "l19_view_of_dependencies": (lambda s, d: view(s, d, "both", None, "dependency"), view_sql("both", "", ON_RELATIONS.format("dependency"), True)),
    "l19_view_by_connection": (lambda s, d: view(s, d, "upstream", {"connections": ["conn-1", "conn-2"]}).withColumn("label", F.col("label").cast("string")), view_sql("upstream", "a.connection_name IN ('conn-1', 'conn-2') OR b.connection_name IN ('conn-1', 'conn-2')")),
    "l19_view_by_stage_and_format": (lambda s, d: view(s, d, "downstream", {"stages": ["silver"], "formats": ["delta", "table"]}).withColumn("label", F.col("label").cast("string")), view_sql("downstream", "r.type = 'dataflow' AND r.stage = 'silver' AND (a.format = 'delta' OR b.format = 'delta' OR a.endpoint_kind = 'table' OR b.endpoint_kind = 'table')")),
    "l19_view_by_resolution": (lambda s, d: view(s, d, "both", {"resolutions": ["unresolved"]}, "asset"), view_sql("both", "r.state = 'unresolved'", ON_ASSETS, True)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda make: lambda spark, sf_dir: rendered(make(spark, sf_dir)))(make) for n, (make, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items() if sql}
