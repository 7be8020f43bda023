"""Registered metadata and lineage queries over a pipeline derived from suppliers and parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import graph
from ..functions.columns import rendered
from ..operators import assets as A
from ..operators import lineage, metadata, temp_views

Tables = dict[str, DataFrame]


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Each supplier is a connection, each part a dataflow from a bronze table of its type to a silver table of its brand."""
    part, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier"))
    n = supplier.agg(F.count(F.lit(1)).alias("n"))  # one row
    text = lambda c: F.col(c).cast("string")
    conns = supplier.select(F.col("s_suppkey").alias("position"), F.concat(F.lit("c"), text("s_suppkey")).alias("connection_id"), F.when(F.col("s_suppkey") % 50 == 0, F.lit("conn-1")).otherwise(F.concat(F.lit("conn-"), text("s_suppkey"))).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "lakehouse").otherwise("database").alias("connection_type"), F.lit("delta").alias("format"), F.lit("cat").alias("catalog"), F.concat(F.lit("db"), (F.col("s_suppkey") % 7).cast("string")).alias("database"), F.concat(F.lit("S3A://Bucket"), (F.col("s_suppkey") % 5).cast("string"), F.lit("//base/")).alias("base_path"), F.when(F.col("s_suppkey") % 40 == 3, "{bad").otherwise('{"a": 1}').alias("configure"), F.col("s_nationkey").alias("nation"))
    kind = F.regexp_replace(F.lower("p_type"), "[^a-z0-9]+", "_")
    brand = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "_")
    flows = part.join(F.broadcast(n)).select(F.col("p_partkey").alias("position"), F.when(F.col("p_partkey") % 60 == 0, F.lit("flow-1")).otherwise(F.concat(F.lit("flow-"), text("p_partkey"))).alias("dataflow_id"), F.when(F.col("p_partkey") % 45 == 7, F.lit(" ")).otherwise(F.concat(F.lit("load "), text("p_partkey"))).alias("name"), F.when(F.col("p_partkey") % 3 == 0, "silver2").when(F.col("p_partkey") % 3 == 1, "bronze10").otherwise("gold").alias("stage"), (F.col("p_partkey") % 4).alias("group_number"), F.concat(F.lit("conn-"), (F.col("p_partkey") % (F.col("n") + 3)).cast("string")).alias("source_connection_name"), F.concat(F.lit("conn-"), (F.col("p_partkey") % 11).cast("string")).alias("destination_connection_name"), F.concat(F.lit("bronze."), kind).alias("source_node"), F.concat(F.lit("silver."), brand).alias("target_node"), kind.alias("source_table"), F.when(F.col("p_partkey") % 33 != 5, brand).alias("destination_table"), F.when(F.col("p_partkey") % 2 == 0, "merge").alias("destination_load_type"), F.col("p_size").alias("size"))
    edges = lineage.build_edges(flows.select(F.col("source_node").alias("source"), F.col("target_node").alias("target")), flows.filter("size % 5 = 0").select(F.col("target_node").alias("source"), F.concat(F.lit("gold.g"), (F.col("size") % 10).cast("string")).alias("target")))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("asset")).distinct()
    assets = nodes.select("asset", F.col("asset").alias("title"), F.lit("table").alias("kind"), F.substring_index("asset", ".", 1).alias("stage"))
    return {"connections": conns, "flows": flows, "edges": edges, "assets": assets}


CTES = r"""WITH cn AS (SELECT s_suppkey AS position, 'c' || s_suppkey AS connection_id, CASE WHEN s_suppkey % 50 = 0 THEN 'conn-1' ELSE 'conn-' || s_suppkey END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'lakehouse' ELSE 'database' END AS connection_type, 'db' || s_suppkey % 7 AS database, s_suppkey % 5 AS bucket, s_suppkey % 40 = 3 AS bad FROM supplier),
 fl AS (SELECT p_partkey AS position, CASE WHEN p_partkey % 60 = 0 THEN 'flow-1' ELSE 'flow-' || p_partkey END AS dataflow_id, CASE WHEN p_partkey % 45 = 7 THEN ' ' ELSE 'load ' || p_partkey END AS name, CASE p_partkey % 3 WHEN 0 THEN 'silver2' WHEN 1 THEN 'bronze10' ELSE 'gold' END AS stage, p_partkey % 4 AS group_number, 'conn-' || p_partkey % ((SELECT COUNT(*) FROM supplier) + 3) AS source_connection_name, 'conn-' || p_partkey % 11 AS destination_connection_name, 'bronze.' || regexp_replace(LOWER(p_type), '[^a-z0-9]+', '_', 'g') AS source_node, 'silver.' || regexp_replace(LOWER(p_brand), '[^a-z0-9]+', '_', 'g') AS target_node, regexp_replace(LOWER(p_type), '[^a-z0-9]+', '_', 'g') AS source_table, CASE WHEN p_partkey % 33 <> 5 THEN regexp_replace(LOWER(p_brand), '[^a-z0-9]+', '_', 'g') END AS destination_table, CASE WHEN p_partkey % 2 = 0 THEN 'merge' END AS load_type, p_size AS size FROM part),
 ed AS (SELECT source, target, kind, COUNT(*) AS occurrences FROM (SELECT source_node AS source, target_node AS target, 'dataflow' AS kind FROM fl UNION ALL SELECT target_node, 'gold.g' || size % 10, 'dependency' FROM fl WHERE size % 5 = 0) WHERE source <> target GROUP BY ALL),
 ast AS (SELECT DISTINCT unnest([source, target]) AS asset FROM ed),
 inv AS (SELECT asset, asset AS title, 'table' AS kind, split_part(asset, '.', 1) AS stage, (SELECT COUNT(DISTINCT source) FROM ed WHERE target = asset) AS upstream, (SELECT COUNT(DISTINCT target) FROM ed WHERE source = asset) AS downstream FROM ast),
 inv2 AS (SELECT *, CASE WHEN upstream > 0 AND downstream > 0 THEN 'transit' WHEN downstream > 0 THEN 'entry' WHEN upstream > 0 THEN 'exit' ELSE 'isolated' END AS position FROM inv)"""


def endpoints(t: Tables) -> DataFrame:
    """Endpoints of connections: a table in its database, the same table by path, and for some an API."""
    c = t["connections"]
    return c.select(F.col("position").alias("node"), F.col("database").alias("instance"), F.col("catalog"), "database", F.lit("s").alias("schema_name"), F.when(F.col("position") % 2 == 0, F.concat(F.lit("T"), (F.col("position") % 20).cast("string"))).alias("table"), F.when(F.col("position") % 3 != 1, F.concat(F.col("base_path"), F.lit("x/"), (F.col("position") % 6).cast("string"))).alias("path"), F.when(F.col("position") % 10 == 5, F.concat(F.lit("HTTPS://Api.Host/v1/"), (F.col("position") % 3).cast("string"), F.lit("/?q=1"))).alias("url"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("query"), F.lit(None).cast("string").alias("python_function"))


IDS = """ids AS (SELECT position AS node, 'logical_table' AS kind, database || '::cat.' || database || '.s.t' || position % 20 AS value FROM cn WHERE position % 2 = 0
 UNION ALL SELECT position, 'physical_path', 's3://Bucket' || bucket || '/base/x/' || position % 6 FROM cn WHERE position % 3 <> 1
 UNION ALL SELECT position, 'api_endpoint', 'GET https://api.host/v1/' || position % 3 FROM cn WHERE position % 10 = 5)"""


def issues(t: Tables) -> DataFrame:
    hints = t["flows"].filter("position % 70 = 9").select(F.concat(F.lit("hint-"), (F.col("position") % 5).cast("string")).alias("connection_name"), F.col("source_table").alias("table_name"))
    return metadata.validate(t["connections"], t["flows"], hints)


ISSUES = """iss AS (SELECT 'duplicate' AS code, 'error' AS severity, 'connection' AS kind, CAST(position AS VARCHAR) AS key, name AS detail FROM cn QUALIFY row_number() OVER (PARTITION BY LOWER(TRIM(name)) ORDER BY position) > 1
 UNION ALL SELECT 'malformed_json', 'error', 'connection', CAST(position AS VARCHAR), name FROM cn WHERE bad
 UNION ALL SELECT 'required', 'error', 'dataflow', CAST(position AS VARCHAR), 'name' FROM fl WHERE TRIM(name) = ''
 UNION ALL (SELECT 'duplicate', 'error', 'dataflow', CAST(position AS VARCHAR), dataflow_id FROM fl QUALIFY row_number() OVER (PARTITION BY LOWER(TRIM(dataflow_id)) ORDER BY position) > 1)
 UNION ALL SELECT 'missing_destination', 'warning', 'dataflow', CAST(position AS VARCHAR), name FROM fl WHERE destination_table IS NULL
 UNION ALL SELECT 'unknown_connection', 'warning', 'schema_hint', source_table, 'hint-' || position % 5 FROM fl WHERE position % 70 = 9
 UNION ALL SELECT 'unknown_connection', 'error', 'dataflow', CAST(position AS VARCHAR), source_connection_name FROM fl WHERE source_connection_name NOT IN (SELECT name FROM cn)
 UNION ALL SELECT 'unknown_connection', 'error', 'dataflow', CAST(position AS VARCHAR), destination_connection_name FROM fl WHERE destination_connection_name NOT IN (SELECT name FROM cn))"""


def references(t: Tables) -> tuple[DataFrame, DataFrame]:
    """References by bare and qualified names, and tables some of which share them."""
    refs = t["flows"].select(F.col("position").alias("reference"), F.when(F.col("position") % 2 == 0, F.concat(F.lit("s.t"), (F.col("position") % 25).cast("string"))).otherwise(F.concat(F.lit("t"), (F.col("position") % 25).cast("string"))).alias("name"), F.concat(F.lit("db"), (F.col("position") % 9).cast("string")).alias("instance"))
    held = t["connections"].filter("position % 2 = 0").select(F.col("position").alias("asset"), F.col("database").alias("instance"), F.concat(F.lit("cat."), F.col("database"), F.lit(".s.t"), (F.col("position") % 20).cast("string")).alias("full_name"))
    return refs, held


RES = """refs AS (SELECT position AS reference, CASE WHEN position % 2 = 0 THEN 's.t' ELSE 't' END || position % 25 AS name, 'db' || position % 9 AS instance FROM fl), held AS (SELECT position AS asset, database AS instance, 'cat.' || database || '.s.t' || position % 20 AS full_name FROM cn WHERE position % 2 = 0),
 rs AS (SELECT reference, COUNT(DISTINCT CASE WHEN h.instance = r.instance THEN asset END) AS i, COUNT(DISTINCT asset) AS n, MIN(CASE WHEN h.instance = r.instance THEN asset END) AS fi, MIN(asset) AS fa FROM refs r LEFT JOIN held h ON h.full_name = r.name OR ends_with(h.full_name, '.' || r.name) GROUP BY 1),
 res AS (SELECT reference, CASE WHEN i = 1 THEN 'resolved' WHEN i > 1 THEN 'ambiguous' WHEN n = 1 THEN 'cross_connection' WHEN n > 1 THEN 'out_of_scope' ELSE 'no_match' END AS status, CASE WHEN i = 1 THEN fi WHEN i = 0 AND n = 1 THEN fa END AS asset FROM rs)"""


def mapped(t: Tables) -> DataFrame:
    refs, held = references(t)
    m = t["flows"].filter("position % 10 = 0").select(F.col("position").alias("reference"), (F.col("position") % 40).alias("target"))
    m = m.unionByName(t["flows"].filter("position % 30 = 0").select(F.col("position").alias("reference"), F.lit(2).cast("long").alias("target")))
    return lineage.apply_mappings(lineage.resolve_references(refs, held), m.withColumn("target", F.col("target").cast("long")), held)


MAP = "mp AS (SELECT position AS reference, position % 40 AS target FROM fl WHERE position % 10 = 0 UNION ALL SELECT position, 2 FROM fl WHERE position % 30 = 0), mm AS (SELECT reference, COUNT(DISTINCT target) AS k, MIN(target) AS target FROM mp GROUP BY 1), mo AS (SELECT r.reference, CASE WHEN k > 1 THEN 'manual_ambiguous' WHEN k = 1 AND h.asset IS NULL THEN 'target_missing' WHEN k = 1 THEN 'manual' ELSE r.status END AS status, CASE WHEN k IS NULL THEN r.asset WHEN k = 1 AND h.asset IS NOT NULL THEN target END AS asset FROM res r LEFT JOIN mm USING (reference) LEFT JOIN held h ON h.asset = mm.target)"


def sql_refs(t: Tables) -> DataFrame:
    n = lambda m: (F.col("position") % m).cast("string")
    text = F.concat(F.lit("WITH x AS (SELECT 1) SELECT * FROM x JOIN Db"), n(3), F.lit('."T'), n(7), F.lit("\" y ON 1=1 -- from nowhere\n /* join z */ WHERE a = 'from q' AND EXISTS (SELECT 1 FROM u"), n(5), F.lit(")"))
    q = t["flows"].select(F.col("position").alias("query_id"), F.when(F.col("position") % 8 == 0, "SELECT 1").otherwise(text).alias("sql"))
    return lineage.sql_table_references(q)


def code_refs(t: Tables) -> DataFrame:
    n = (F.col("position") % 5).cast("string")
    code = F.concat(F.lit("import x\ndef load(spark, p):\n    a = spark.table('db.t"), n, F.lit("')  # spark.table('no')\n    b = spark.read.parquet(p)\ndef run():\n    c = spark.sql(\"SELECT * FROM q\")\n"))
    return lineage.code_references(t["flows"].select(F.col("position").alias("file"), code.alias("code")))


def view_code(t: Tables) -> DataFrame:
    """Two functions: chains of three views, a redefinition in half of the files, a view of its own name, one that isn't defined, and one with a name made at run time."""
    n = F.col("position")
    text = F.concat(
        F.lit("def load(spark, name):\n    spark.read.parquet('/p/"), (n % 5).cast("string"), F.lit("').createOrReplaceTempView('V1')\n    spark.sql('SELECT * FROM v1 JOIN base"), (n % 3).cast("string"),
        F.lit("').createOrReplaceTempView('v2')\n    spark.sql('SELECT 1 FROM v2').createOrReplaceTempView('v3')\n    out = spark.sql('SELECT * FROM v3 JOIN v1 JOIN never')  # FROM v9\n"),
        F.when(n % 2 == 0, "    spark.read.json('/q').createOrReplaceTempView('v1')\n").otherwise("    pass\n"),
        F.lit("    spark.table('v1').createOrReplaceTempView('v1')\n    spark.table('v1')\n    spark.read.csv(name).createOrReplaceTempView(name)\ndef other(spark):\n    spark.table('v1')\n"),
    )
    return t["flows"].select(n.alias("file"), text.alias("code"))


VIEWS = """SELECT position AS file, f AS function, line, r.name, r.kind, r.value, r.views FROM (SELECT position FROM fl) fl, LATERAL (VALUES ('load', 1, '/p/' || position % 5, 'path', '/p/' || position % 5, 0),
 ('load', 2, 'v1', 'path', '/p/' || position % 5, 1), ('load', 2, 'base' || position % 3, 'table', 'base' || position % 3, 0), ('load', 3, 'v2', 'path', '/p/' || position % 5, 2), ('load', 3, 'v2', 'table', 'base' || position % 3, 1),
 ('load', 4, 'v3', 'path', '/p/' || position % 5, 3), ('load', 4, 'v3', 'table', 'base' || position % 3, 2), ('load', 4, 'v1', 'path', '/p/' || position % 5, 1), ('load', 4, 'never', 'table', 'never', 0),
 ('load', 5, CASE WHEN position % 2 = 0 THEN '/q' END, 'path', '/q', 0), ('load', 6, 'v1', 'path', CASE WHEN position % 2 = 0 THEN '/q' ELSE '/p/' || position % 5 END, 1), ('load', 7, 'v1', 'path', CASE WHEN position % 2 = 0 THEN '/q' ELSE '/p/' || position % 5 END, 2),
 ('load', 8, 'dynamic_path', 'dynamic_path', NULL, 0), ('other', 10, 'v1', 'table', 'v1', 0)) r(f, line, name, kind, value, views) WHERE r.name IS NOT NULL"""


def seeds(t: Tables, prefix: str) -> DataFrame:
    return t["assets"].filter(F.col("asset").startswith(prefix)).select(F.col("asset").alias("node"))


def edited(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t["flows"].select(F.concat(F.lit("s"), (F.col("position") % 3).cast("string")).alias("source"), F.col("stage").alias("sheet"), F.col("name").alias("record"))
    after = t["flows"].filter("position % 9 <> 0").select(F.concat(F.lit("s"), (F.col("position") % 3).cast("string")).alias("source"), F.col("stage").alias("sheet"), F.when(F.col("position") % 14 == 0, F.concat("name", F.lit("*"))).otherwise(F.col("name")).alias("record"))
    return rows, after


def registry(t: Tables) -> DataFrame:
    """References resolved in three environments, of which the third lacks some."""
    refs, held = references(t)
    one = lineage.resolve_references(refs, held).withColumnRenamed("reference", "signature")
    parts = [one.withColumn("environment", F.lit(e)) for e in ("dev", "test")] + [one.filter("signature % 3 <> 0").withColumn("environment", F.lit("prod")).withColumn("asset", F.when(F.col("signature") % 4 != 0, F.col("asset")))]
    return lineage.project_registry(parts[0].unionByName(parts[1]).unionByName(parts[2])).select("signature", "environments", "covered", "targets", "status")


def nested(t: Tables) -> DataFrame:
    """Dataflows with both endpoints as structs."""
    end = lambda side, schema: F.struct(F.col(f"{side}_connection_name").alias("connection_name"), F.lit(schema).alias("schema_name"), F.col(f"{side}_table").alias("table")).alias(side)
    return t["flows"].select("position", "dataflow_id", "name", end("source", "s"), end("destination", "d"))


def documents(t: Tables) -> DataFrame:
    """Documents of up to a hundred dataflows, some of them inactive or without id."""
    flows = nested(t).withColumn("document", F.floor(F.col("position") / 100)).withColumn("is_active", F.col("position") % 17 != 4)
    flows = flows.withColumn("dataflow_id", F.when(F.col("position") % 13 == 6, F.lit(" ")).otherwise(F.lpad("dataflow_id", 12, "-")))
    record = F.struct("position", "dataflow_id", "name", "is_active", "source", "destination")
    grouped = flows.groupBy("document").agg(F.transform(F.array_sort(F.collect_list(record)), lambda r: r.dropFields("position")).alias("dataflows"))
    conns = F.array(F.struct(F.lit("c").alias("name")))
    return grouped.withColumns({"connections": conns, "schema_hints": F.array(F.struct(F.lit("c").alias("connection_name")))})


NESTED = "nf AS (SELECT CAST(floor(position / 100.0) AS BIGINT) AS document, row_number() OVER (PARTITION BY floor(position / 100.0) ORDER BY position) - 1 AS position, name, source_table, destination_table, CASE WHEN position % 13 = 6 THEN ' ' ELSE dataflow_id END AS given, position % 17 <> 4 AS active FROM fl)"


def hint_rows(t: Tables) -> DataFrame:
    return t["flows"].select(F.col("source_connection_name").alias("connection_name"), F.lit("s").alias("schema_name"), F.col("source_table").alias("table_name"), (F.col("position") % 12).alias("ordinal_position"), F.concat(F.lit("col"), F.col("position").cast("string")).alias("column_name"))


def instances(t: Tables) -> DataFrame:
    """Connections that are told apart by a name, a host, a storage path, a catalog or a database."""
    n, none = F.col("position"), F.lit(None).cast("string")
    c = t["connections"].withColumns({
        "connection_instance": F.when(n % 6 == 0, F.concat(F.lit(" Main-"), n.cast("string"))), "host": F.when(n % 4 == 1, F.lit("Db.Host")), "port": F.when(n % 8 == 1, F.lit(5432)), "base_url": none,
        "base_path": F.when(n % 9 != 2, F.col("base_path")).otherwise("/mnt/x"), "catalog": F.when(n % 5 != 3, F.col("catalog")), "connection_name": F.col("name"),
    })
    return c.select("position", lineage.connection_instance().alias("instance"))


COUNTS = ["upstream_count", "downstream_count", "input_dataflow_count", "output_dataflow_count", "depends_on_count", "used_by_count", "attention_count"]


def dataflows(t: Tables) -> DataFrame:
    return t["flows"].select(F.col("position").alias("dataflow"), F.col("source_node").alias("source"), F.col("target_node").alias("target"))


def graph_flows(t: Tables) -> DataFrame:
    """Dataflows of which some lead to their own source or to an asset that isn't there."""
    n = F.col("position")
    return t["flows"].select(n.alias("dataflow"), F.col("source_node").alias("source"), F.when(n % 21 == 0, F.col("source_node")).when(n % 22 == 0, F.lit("gone")).otherwise(F.col("target_node")).alias("target"))


def depends(t: Tables) -> DataFrame:
    """Gold assets read silver ones; some references are open."""
    n = F.col("size")
    return t["flows"].filter("size % 5 = 0").select(F.col("position").alias("reference"), F.concat(F.lit("gold.g"), (n % 10).cast("string")).alias("target"), F.when(F.col("position") % 4 != 0, F.col("target_node")).alias("resolved"))


def catalog_rows(t: Tables) -> DataFrame:
    n = F.col("position")
    own = t["assets"].filter(F.length("asset") % 4 == 0).select("asset", F.lit(None).cast("long").alias("dataflow"), F.lit("warning").alias("severity"), F.lit("identity_conflict").alias("code"))
    flow = t["flows"].filter(n % 31 == 0).select(F.lit(None).cast("string").alias("asset"), n.alias("dataflow"), F.lit("error").alias("severity"), F.lit("dangling").alias("code"))
    return A.asset_rows(t["assets"], dataflows(t), depends(t), own.unionByName(flow))


CATALOG = """dp AS (SELECT position AS reference, 'gold.g' || size % 10 AS target, CASE WHEN position % 4 <> 0 THEN target_node END AS resolved FROM fl WHERE size % 5 = 0),
 pp AS (SELECT DISTINCT * FROM (SELECT source_node AS source, target_node AS target FROM fl UNION ALL SELECT resolved, target FROM dp WHERE resolved IS NOT NULL)),
 dg AS (SELECT asset, COUNT(*) AS k FROM (SELECT asset, NULL AS d FROM ast WHERE length(asset) % 4 = 0 UNION ALL SELECT source_node, position FROM fl WHERE position % 31 = 0 UNION ALL SELECT target_node, position FROM fl WHERE position % 31 = 0) GROUP BY 1),
 ar0 AS (SELECT asset, asset AS title, 'table' AS kind, split_part(asset, '.', 1) AS stage, (SELECT COUNT(*) FROM pp WHERE target = asset) AS upstream_count, (SELECT COUNT(*) FROM pp WHERE source = asset) AS downstream_count, (SELECT COUNT(*) FROM fl WHERE target_node = asset) AS input_dataflow_count, (SELECT COUNT(*) FROM fl WHERE source_node = asset) AS output_dataflow_count, (SELECT COUNT(*) FROM dp WHERE target = asset) AS depends_on_count, (SELECT COUNT(*) FROM dp WHERE resolved = asset) AS used_by_count, COALESCE((SELECT k FROM dg WHERE dg.asset = ast.asset), 0) AS attention_count FROM ast),
 ar AS (SELECT *, concat_ws(',', IF(input_dataflow_count > 0, 'destination', NULL), IF(output_dataflow_count > 0, 'source', NULL)) AS roles, CASE WHEN upstream_count > 0 AND downstream_count > 0 THEN 'transit' WHEN downstream_count > 0 THEN 'entry' WHEN upstream_count > 0 THEN 'exit' ELSE 'isolated' END AS position FROM ar0)"""


def reference_rows(t: Tables) -> DataFrame:
    refs, held = references(t)
    n = F.col("reference")
    rows = lineage.resolve_references(refs, held).join(refs.select("reference", F.col("name").alias("display_name")), "reference")
    return rows.select("reference", "display_name", F.lit("table").alias("reference_type"), F.when(n % 2 == 0, F.array(F.lit("sql"))).otherwise(F.array(F.lit("code"))).alias("provenances"), F.col("status").alias("state"), (n % 7).alias("dependency_count"), (n % 3).alias("attention_count"))


def workspace(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A project for each nation of a supplier, an environment for most suppliers, a source for each part, mappings."""
    c, n = t["connections"], F.col("position")
    text = lambda x: x.cast("string")
    projects = c.select(F.col("nation").alias("project")).distinct().withColumn("name", F.concat(F.lit("project-"), text(F.col("project"))))
    envs = c.filter("nation % 5 <> 2").select(n.alias("environment"), F.col("nation").alias("project"), F.concat(F.lit("env-"), F.lpad(text(n), 6, "0")).alias("name"))
    sources = t["flows"].select((n % 40).alias("environment"), F.when(n % 3 == 0, "metadata").when(n % 3 == 1, "logs").otherwise("code").alias("source_kind"), (n % 4 != 0).alias("enabled"), F.when(n % 11 == 0, "error").when(n % 11 == 1, "warning").otherwise("ok").alias("validation"))
    return projects, envs, sources, t["flows"].filter("position % 6 = 0").select((n % 25).alias("project"))


WORK = """pj AS (SELECT DISTINCT s_nationkey AS project, 'project-' || s_nationkey AS name FROM supplier), en AS (SELECT s_suppkey AS environment, s_nationkey AS project, 'env-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS name FROM supplier WHERE s_nationkey % 5 <> 2),
 so AS (SELECT position % 40 AS environment, ['metadata', 'logs', 'code'][position % 3 + 1] AS source_kind, position % 4 <> 0 AS enabled, CASE position % 11 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'ok' END AS validation FROM fl), mp2 AS (SELECT position % 25 AS project FROM fl WHERE position % 6 = 0)"""


QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {
    "l01_normalize_metadata": (lambda t: metadata.normalize(documents(t))[1].select("document", "position", "name", F.col("source.table").alias("source_table"), (F.length("dataflow_id") == 36).alias("made_id")), f"{CTES}, {NESTED} SELECT document, position, COALESCE(NULLIF(TRIM(name), ''), concat_ws('_', source_table, destination_table)) AS name, source_table, TRIM(given) = '' AS made_id FROM nf WHERE active"),
    "l02_resolve_endpoints": (lambda t: metadata.resolve_endpoints(nested(t), t["connections"].withColumn("document", F.col("position") % 5)).select("position", "source_connection_name", "source_database", "source_path", "source_resolved", "destination_path", "destination_resolved"), f"{CTES}, ls AS (SELECT name, database, 'S3A://Bucket' || bucket || '//base' AS base FROM cn QUALIFY row_number() OVER (PARTITION BY name ORDER BY position % 5 DESC, position DESC) = 1) SELECT f.position, source_connection_name, a.database AS source_database, a.base || '/s/' || source_table AS source_path, a.name IS NOT NULL AS source_resolved, CASE WHEN b.name IS NOT NULL THEN concat_ws('/', b.base, 'd', destination_table) END AS destination_path, b.name IS NOT NULL AS destination_resolved FROM fl f LEFT JOIN ls a ON a.name = source_connection_name LEFT JOIN ls b ON b.name = destination_connection_name"),
    "l03_hint_groups": (lambda t: metadata.flatten_hints(metadata.group_hints(hint_rows(t))), f"{CTES} SELECT source_connection_name AS connection_name, 's' AS schema_name, source_table AS table_name, position % 12 AS ordinal_position, 'col' || position AS column_name FROM fl"),
    "l03_hint_order": (lambda t: metadata.group_hints(hint_rows(t)).select("connection_name", "table_name", F.array_join(F.transform("hints", lambda h: h["column_name"]), ",").alias("columns")), f"{CTES} SELECT source_connection_name AS connection_name, source_table AS table_name, string_agg('col' || position, ',' ORDER BY position % 12, 'col' || position) AS columns FROM fl GROUP BY 1, 2"),
    "l04_flatten_round_trip": (lambda t: metadata.flatten(metadata.unflatten(metadata.flatten(nested(t)))).select("position", "source_connection_name", "source_schema_name", "source_table", "destination_connection_name", "destination_table"), f"{CTES} SELECT position, source_connection_name, 's' AS source_schema_name, source_table, destination_connection_name, destination_table FROM fl"),
    "l06_connection_instance": (lambda t: instances(t), f"{CTES} SELECT position, CASE WHEN position % 6 = 0 THEN 'main-' || position WHEN position % 4 = 1 THEN 'db.host' || CASE WHEN position % 8 = 1 THEN ':5432' ELSE '' END WHEN position % 9 <> 2 THEN 'bucket' || bucket WHEN position % 5 <> 3 THEN 'cat' ELSE database END AS instance FROM cn"),
    "l05_asset_identifiers": (lambda t: lineage.asset_identifiers(endpoints(t)).drop("priority"), f"{CTES}, {IDS} SELECT * FROM ids"),
    "l08_asset_identity": (lambda t: lineage.asset_identity(endpoints(t)).withColumn("first_node", F.min("node").over(Window.partitionBy("asset_key"))).drop("asset_key"), f"{CTES}, k AS (SELECT position AS node, CASE WHEN position % 10 = 5 THEN 'api' WHEN position % 2 = 0 THEN 'table' WHEN position % 3 <> 1 THEN 'path' ELSE 'unresolved' END AS kind, database, CASE WHEN position % 10 = 5 THEN 'a' || position % 3 WHEN position % 2 = 0 THEN 't' || position % 20 WHEN position % 3 <> 1 THEN bucket || '/' || position % 6 ELSE 'n' || position END AS v FROM cn) SELECT node, kind, MIN(node) OVER (PARTITION BY kind, database, v) AS first_node FROM k"),
    "l09_stitch_assets": (lambda t: lineage.stitch_assets(lineage.asset_identifiers(endpoints(t))), CTES.replace("WITH", "WITH RECURSIVE", 1) + f", {IDS}, pr AS (SELECT DISTINCT x.node AS a, y.node AS b FROM ids x JOIN ids y USING (kind, value)), rc AS (SELECT node AS root, node FROM (SELECT DISTINCT node FROM ids) UNION SELECT root, b FROM rc JOIN pr ON a = rc.node), gp AS (SELECT node, MIN(root) AS head FROM rc GROUP BY 1), nm AS (SELECT g.node, head, (SELECT MIN(value) FROM ids i WHERE i.node = g.node AND kind = 'logical_table') AS named FROM gp g), ld AS (SELECT *, arg_min(named, node) FILTER (named IS NOT NULL) OVER (PARTITION BY head) AS lead FROM nm) SELECT node, MIN(node) OVER (PARTITION BY head, CASE WHEN named <> lead THEN named END) AS asset, COALESCE(named <> lead, false) AS conflict FROM ld"),
    "l10_sql_references": (sql_refs, f"{CTES} SELECT position AS query_id, CASE WHEN position % 8 = 0 THEN 0 ELSE i END AS position, CASE WHEN position % 8 = 0 THEN NULL WHEN i = 0 THEN 'db' || position % 3 || '.t' || position % 7 ELSE 'u' || position % 5 END AS name, CASE WHEN position % 8 = 0 THEN 0 WHEN i = 0 THEN 2 ELSE 1 END AS qualification, CASE WHEN position % 8 = 0 THEN 'no_table' END AS diagnostic FROM fl, (VALUES (0), (1)) v(i) WHERE position % 8 <> 0 OR i = 0"),
    "l11_code_references": (code_refs, f"{CTES} SELECT position AS file, f AS function, k AS kind, CASE k WHEN 'table' THEN 'db.t' || position % 5 WHEN 'sql' THEN 'SELECT * FROM q' END AS value FROM fl, (VALUES ('load', 'table'), ('load', 'dynamic_path'), ('run', 'sql')) v(f, k)"),
    "l11_temp_views": (lambda t: temp_views.resolve_views(temp_views.view_statements(view_code(t))), f"{CTES} {VIEWS}"),
    "l12_reference_signature": (lambda t: lineage.reference_signature(references(t)[0].select(F.lit("table").alias("reference_type"), F.col("name").alias("value"), F.col("instance").alias("scope"))).groupBy("addressing", "qualification").agg(F.count_distinct("signature").alias("signatures")), f"{CTES}, {RES} SELECT 'qualified_name' AS addressing, length(name) - length(replace(name, '.', '')) + 1 AS qualification, COUNT(DISTINCT name || '|' || instance) AS signatures FROM refs GROUP BY 2"),
    "l13_resolve_references": (lambda t: lineage.resolve_references(*references(t)), f"{CTES}, {RES} SELECT * FROM res"),
    "l14_apply_mappings": (mapped, f"{CTES}, {RES}, {MAP} SELECT * FROM mo"),
    "l15_lineage_edges": (lambda t: t["edges"], f"{CTES} SELECT * FROM ed"),
    "l16_merge_resolution": (lambda t: lineage.merge_resolution(lineage.resolve_references(*references(t)).withColumn("signature", F.col("reference") % 50)).select("signature", "occurrences", F.when(F.col("status").isin("resolved", "conflicting"), F.col("status")).otherwise("unresolved").alias("state")), f"{CTES}, {RES} SELECT reference % 50 AS signature, COUNT(*) AS occurrences, CASE WHEN NOT BOOL_AND(status IN ('resolved','cross_connection')) THEN 'unresolved' WHEN COUNT(DISTINCT asset) > 1 THEN 'conflicting' ELSE 'resolved' END AS state FROM res GROUP BY 1"),
    "l17_diagnostics": (lambda t: lineage.lineage_diagnostics(t["flows"].select(F.col("position").alias("dataflow"), F.col("source_node").alias("source"), F.when(F.col("position") % 21 == 0, F.col("source_node")).when(F.col("position") % 22 == 0, F.lit("gone")).otherwise(F.col("target_node")).alias("target")), t["assets"], t["assets"].select("asset", (F.length("asset") % 5 == 0).alias("conflict"))), f"{CTES} SELECT 'self_reference' AS code, CAST(position AS VARCHAR) AS subject FROM fl WHERE position % 21 = 0 UNION ALL SELECT 'dangling', CAST(position AS VARCHAR) FROM fl WHERE position % 22 = 0 AND position % 21 <> 0 UNION ALL SELECT 'identity_conflict', asset FROM ast WHERE length(asset) % 5 = 0"),
    "l18_lineage_summary": (lambda t: lineage.lineage_summary(lineage.asset_inventory(t["assets"], t["edges"]), t["edges"]), f"{CTES} SELECT COUNT(*) AS assets, COUNT(*) FILTER (position = 'entry') AS entry, COUNT(*) FILTER (position = 'transit') AS transit, COUNT(*) FILTER (position = 'exit') AS exit, COUNT(*) FILTER (position = 'isolated') AS isolated, (SELECT COUNT(*) FROM ed WHERE kind = 'dataflow') AS dataflow_edges, (SELECT COUNT(*) FROM ed WHERE kind = 'dependency') AS dependency_edges FROM inv2"),
    "l19_trace_downstream": (lambda t: graph.trace(t["edges"], seeds(t, "bronze.")), CTES.replace("WITH", "WITH RECURSIVE", 1) + ", wk AS (SELECT asset AS node, 0 AS depth FROM ast WHERE asset LIKE 'bronze.%' UNION SELECT target, depth + 1 FROM wk JOIN ed ON source = node) SELECT node, MIN(depth) AS depth FROM wk GROUP BY 1"),
    "l19_trace_upstream": (lambda t: graph.trace(t["edges"], seeds(t, "gold."), "upstream"), CTES.replace("WITH", "WITH RECURSIVE", 1) + ", wk AS (SELECT asset AS node, 0 AS depth FROM ast WHERE asset LIKE 'gold.%' UNION SELECT source, depth + 1 FROM wk JOIN ed ON target = node) SELECT node, MIN(depth) AS depth FROM wk GROUP BY 1"),
    "l20_relation_filter": (lambda t: lineage.relation_filter(t["edges"], t["assets"], stage=["gold"]), f"{CTES} SELECT * FROM ed WHERE source LIKE 'gold.%' OR target LIKE 'gold.%'"),
    "l21_search": (lambda t: lineage.search(t["assets"], "brand silver").select("asset", "rank"), f"{CTES} SELECT asset, 3 AS rank FROM inv WHERE asset LIKE '%brand%' AND asset LIKE '%silver%' ORDER BY asset LIMIT 8"),
    "l22_asset_inventory": (lambda t: lineage.asset_inventory(t["assets"], t["edges"]), f"{CTES} SELECT * FROM inv2"),
    "l23_asset_detail": (lambda t: lineage.asset_detail(t["edges"]), f"{CTES} SELECT asset, " + ", ".join(f"COALESCE((SELECT string_agg(DISTINCT {a}, ',' ORDER BY {a}) FROM ed WHERE {b} = asset AND kind = '{k}'), '') AS {n}" for n, a, b, k in (("fed_by", "source", "target", "dataflow"), ("used_by", "source", "target", "dependency"), ("feeds", "target", "source", "dataflow"), ("depends_on", "target", "source", "dependency"))) + " FROM ast"),
    "l17_dynamic_references": (lambda t: lineage.lineage_diagnostics(graph_flows(t), t["assets"], t["assets"].select("asset", F.lit(False).alias("conflict")), t["flows"].select(F.col("position").alias("reference"), F.when(F.col("position") % 4 == 0, "dynamic_path").when(F.col("position") % 4 == 1, "dynamic_sql").otherwise("table").alias("kind"), F.when(F.col("position") % 3 == 0, "resolved").otherwise("no_match").alias("status"))), f"{CTES} SELECT 'self_reference' AS code, CAST(position AS VARCHAR) AS subject FROM fl WHERE position % 21 = 0 UNION ALL SELECT 'dangling', CAST(position AS VARCHAR) FROM fl WHERE position % 22 = 0 AND position % 21 <> 0 UNION ALL SELECT 'unresolved_dynamic', CAST(position AS VARCHAR) FROM fl WHERE position % 4 < 2 AND position % 3 <> 0"),
    "l17_valid_relations": (lambda t: lineage.valid_relations(graph_flows(t), lineage.lineage_diagnostics(graph_flows(t), t["assets"], t["assets"].select("asset", F.lit(False).alias("conflict")))).select("dataflow", "source", "target"), f"{CTES} SELECT position AS dataflow, source_node AS source, target_node AS target FROM fl WHERE position % 21 <> 0 AND position % 22 <> 0"),
    "l22_asset_rows": (lambda t: catalog_rows(t).select("asset", "position", F.array_join("roles", ",").alias("roles"), *COUNTS), f"{CTES}, {CATALOG} SELECT asset, position, roles, {', '.join(COUNTS)} FROM ar"),
    "l22_filter_options": (lambda t: A.filter_options(catalog_rows(t), ["stage", "kind", "roles"]), f"{CTES}, {CATALOG} SELECT DISTINCT 'stage' AS option, stage AS value FROM ar UNION ALL SELECT DISTINCT 'kind', kind FROM ar UNION ALL SELECT DISTINCT 'roles', unnest(string_split(roles, ',')) FROM ar WHERE roles <> '' UNION ALL SELECT DISTINCT 'attention', IF(attention_count > 0, 'with_attention', 'clean') FROM ar"),
    "l23_asset_flows": (lambda t: A.asset_flows(dataflows(t)), f"{CTES} SELECT target_node AS asset, 'input' AS direction, position AS dataflow, source_node AS other FROM fl UNION ALL SELECT source_node, 'output', position, target_node FROM fl"),
    "l23_asset_dependencies": (lambda t: A.asset_dependencies(depends(t)), f"{CTES}, {CATALOG} SELECT target AS asset, 'depends_on' AS direction, reference, resolved AS other FROM dp UNION ALL SELECT resolved, 'used_by', reference, target FROM dp WHERE resolved IS NOT NULL"),
    "l24_asset_page": (lambda t: A.asset_page(catalog_rows(t), scope="transit", attention="with_attention", q="BRAND", sort_by="upstream_count", descending=True).select("asset", "upstream_count", "attention_count"), f"{CTES}, {CATALOG} SELECT asset, upstream_count, attention_count FROM ar WHERE position = 'transit' AND attention_count > 0 AND contains(asset, 'brand') ORDER BY upstream_count DESC, asset LIMIT 25"),
    "l24_asset_page_by_role": (lambda t: A.asset_page(catalog_rows(t), role="destination", stage="silver", offset=3).select("asset", "downstream_count"), f"{CTES}, {CATALOG} SELECT asset, downstream_count FROM ar WHERE contains(roles, 'destination') AND stage = 'silver' ORDER BY LOWER(title), asset LIMIT 25 OFFSET 3"),
    "l24_reference_page": (lambda t: A.reference_page(reference_rows(t), q="t1", state="resolved", provenance="sql", sort_by="dependency_count", descending=True).select("reference", "display_name", "dependency_count"), f"{CTES}, {RES}, rr AS (SELECT r.reference, name AS display_name, status AS state, r.reference % 7 AS dependency_count, r.reference % 2 = 0 AS in_sql FROM res r JOIN refs USING (reference)) SELECT reference, display_name, dependency_count FROM rr WHERE state = 'resolved' AND in_sql AND (contains(display_name, 't1') OR contains(CAST(reference AS VARCHAR), 't1')) ORDER BY dependency_count DESC, reference LIMIT 25"),
    "o17_source_summary": (lambda t: A.source_summary(workspace(t)[2]), f"{CTES}, {WORK} SELECT {', '.join(f'COUNT(*) FILTER (source_kind = {k!r}) AS {k}_configured, COUNT(*) FILTER (source_kind = {k!r} AND enabled) AS {k}_enabled' for k in ('metadata', 'logs'))}, COUNT(*) FILTER (source_kind <> 'code' AND validation = 'error') AS validation_errors, COUNT(*) FILTER (source_kind <> 'code' AND validation = 'warning') AS validation_warnings FROM so"),
    "o17_project_summaries": (lambda t: A.project_summaries(*workspace(t)).withColumn("environments", F.array_join(F.transform("environments", lambda e: F.concat_ws(":", e["name"], e["metadata_count"].cast("string"), e["logs_count"].cast("string"), e["code_count"].cast("string"))), ",")), f"{CTES}, {WORK}, ec AS (SELECT environment, project, e.name, COUNT(*) FILTER (source_kind = 'metadata') AS m, COUNT(*) FILTER (source_kind = 'logs') AS l, COUNT(*) FILTER (source_kind = 'code') AS c FROM en e LEFT JOIN so USING (environment) GROUP BY ALL) SELECT p.project, p.name, COUNT(environment) AS environment_count, CAST(COALESCE(SUM(m), 0) AS BIGINT) AS metadata_source_count, CAST(COALESCE(SUM(l), 0) AS BIGINT) AS etl_log_path_count, (SELECT COUNT(*) FROM mp2 WHERE mp2.project = p.project) AS reference_mapping_count, COALESCE(string_agg(ec.name || ':' || m || ':' || l || ':' || c, ',' ORDER BY ec.name), '') AS environments FROM pj p LEFT JOIN ec USING (project) GROUP BY ALL"),
    "l25_project_registry": (registry, f"{CTES}, {RES}, al AS (SELECT reference AS signature, 'dev' AS e, status, asset FROM res UNION ALL SELECT reference, 'test', status, asset FROM res UNION ALL SELECT reference, 'prod', status, CASE WHEN reference % 4 <> 0 THEN asset END FROM res WHERE reference % 3 <> 0) SELECT signature, COUNT(DISTINCT e) AS environments, COUNT(DISTINCT CASE WHEN asset IS NOT NULL THEN e END) AS covered, COUNT(DISTINCT asset) AS targets, CASE WHEN COUNT(DISTINCT asset) > 1 THEN 'conflicting' WHEN COUNT(DISTINCT asset) = 0 THEN 'unresolved' WHEN COUNT(DISTINCT CASE WHEN asset IS NOT NULL THEN e END) < COUNT(DISTINCT e) THEN 'partial' ELSE 'resolved' END AS status FROM al GROUP BY 1"),
    "l27_validate_metadata": (issues, f"{CTES}, {ISSUES} SELECT * FROM iss"),
    "l28_new_issues": (lambda t: metadata.new_issues(issues(t).filter("code <> 'duplicate'"), issues(t)), f"{CTES}, {ISSUES} SELECT * FROM iss WHERE code = 'duplicate'"),
    "l29_rename_connections": (lambda t: metadata.rename_connections(t["connections"], t["connections"].withColumn("name", F.when((F.col("position") % 4 == 0) & (F.col("position") % 50 != 0), F.concat("name", F.lit("-new"))).otherwise(F.col("name"))), t["flows"].select("position", "source_connection_name", "destination_connection_name")), f"{CTES}, rn AS (SELECT name AS o, name || '-new' AS w FROM cn WHERE position % 4 = 0 AND position % 50 <> 0) SELECT position, COALESCE(a.w, source_connection_name) AS source_connection_name, COALESCE(b.w, destination_connection_name) AS destination_connection_name FROM fl LEFT JOIN rn a ON a.o = source_connection_name LEFT JOIN rn b ON b.o = destination_connection_name"),
    "l30_canonical_order": (lambda t: metadata.canonical_order(t["flows"]).select("position", "sort_key"), f"{CTES} SELECT position, concat_ws('|', CASE WHEN stage LIKE 'bronze%' THEN '1' WHEN stage LIKE 'silver%' THEN '2' ELSE '3' END, CASE stage WHEN 'silver2' THEN 'silver' || lpad('2', 20, '0') WHEN 'bronze10' THEN 'bronze' || lpad('10', 20, '0') ELSE stage END, lpad(CAST(group_number AS VARCHAR), 10, '0'), CASE WHEN TRIM(name) = '' THEN name ELSE 'load ' || lpad(CAST(position AS VARCHAR), 20, '0') END) AS sort_key FROM fl"),
    "l31_changed_sheets": (lambda t: metadata.changed_sheets(*edited(t)), f"{CTES} SELECT 's' || position % 3 AS source, stage AS sheet, CAST(SUM(CASE WHEN position % 9 = 0 OR position % 14 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS removed, CAST(SUM(CASE WHEN position % 9 <> 0 AND position % 14 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS added FROM fl GROUP BY ALL HAVING SUM(CASE WHEN position % 9 = 0 OR position % 14 = 0 THEN 1 ELSE 0 END) > 0"),
    "o16_metadata_summary": (lambda t: metadata.summary(t["connections"], t["flows"]), f"{CTES} SELECT 'connection_type' AS what, connection_type AS value, COUNT(*) AS records FROM cn GROUP BY ALL UNION ALL SELECT 'stage', stage, COUNT(*) FROM fl GROUP BY ALL UNION ALL SELECT 'load_type', COALESCE(load_type, 'unknown'), COUNT(*) FROM fl GROUP BY ALL"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda make: lambda spark, sf_dir: rendered(make(tables(spark, sf_dir))))(make) for n, (make, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items() if sql}
