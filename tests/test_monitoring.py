"""Every registered query against its SQL, and edge cases of the helpers."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from runlens import catalog
from runlens.functions import columns as C
from runlens.functions import failure_rules, graph
from runlens.operators import facts, lineage, metadata, scope
from runlens.sources import logs
from runlens.streaming import runs as streams

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "supplier", "nation", "region", "customer", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v if isinstance(v, (bool, str)) else round(float(v), 6)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    r = duck.execute(ORACLES[name])
    order = [x[0] for x in r.description]
    want = sorted((tuple(plain(x[order.index(c)]) for c in names) for x in r.fetchall()), key=str)
    assert sorted(order) == names and got == want


def test_queries_without_sql_run(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, SF).count() >= 0


def test_percentile_rounds_half_to_even(spark):
    rows = [("a", float(i)) for i in range(6)] + [("b", 1.0), ("b", 2.0)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    base = df.select("k").distinct()
    got = {r["k"]: (r["p50"], r["p10"]) for r in C.with_percentiles(base, df, ["k"], {"p50": (F.col("x"), 0.5), "p10": (F.col("x"), 0.1)}).collect()}
    assert got == {"a": (2.0, 0.0), "b": (1.0, 1.0), "c": (0.0, 0.0)}  # positions 2.5 -> 2 and 0.5 -> 0
    assert C.with_percentiles(df.agg(F.count("x").alias("n")), df.filter("false"), [], {"p": (F.col("x"), 0.5)}).first()["p"] == 0.0


def test_latest_skips_nulls(spark):
    rows = [("r1", dt.datetime(2024, 1, 1), "old"), ("r2", dt.datetime(2024, 1, 2), None), ("r3", None, "untimed")]
    df = spark.createDataFrame(rows, "dataflow_run_id string, event_time timestamp, v string")
    assert df.agg(C.latest("v").alias("v")).first()["v"] == "old"


def test_grains_and_labels(spark):
    assert [C.effective_grain(None, d) for d in (2, 30, 200, 900)] == ["hour", "day", "week", "month"]
    assert C.effective_grain("hour", 30) == "day" and C.effective_grain("month", 2) == "month"
    df = spark.createDataFrame([(dt.datetime(2021, 1, 3, 23, 30),)], "t timestamp")
    week = C.bucket("t", "week")
    assert df.select(C.bucket_label(week, "week").alias("w")).first()["w"] == "2020-W53"
    assert str(df.select(C.bucket("t", "day", "Asia/Tokyo").alias("d")).first()["d"]) == "2021-01-04 00:00:00"


def test_failure_rules(spark):
    cases = {
        "HTTP 429 Too Many Requests": "Timeout / throttling",
        "Table `x` does not exist": "Missing object",
        "  None ": "Unspecified",
        "a;b;c": "Other",
        "permission denied; connection reset by peer": "Authorization",
        "whatever": "Other",
    }
    df = spark.createDataFrame([(k,) for k in cases], "m string").select("m", failure_rules.failure_category(F.col("m")).alias("c"), failure_rules.failure_tags(F.col("m"), F.lit("Authorization")).alias("t"))
    got = {r["m"]: r for r in df.collect()}
    assert {k: r["c"] for k, r in got.items()} == cases
    assert got["permission denied; connection reset by peer"]["t"] == ["Connectivity", "Network", "Permission"]
    text = "Run 17 at 2026-07-28T07:36:28Z of 550e8400-e29b-41d4-a716-446655440000"
    assert spark.range(1).select(failure_rules.normalize_message(F.lit(text)).alias("n")).first()["n"] == "run <number> at <timestamp> of <uuid>"


def test_time_bounds():
    now = dt.datetime(2024, 3, 10, 15, 30)
    assert scope.time_bounds("24h", now) == (dt.datetime(2024, 3, 9, 15), now)
    assert scope.time_bounds("7d", now, "Asia/Tokyo")[0] == dt.datetime(2024, 3, 3, 15)
    assert scope.time_bounds("all", now) == (None, None)
    with pytest.raises(ValueError):
        scope.page(None, "drop table", True, [], 1, 0)


def test_name_uuid_is_version_5(spark):
    import uuid

    got = spark.range(1).select(C.name_uuid(F.lit("load orders")).alias("u")).first()["u"]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_DNS, "load orders"))


def test_job_logs_with_bad_lines(spark, tmp_path):
    (tmp_path / "__run_date=2026-07-28").mkdir()
    (tmp_path / "__run_date=2026-07-28" / "a.jsonl").write_text('{"job_id": "j1", "status": "failed", "total_failed": 2}\n\n{"job_id": \n')
    good, bad = logs.read_job_runs(spark, [str(tmp_path)])
    assert [r["job_id"] for r in good.collect()] == ["j1"] and "__run_date" not in good.columns
    assert [r["code"] for r in bad.collect()] == ["invalid_jsonl"]


def test_system_logs(spark, tmp_path):
    (tmp_path / "system_log_20260728_010203_job-7.jsonl").write_text('{"level": "info", "message": "Start"}\n{"level": "error", "dataflow_id": "d1", "message": "Boom"}\n')
    rows = logs.read_system_logs(spark, [str(tmp_path)], job_id="job-7").collect()
    assert [(r["level"], r["job_id"], str(r["file_time"])) for r in rows] == [("INFO", "job-7", "2026-07-28 01:02:03")]
    assert logs.read_system_logs(spark, [str(tmp_path)], dataflow_id="d1", q="boom").count() == 1


def test_replacing_files_twice_changes_nothing(spark):
    cur = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "_source_id int, _file_uri string, x int")
    new = spark.createDataFrame([(1, "a", 9)], "_source_id int, _file_uri string, x int")
    once = logs.replace_by_file(cur, new)
    assert sorted(r["x"] for r in logs.replace_by_file(once, new).collect()) == sorted(r["x"] for r in once.collect()) == [3, 9]


def test_schema_drift(spark, tmp_path):
    spark.range(3).select(F.col("id").cast("double").alias("source_rows_read"), F.lit("x").alias("extra")).write.parquet(str(tmp_path / "a"))
    from pyspark.sql import types as T

    target = T.StructType([T.StructField("source_rows_read", T.LongType()), T.StructField("status", T.StringType())])
    assert logs.schema_compatibility(spark.read.parquet(str(tmp_path / "a")).schema, target) == {"source_rows_read": "lossless_check", "extra": "unknown"}
    fixed = logs.schema_repair(spark.read.parquet(str(tmp_path / "a")), ["source_rows_read"])
    assert fixed.schema["source_rows_read"].dataType == T.LongType() and fixed.count() == 3
    with pytest.raises(Exception, match="integral"):
        logs.schema_repair(spark.createDataFrame([(1.5,)], "source_rows_read double"), ["source_rows_read"]).collect()
    assert facts.pad_missing(fixed, target).columns[-1] == "status"


def test_publication_needs_valid_facts(spark, tmp_path):
    jobs = spark.createDataFrame([("j", " OK ", dt.datetime(2024, 1, 1), 1)], "job_id string, status string, event_time timestamp, _source_id int")
    good = facts.build_job_facts(jobs)
    logs.publish(good, facts.validate_facts(jobs, good), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 1
    bad = good.withColumn("normalized_status", F.lit("x"))
    with pytest.raises(ValueError):
        logs.publish(bad, facts.validate_facts(jobs, bad), str(tmp_path / "g"))


def test_streams(spark, tmp_path):
    rows = [(f"r{i}", f"d{i % 2}", " Failed " if i == 5 else "ok", dt.datetime(2024, 1, 1, i)) for i in range(6)]
    df = spark.createDataFrame(rows, "dataflow_run_id string, dataflow_id string, status string, event_time timestamp")
    for k in range(2):
        df.filter(F.col("dataflow_run_id").isin([f"r{i}" for i in range(3 * k, 3 * k + 3)])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.stream_dataflow_runs(spark, str(tmp_path / "in"), df.schema)
    q = streams.stream_latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["dataflow_id"], r["status"]) for r in spark.table("latest").collect()} == {("d0", "ok"), ("d1", "failed")}
    q = streams.stream_status_trend(stream).writeStream.outputMode("append").format("memory").queryName("trend").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("trend").filter("runs <> 1").count() == 0
    q = streams.start_replace_by_file(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert streams.read_replaced(spark, str(tmp_path / "out")).count() == 6
    df.filter("dataflow_run_id = 'r0'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.start_replace_by_file(streams.stream_dataflow_runs(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert sorted(r["dataflow_run_id"] for r in streams.read_replaced(spark, str(tmp_path / "out")).collect()) == ["r0", "r0", "r1", "r2", "r3", "r4", "r5"]
    lines = tmp_path / "sys"
    lines.mkdir()
    (lines / "system_log_20260728_010203_job-7.jsonl").write_text('{"level": "info", "message": "Start"}\n\n{"level": "error", "job_id": "j2", "dataflow_id": "d1"}\n')
    q = streams.stream_system_logs(spark, str(lines)).writeStream.format("memory").queryName("system").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["level"], r["job_id"], r["dataflow_id"]) for r in spark.table("system").collect()} == {("INFO", "job-7", None), ("ERROR", "j2", "d1")}


def test_components_and_trace(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(20, 21), (30, 30)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert {got[i] for i in range(1, 13)} == {1} and got[21] == 20 and got[30] == 30
    ways = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "b")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r["node"], r["depth"]) for r in graph.trace(ways, seeds).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r["node"] for r in graph.trace(ways, seeds, "both").collect()} == {"a", "b", "c", "x"}


def test_trace_reaches_the_end_of_a_long_chain(spark):
    ways = spark.createDataFrame([(k, k + 1) for k in range(54)], "source long, target long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert {(r["node"], r["depth"]) for r in graph.trace(ways, seeds).collect()} == {(k, k) for k in range(55)}
    with pytest.raises(RuntimeError):
        graph.trace(ways, seeds, max_depth=3)


def test_assets_stitch_over_aliases(spark):
    ids = spark.createDataFrame([(1, "logical_table", "a"), (2, "logical_table", "a"), (2, "physical_path", "p"), (3, "physical_path", "p"), (3, "logical_table", "b"), (4, "api_endpoint", "u"), (5, "physical_path", "p")], "node long, kind string, value string").withColumn("priority", F.when(F.col("kind") == "logical_table", 1).otherwise(2))
    got = {r["node"]: (r["asset"], r["conflict"]) for r in lineage.stitch_assets(ids).collect()}
    assert got == {1: (1, False), 2: (1, False), 3: (3, True), 4: (4, False), 5: (1, False)}
    one = spark.range(1).select(lineage.normalize_path(F.lit("S3A://B//x/y/")).alias("p"), lineage.normalize_api_url(F.lit("HTTP://H.x/a//b/?q=1"), F.lit("post")).alias("u")).first()
    assert (one["p"], one["u"]) == ("s3://B/x/y", "POST http://h.x/a/b")


def test_metadata_round_trips(spark):
    flow = "struct<connection_name:string,schema_name:string,table:string>"
    docs = spark.createDataFrame([(1, [("c1", "database", "sql", "cat", "db", "/base/", True)], [("f", None, True, ("c1", "s", "t"), ("c2", "s", "u")), (None, "id9", False, ("c1", "s", "t"), ("c1", "s", "u"))], [("c1", "s", "t")])], f"document int, connections array<struct<name:string,connection_type:string,format:string,catalog:string,database:string,base_path:string,is_active:boolean>>, dataflows array<struct<name:string,dataflow_id:string,is_active:boolean,source:{flow},destination:{flow}>>, schema_hints array<struct<connection_name:string,schema_name:string,table_name:string>>")
    conns, flows, hints = metadata.normalize(docs)
    assert flows.count() == 1 and conns.count() == 1 and hints.count() == 1 and len(flows.first()["dataflow_id"]) == 36
    r = metadata.resolve_endpoints(flows, conns).first()
    assert r["source_path"] == "/base/s/t" and r["source_resolved"] and not r["destination_resolved"]
    back = metadata.unflatten(metadata.flatten(flows))
    assert back.first()["source"]["table"] == "t"
    rows = spark.createDataFrame([("c", "s", "t", 2, "b"), ("c", "s", "t", 1, "a")], "connection_name string, schema_name string, table_name string, ordinal_position int, column_name string")
    assert [h["column_name"] for h in metadata.group_hints(rows).first()["hints"]] == ["a", "b"] and metadata.flatten_hints(metadata.group_hints(rows)).count() == 2
    keys = spark.createDataFrame([("t10",), ("t9",)], "n string").orderBy(metadata.natural_key("n")).collect()
    assert [k["n"] for k in keys] == ["t9", "t10"]


def test_metadata_documents(spark, tmp_path):
    (tmp_path / "all.json").write_text('{"connections": [{"name": "c"}], "dataflows": [{"name": "f"}, {"name": "g"}]}')
    (tmp_path / "dataflows").mkdir()
    (tmp_path / "dataflows" / "one.json").write_text('[{"name": "h"}]')
    got = logs.read_metadata(spark, [str(tmp_path / "all.json"), str(tmp_path / "dataflows" / "one.json")]).groupBy("section").count().collect()
    assert {r["section"]: r["count"] for r in got} == {"connections": 1, "dataflows": 3}
