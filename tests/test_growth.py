"""Plans whose rows grow no faster than the input."""

import re

import pytest
from pyspark.sql import functions as F

from runlens import catalog
from runlens.functions import columns, dealing, graph
from runlens.operators import freshness, lineage
from tests.test_monitoring import SF


def joined_rows(df):
    """The most rows that a join of the plan that ran gave."""
    df.collect()
    seen, plans = [0], [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            seen.append(p.metrics().apply("numOutputRows").value())
        if p.nodeName() == "AdaptiveSparkPlan":
            plans.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            plans.append(p.plan())
        kids = p.children()
        plans += [kids.apply(i) for i in range(kids.size())]
    return max(seen)


def test_references_meet_counts_and_not_every_table(spark):
    refs = spark.range(400).select(F.col("id").alias("reference"), F.lit("s.t").alias("name"), F.when(F.col("id") % 4 < 3, F.concat(F.lit("db"), (F.col("id") % 4).cast("string"))).alias("instance"))
    tables = spark.range(300).select(F.col("id").alias("asset"), F.when(F.col("id") >= 2, F.lit("db1")).when(F.col("id") == 1, F.lit("db0")).alias("instance"), F.concat(F.lit("cat"), F.col("id").cast("string"), F.lit(".s.t")).alias("full_name"))
    out = lineage.resolve_references(refs, tables)
    assert joined_rows(out) <= 400 * 2  # 120,000 pairs before
    got = {r["reference"] % 4: (r["status"], r["asset"]) for r in out.collect()}
    assert got == {0: ("resolved", 1), 1: ("ambiguous", None), 2: ("out_of_scope", None), 3: ("resolved", 0)} and out.count() == 400


def test_facts_are_derived_by_what_a_query_reads(spark):
    plain = catalog.queries()["p04_operation_mix"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plain and "orders" not in plain and "l_extendedprice" not in plain.split("Relation")[0]
    assert "Join" in catalog.queries()["t08_engine_stage_matrix"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_copies_of_a_dealt_join_count_in_its_estimate(spark, tmp_path):
    spark.range(1000).withColumn("v", F.col("id")).write.parquet(str(tmp_path / "r"))
    right = spark.read.parquet(str(tmp_path / "r"))
    left = right.select("id")
    plan = dealing.dealt_join(left, right, ["id"], F.col("id"))
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert plan.count() == 1000
    held = plan._jdf.queryExecution().optimizedPlan().collectLeaves()
    copies = right.crossJoin(F.broadcast(spark.range(16)))
    assert size(copies) >= 16 * size(right) and "Generate" not in plan._jdf.queryExecution().optimizedPlan().toString() and held.size() == 3


def test_settled_tables_are_as_large_on_disk_as_they_are(spark):
    rows = spark.range(20000).select(F.lit("the same long identifier in every row").alias("value"))
    held = graph.settled(rows)
    assert held.count() == 20000
    assert int(str(held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 20000 * 37  # 37 characters each


def shuffled_rows(df):
    """Rows that the shuffles of the plan that ran wrote."""
    df.collect()
    seen, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        if p.nodeName() == "Exchange" and p.metrics().contains("shuffleRecordsWritten"):
            seen += p.metrics().apply("shuffleRecordsWritten").value()
        if p.nodeName() == "AdaptiveSparkPlan":
            plans.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            plans.append(p.plan())
        kids = p.children()
        plans += [kids.apply(i) for i in range(kids.size())]
    return seen


@pytest.fixture
def runs(spark):
    """Runs of three dataflows whose aggregates Spark takes for too large to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "300KB")
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    i, none = F.col("id"), F.lit(None).cast("string")
    yield spark.range(300_000).select(
        text("df-", i % 3).alias("dataflow_id"), F.timestamp_seconds(i).alias("event_time"), text("run-", i).alias("dataflow_run_id"), F.lit("etl").alias("operation_type"),
        F.when(i % 5 == 0, "skipped").otherwise("succeeded").alias("normalized_status"), F.when(i < 100, text("flow ", i)).alias("dataflow_name"), F.when(i % 7 == 0, text("stage ", i)).alias("stage"),
        none.alias("error_message"), none.alias("source_watermark_columns"), none.alias("source_watermark_before"), text(i).alias("source_watermark_after"), none.alias("source_watermark_effective"),
    )
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_runs_are_not_shuffled_to_meet_newest_times(runs):
    out = columns.latest_values(runs, "dataflow_id", {c: F.col(c) for c in ("dataflow_name", "stage")}, 1)
    assert shuffled_rows(out) < 1000
    assert {tuple(r) for r in out.collect()} == {("df-0", "flow 99", "stage 299985"), ("df-1", "flow 97", "stage 299992"), ("df-2", "flow 98", "stage 299999")}


def test_runs_are_not_shuffled_for_the_freshness_registry(runs):
    out = freshness.freshness_registry(runs, "1970-01-05 00:00:00")
    assert shuffled_rows(out) < 2000
    got = {r["dataflow_id"]: (r["run_count"], r["latest_status"], r["movement_state"], r["skipped_streak"], r["dataflow_name"]) for r in out.collect()}
    assert got == {f"df-{k}": (100_000, "succeeded", "initialized", 0, name) for k, name in enumerate(("flow 99", "flow 97", "flow 98"))}


def test_profiles_join_thresholds_once(spark):
    plan = catalog.queries()["e07_profiles"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"operation_group#\d+ = operation_group#\d+", plan)) == 1
