"""Audit and repair of log trees, on small trees written by hand."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from runlens.sources import audit

TARGET = T.StructType([T.StructField("group_number", T.LongType()), T.StructField("execution_order", T.LongType()), T.StructField("status", T.StringType())])


def legacy(path, value=2.0):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({"group_number": pa.array([value, None], pa.float64()), "execution_order": pa.array([1.0, None], pa.float64())}), path)


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def totals(found):
    return found.totals.first().asDict()


def test_streams_for_analysis_are_audited_alone(spark, tmp_path):
    root = tmp_path / "my logs"
    legacy(root / "etl_logs" / "analyst" / "dataflow_run_log" / "legacy.parquet")
    legacy(root / "other" / "legacy.parquet", 0.5)
    write(root / "etl_logs" / "debug_json" / "job_run_log" / "bad.jsonl", "not-json")
    write(root / "etl_logs" / "analyst" / "job_run_log" / "job.jsonl", json.dumps({"_type": "job_run_log", "job_id": "job-1"}), "", json.dumps({"_type": "else", "x": 1}))
    found = audit.audit_logs(spark, str(root), TARGET)
    told = totals(found)
    assert (told["parquet_files"], told["job_jsonl_files"], told["job_records"], told["incompatible_count"], told["repairable_count"]) == (1, 1, 1, 0, 2)
    assert sorted(r["column"] for r in found.repair_plan.collect()) == ["execution_order", "group_number"]
    missing = {(r["artifact_type"], r["column"]): r["count"] for r in found.columns.filter("what = 'missing'").collect()}
    assert missing["dataflow_parquet", "status"] == 1 and ("job_jsonl", "job_id") not in missing and missing["job_jsonl", "status"] == 1


def test_repaired_copies_hold_the_same_and_need_no_repair(spark, tmp_path):
    root, new = tmp_path / "logs", tmp_path / "repaired"
    legacy(root / "a" / "first.parquet")
    legacy(root / "b" / "second.parquet", -3.0)
    done = audit.repair_logs(spark, audit.audit_logs(spark, str(root), TARGET), f"file://{new}").collect()
    assert len(done) == 2 and {r["rows"] for r in done} == {2} and done[0]["columns"] == ["execution_order", "group_number"]
    assert {pq.read_schema(p).field("group_number").type for p in new.iterdir()} == {pa.int64()}
    assert sorted(pq.read_table(p)["group_number"].to_pylist()[0] for p in new.iterdir()) == [-3, 2]
    again = totals(audit.audit_logs(spark, str(new), TARGET))
    assert again["repairable_count"] == again["incompatible_count"] == 0
    # the originals stay
    assert pq.read_schema(root / "a" / "first.parquet").field("group_number").type == pa.float64()


@pytest.mark.parametrize("value", [2.5, float("nan"), float("inf"), 1e300, 2.0**63])
def test_values_that_are_not_whole_are_refused(spark, tmp_path, value):
    legacy(tmp_path / "logs" / "bad.parquet", value)
    found = audit.audit_logs(spark, str(tmp_path / "logs"), TARGET)
    assert totals(found)["incompatible_count"] == 1 and [r["column"] for r in found.repair_plan.collect()] == ["execution_order"]
    with pytest.raises(ValueError, match="incompatible findings"):
        audit.repair_logs(spark, found, f"file://{tmp_path}/repaired")
    assert not (tmp_path / "repaired").exists()


def test_odd_files_and_lines(spark, tmp_path):
    root = tmp_path / "logs"
    write(root / "job_run_log" / "job.jsonl", "not-json", '{"_type": "job_run_log", "total_failed": 1.0, "job_id": null, "stages": ["a"], "new": {}}', '{"_type": "job_run_log", "total_failed": 12345678901234567890, "duration_seconds": 2}', "7")
    write(root / "torn.parquet", "PAR1")
    pq.write_table(pa.table({"group_number": pa.array([1], pa.int32()), "__event_time": ["x"], "_file_uri": ["x"], "status": pa.array(["a"], pa.large_string()), "transform_missing_column_policy": ["x"]}), root / "wide.parquet")
    pq.write_table(pa.table({"group_number": pa.array([], pa.float32())}), root / "empty.parquet")
    got = {(r["category"], r["path"].rsplit("/", 1)[1], r["column"], r["source_type"], r["occurrences"]) for r in audit.audit_logs(spark, str(root), TARGET).findings.collect()}
    assert got == {
        ("incompatible", "job.jsonl", None, "malformed", 1), ("incompatible", "job.jsonl", "total_failed", "float", 1), ("incompatible", "job.jsonl", "stages", "list", 1), ("unexpected", "job.jsonl", "new", "dict", 1),
        ("incompatible", "torn.parquet", None, None, 1), ("incompatible", "wide.parquet", "group_number", "int", 1), ("unexpected", "wide.parquet", "__event_time", "string", 1), ("ignored", "wide.parquet", "transform_missing_column_policy", "string", 1),
        ("repairable", "empty.parquet", "group_number", "float", 1),
    }


def test_a_tree_without_files(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    found = audit.audit_logs(spark, str(tmp_path / "logs"), TARGET)
    assert set(totals(found).values()) == {0} and found.findings.count() == found.repair_plan.count() == 0
