"""Copies of a licence text are judged once."""

from pyspark.sql import functions as F

from runlens.llm import licenses
from tests.test_growth import joined_rows

TEXT = "Copyright A. Licensed under the Apache License, Version 2.0.\n\n" + "\n".join(licenses.SHARED.values()) + "\n\nNothing of note."


def test_copies_of_a_text_meet_the_templates_once(spark, monkeypatch):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "words").otherwise(TEXT).alias("text"))
    seen = []
    monkeypatch.setattr(licenses, "checkpoint", lambda df, real=licenses.checkpoint: (seen.append(df), real(df))[1])
    out = licenses.scan_licenses(docs, F.lit("/a/b.txt")).collect()
    assert {(r["licence"], r["origin"]) for r in out if r["doc_id"] != 7} == {("Apache-2.0", "notice")} and len(out) == 200
    assert [r["origin"] for r in out if r["doc_id"] == 7] == ["none"]
    assert max(joined_rows(df) for df in seen) < 200 * 40
