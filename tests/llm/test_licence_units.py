"""Units of text that are all different meet no template in a join, however many templates share their words."""

from pyspark.sql import functions as F

from runlens.llm import licenses
from tests.llm.test_licence_copies import TEXT
from tests.test_growth import joined_rows


def test_different_units_make_no_joined_rows(spark, monkeypatch):
    own = F.concat(F.lit(TEXT.replace("\n", " ")), F.lit(" by file "), F.col("id").cast("string"), F.lit("\nLicensed under the Apache License, Version 2.0. File "), F.col("id").cast("string"))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), own.alias("text"))
    seen = []
    monkeypatch.setattr(licenses, "checkpoint", lambda df, real=licenses.checkpoint: (seen.append(df), real(df))[1])
    out = licenses.scan_licenses(docs, F.lit("/a/b.txt")).collect()
    assert len(out) == 200 and {r["origin"] for r in out} == {"notice"} and "Apache-2.0" in {r["licence"] for r in out}
    assert max(joined_rows(df) for df in seen) <= 200 * len(licenses.SHARED)
