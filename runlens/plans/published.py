"""Tables that are built once a session and revision of their source, and read by the queries that share them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graph import shared_folder

_KEPT: dict[tuple[str, str, str], tuple[tuple, dict[str, str]]] = {}


def revision(spark: SparkSession, path: str) -> tuple:
    """Rows and newest file of a table: what tells whether it has changed."""
    return tuple(spark.read.parquet(path).agg(F.count(F.lit(1)), F.max("_metadata.file_modification_time")).first())


def kept(spark: SparkSession, what: str, path: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables that make gives, written below the shared folder once a session and revision of the table at path."""
    key, now = (spark.sparkContext.applicationId, what, path), revision(spark, path)
    if key not in _KEPT or _KEPT[key][0] != now:
        folder = shared_folder(spark, "kept")
        made = make()
        for name, df in made.items():
            df.write.parquet(f"{folder}/{name}")
        _KEPT[key] = (now, {name: f"{folder}/{name}" for name in made})
    return {name: spark.read.parquet(at) for name, at in _KEPT[key][1].items()}
