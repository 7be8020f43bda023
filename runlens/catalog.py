"""All registered queries of the monitoring library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import audit_queries, ingestion, lineage_queries, monitoring, resolution_queries, stream_queries

PLANS = (monitoring, ingestion, audit_queries, lineage_queries, resolution_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: make for plan in PLANS for name, make in plan.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.oracle_sql().items()}
