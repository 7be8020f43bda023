"""Graphs as vertex and edge tables: components and traces by iterated joins."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share; where it is unset, a local session gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage.

    It is written plain: Spark estimates a table by its files, and would broadcast one through the driver that is small only on disk.
    """
    folder = shared_folder(df.sparkSession, "graph")
    df.write.options(**{"compression": "uncompressed", "parquet.enable.dictionary": "false"}).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable over undirected edges (a, b)."""
    both = settled(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("above"))
        step = labels.join(near, "node").join(jump, "near", "left").select("node", F.col("component").alias("was"), F.least("component", "near", F.coalesce("above", "near")).alias("component"))
        step = settled(step)
        done = not step.filter("was <> component").limit(1).count()
        labels = step.select("node", "component")
        if done:
            return labels
    raise RuntimeError("components did not settle")


def trace(edges: DataFrame, seeds: DataFrame, direction: str = "downstream", max_depth: int | None = None) -> DataFrame:
    """(node, depth) reachable from seeds (node) over edges (source, target): `upstream`, `downstream` or `both` ways apart.

    The search goes on until nothing new is reached. If max_depth is given and nodes lie deeper, it is a RuntimeError.
    """
    if direction == "both":
        up, down = trace(edges, seeds, "upstream", max_depth), trace(edges, seeds, "downstream", max_depth)
        return up.union(down).groupBy("node").agg(F.min("depth").alias("depth"))
    a, b = ("source", "target") if direction == "downstream" else ("target", "source")
    ways = settled(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    seen = front = settled(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in itertools.count(1):
        front = ways.join(front.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        front = settled(front)
        if not front.limit(1).count():
            break
        if max_depth is not None and depth > max_depth:
            raise RuntimeError(f"nodes lie deeper than {max_depth}")
        seen = settled(seen.union(front))
    return seen
