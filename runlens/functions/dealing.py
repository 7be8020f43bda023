"""Joins and lists that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], salt: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """left with its rows of right, which has at most one row a key: left is dealt by (key, salt), and right is copied to each salt.

    The copies are made by a join, as Spark counts them in its estimate then; it takes exploded rows to be as few as before, and would broadcast all copies through the driver.
    """
    a = left.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int"))
    every = right.sparkSession.range(salts).select(F.col("id").cast("int").alias("__salt"))
    b = right.crossJoin(F.broadcast(every))
    return a.join(b, [*on, "__salt"], how).drop("__salt")


def smallest(df: DataFrame, keys: list[str], value: str, n: int, salts: int = 16) -> DataFrame:
    """keys and the sorted array `values` of the n smallest different values of each: of parts of a group first, then of what these leave."""
    ranked = lambda d, *by: d.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(value))).filter(F.col("__rank") <= n)
    own = df.select(*keys, value).distinct().withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    return ranked(ranked(own, *keys, "__salt"), *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("values"))
