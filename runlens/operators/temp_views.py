"""Temporary views in Python sources: what a read by name comes from, through the views that the same function defined before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import settled

#: Calls that define a view, and that read paths, tables and SQL texts (fixed values).
DEFINES = r"\.(?:createTempView|createOrReplaceTempView|createGlobalTempView|createOrReplaceGlobalTempView|registerTempTable)\(\s*"
READS = {"path": r"\.(?:parquet|csv|json|orc|text|load)\(\s*", "table": r"\.(?:table)\(\s*", "sql": r"\.sql\(\s*"}
LITERAL = r"""[rbf]?["']+([^"'{}]*)["']+\s*[,)]"""
NAME = r"(?i)\b(?:from|join|using|into|update)\s+([A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)*)(?!\s*\()"


def view_statements(files: DataFrame) -> DataFrame:
    """file, function, line, defined view and reads (kind, value) of each line of Python sources (file, code) that has any.

    A line is a statement. A view whose name isn't a literal is `dynamic_temp_view`, in place of the view's name; a read that isn't one is of kind
    `dynamic_<kind>` without value. Names in SQL texts are tables; comments are left out.
    """
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace("code", r"(?m)#[^\n]*$", ""), r"\n")).alias("line", "text"))
    at = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.nullif(F.regexp_extract("text", r"^\s*(?:async\s+)?def\s+(\w+)", 1), F.lit(""))
    # the same function name twice in a file is two functions
    inside = lines.withColumn("head", F.last(F.when(header.isNotNull(), F.struct(header.alias("name"), F.col("line").alias("at"))), ignorenulls=True).over(at))
    own = inside.withColumns({"function": F.coalesce("head.name", F.lit("<module>")), "scope": F.coalesce("head.at", F.lit(-1))}).drop("head")
    told = lambda call: F.regexp_extract_all("text", F.lit(call + LITERAL), F.lit(1))
    said = lambda call: F.regexp_count("text", F.lit(call))
    pair = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.lower(v).alias("value") if kind == "table" else v.alias("value")))
    dynamic = [F.when(said(c) > F.size(told(c)), F.array(F.struct(F.lit(f"dynamic_{k}").alias("kind"), F.lit(None).cast("string").alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")) for k, c in READS.items()]
    named = F.flatten(F.transform(told(READS["sql"]), lambda q: F.regexp_extract_all(q, F.lit(NAME), F.lit(1))))
    reads = F.array_distinct(F.concat(pair("path", told(READS["path"])), pair("table", told(READS["table"])), pair("table", named), *dynamic))
    view = F.when(said(DEFINES) > 0, F.lower(F.coalesce(F.nullif(F.regexp_extract("text", DEFINES + LITERAL, 1), F.lit("")), F.lit("dynamic_temp_view"))))
    return own.select("file", "function", "scope", "line", view.alias("view"), reads.alias("reads")).filter("view is not null or size(reads) > 0")


def resolve_views(statements: DataFrame) -> DataFrame:
    """file, function, line and name of each read, and kind and value of every path, table or dynamic expression that it comes from, with the number of views between.

    A name is bound to the last definition before it in the same function; a view that is defined from its own name reads the one before. Names that no earlier
    line defines are tables. Chains are followed by joins until no read is bound to a view, one round for each view of the longest chain; lines fall along a
    chain, so it ends. Bindings are found by a window over a name's statements in a function, not by pairs of them.
    """
    key = ["file", "scope", "name"]
    none = F.lit(None).cast("int")
    reads = statements.select("file", "function", "scope", "line", F.inline("reads")).withColumn("name", F.when(F.col("kind") == "table", F.col("value")))
    defined = statements.filter("view is not null and view <> 'dynamic_temp_view'").select("file", "function", "scope", "line", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"), F.col("view").alias("name"), F.col("line").alias("defined"))
    both = reads.withColumn("defined", none).unionByName(defined)
    before = Window.partitionBy(*key).orderBy("line", F.col("defined").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bound = both.withColumn("at", F.when(F.col("name").isNotNull(), F.last("defined", ignorenulls=True).over(before))).filter("kind is not null")
    bound = settled(bound.select("file", "function", "scope", "line", "kind", "value", "at"))
    steps = bound.select("file", "scope", F.col("line").alias("at"), F.col("kind").alias("k"), F.col("value").alias("v"), F.col("at").alias("further"))
    start = bound.select("file", "function", "scope", "line", F.coalesce("value", "kind").alias("name"), "kind", "value", "at", F.lit(0).alias("views"))
    out, front = start.filter("at is null").drop("at"), start.filter("at is not null")
    while not front.isEmpty():
        # a view that is defined from nothing known has an unknown source
        met = settled(front.join(steps, ["file", "scope", "at"], "left").select("file", "function", "scope", "line", "name", F.coalesce("k", F.lit("unknown")).alias("kind"), F.col("v").alias("value"), F.col("further").alias("at"), (F.col("views") + 1).alias("views")))
        out, front = out.unionByName(met.filter("at is null").drop("at")), met.filter("at is not null")
    return out.groupBy("file", "function", "line", "name", "kind", "value").agg(F.min("views").alias("views"))
