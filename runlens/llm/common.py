"""What several operators share: the shared folder, checkpoints, linking and components."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: What functions marked kept_in_worker made in this process, with the task that last asked for it.
KEPT: dict[tuple, list] = {}


def running_task() -> int | None:
    task = TaskContext.get()
    return task.taskAttemptId() if task else None


def kept_in_worker(make: Callable) -> Callable:
    """Keeps what make gives, for each of its arguments. When something new is made, all that the running task hasn't asked for goes first.

    A Python worker lives through the stages of a session, so tables of a stage that is over would take its memory in all later ones.
    """

    @functools.wraps(make)
    def kept(*args):
        key, task = (make.__module__, make.__qualname__, *args), running_task()
        if key not in KEPT:
            for other in [k for k, (_, by) in KEPT.items() if by != task]:
                del KEPT[other]
            KEPT[key] = [make(*args), task]
        KEPT[key][1] = task
        return KEPT[key][0]

    return kept


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free(df: DataFrame, name: str) -> str:
    """name, with underscores put before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(column: pa.Array, size: int = 500) -> Iterator[list]:
    """An Arrow array as lists of `size` Python objects, of which one is held at a time."""
    for a in range(0, len(column), size):
        yield column.slice(a, size).to_pylist()


def values(column: pa.Array) -> Iterator:
    """The objects of slices one by one."""
    for some in slices(column):
        yield from some


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where it is unset, a local session gets a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder's URI below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder.

    checkpoint() would keep the size that the plan estimated, which multiplies with each join of a loop; a table has its own.
    """
    folder = new_folder(df.sparkSession, "step")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def mounted(uri: str) -> str:
    """The local path of a folder that is mounted on all machines. Object stores have to be mounted for memory-mapped files."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"memory-mapped files need a folder that is mounted on all machines, not {uri}")
    return uri


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salt: Column, n: int = 8, how: str = "left_semi") -> DataFrame:
    """Join whose left side may hold a third of its rows under one key: the left is dealt by (key, salt), the right, one row a key, is copied to all n salts."""
    a = left.withColumn("__salt", F.pmod(salt, F.lit(n)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return a.join(b, [*on, "__salt"], how).drop("__salt")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a, b).

    Each round takes the smallest label of a node's neighbours and then the label's own label,
    so a chain of n nodes needs about log2(n) rounds. Nodes without edges are not in the result.
    Self loops and repeated edges are harmless; no edges give no rows.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpoint(both)
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        labels_new = checkpoint(step.join(up, "component", "left").select("node", "was", F.least("component", F.coalesce("above", "component")).alias("component")))
        changed = labels_new.filter("was <> component").limit(1).count()
        labels = labels_new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: Members of a bucket that are compared with one another at once, on either side.
PART = 500


def bucket_links(members: DataFrame, near: Column, verify, payload: DataFrame | None = None, compare=None, known: DataFrame | None = None, rest: bool = True) -> DataFrame:
    """Links (a, b) that connect whatever all near pairs within buckets connect, without all pairs of a bucket.

    members: key and node; payload: one row a node with what `near`, a condition on x.* and y.*, reads besides the nodes;
    verify(pairs of a, b) keeps the true ones. A bucket's head is its member that meets most others in all its buckets: the
    text that copies were made of is near all of them, though they may not be near each other. First each member meets the best
    of its heads only, then the heads of those buckets in which it is still in another component than the head. What that
    leaves, few members that are near none of up to as many heads as they have keys, meets all others of its buckets in other
    components, in parts of about PART members on either side. The condition is part of the joins, so pairs that aren't near leave
    no rows; compare(few, many), if given, takes the place of the last join: both have key, part, node and component, and it
    gives links between rows of one key and part, of which one to a node and a component is enough. What `known` links connect isn't
    compared again, and they are among the result. Without `rest`, members meet heads only, and what is left is the caller's.
    """
    full = (lambda df: df) if payload is None else (lambda df: df.join(payload, "node"))

    def tested(pairs: DataFrame) -> DataFrame:
        """Links among pairs (first, node), of which a first may be in many."""
        heads = full(pairs.select(F.col("first").alias("node")).distinct())
        met = full(pairs).alias("y").join(heads.alias("x"), F.expr("y.first = x.node") & near, "inner")
        return checkpoint(verify(met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))))

    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = checkpoint(salted_join(members, shared, ["key"], F.xxhash64("node"), how="inner"))
    met = kept.groupBy("node").agg(F.sum("n").alias("met"))
    head = kept.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("h")).select("key", F.col("h.met").alias("met"), F.col("h.node").alias("first"))
    kept = checkpoint(salted_join(kept.drop("n"), head, ["key"], F.xxhash64("node"), how="inner"))
    best = kept.groupBy("node").agg(F.max(F.struct("met", "first")).alias("h")).select("node", F.col("h.first").alias("first")).filter("node <> first")

    def placed() -> DataFrame:
        """Members of buckets with their component and that of the head, where they differ."""
        comp = connected_components(links)
        own = kept.select("key", "node", "first").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        of_head = salted_join(own, comp.select(F.col("node").alias("first"), F.col("component").alias("main")), ["first"], F.xxhash64("node"), how="left")
        return checkpoint(of_head.withColumn("main", F.coalesce("main", "first")))

    if known is None:
        links = tested(best)
    else:
        links = known
        links = known.union(tested(best.join(placed().filter("component <> main").select("node", "first").distinct(), ["node", "first"], "left_semi")))
    links = links.union(tested(placed().filter("component <> main").select("first", "node").distinct()))
    if not rest:
        return links
    all_ = placed()
    left = all_.filter("component <> main")
    open_ = salted_join(all_, left.select("key").distinct(), ["key"], F.xxhash64("node"))
    parts = lambda c: F.ceil(F.count_if(c) / PART).cast("int")
    sizes = open_.groupBy("key").agg(F.greatest(parts(F.lit(True)), F.lit(1)).alias("of_all"), F.greatest(parts(F.col("component") != F.col("main")), F.lit(1)).alias("of_few"))
    placed_ = checkpoint(salted_join(open_, sizes, ["key"], F.xxhash64("node"), how="inner"))
    dealt = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = (F.col("x") * F.col("of_few") + F.col("y")).alias("part")
    wanted = ["key", "node", "component", "main"]
    many = placed_.withColumn("x", dealt("of_all", 1)).withColumn("y", each("of_few")).select(*wanted, part)
    few = placed_.filter("component <> main").withColumn("y", dealt("of_few", 2)).withColumn("x", each("of_all")).select(*wanted, part)
    if compare is not None:
        return links.union(checkpoint(compare(few, many)))
    apart = F.expr("x.key = y.key and x.part = y.part and x.component <> y.component and (y.component = y.main or x.node < y.node)")
    across = full(few).alias("x").join(full(many).alias("y"), apart & near).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return links.union(checkpoint(verify(across.distinct())))
