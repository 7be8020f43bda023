"""Mixing sources to target weights by Pfair scheduling.

A source with weight w gets its j-th block within the window [floor(j / w), ceil((j + 1) / w)); earliest deadline first
over the released blocks then keeps every source within one block of its share at any time. Windows are computed from the
exact weights in integers, so nothing is rounded however long the schedule is. A phase ends when a source is used up, and the
rest goes on with their weights scaled up. Every row is kept, none repeats.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least characters in a block, and blocks that a schedule has at most besides one for each source: larger tables get larger blocks.
BLOCK, BLOCKS = 1 << 18, 1 << 20
#: Characters of the largest source in a range of hashes, which a task sorts.
RANGE = 1 << 25


def phase_slots(weights: list[int], left: list[int]) -> list[list[int]]:
    """For each source the slots of its blocks, earliest deadline first, ties to the first source, until a source has used up what it has left."""
    q, slots = sum(weights), [[] for _ in weights]
    later = [(0, i) for i in range(len(weights))]  # by release
    ready: list[tuple[int, int]] = []
    for t in range(sum(left)):
        while later and later[0][0] <= t:
            _, i = heapq.heappop(later)
            heapq.heappush(ready, (-(-(len(slots[i]) + 1) * q // weights[i]), i))
        _, i = heapq.heappop(ready)
        slots[i].append(t)
        if (j := len(slots[i])) == left[i]:
            break
        heapq.heappush(later, (j * q // weights[i], i))
    return slots


def schedule(sources: list[tuple[str | None, int, float]], frame: int) -> list[tuple]:
    """Rows (source, frame number, first block, end block, slots) from (source, blocks, weight).

    A row's blocks lie within one frame, `frame` blocks of the source that start at a multiple of it. Sources of weight 0 come
    after all others.
    """
    rows, used, base = [], [0] * len(sources), 0
    exact = [Fraction(w) for _, _, w in sources]
    scale = math.lcm(*(w.denominator for w in exact)) if exact else 1
    whole = [int(w * scale) for w in exact]
    while any(left := [s[1] - u for s, u in zip(sources, used, strict=True)]):
        active = [i for i, n in enumerate(left) if n and whole[i]] or [i for i, n in enumerate(left) if n]
        slots = phase_slots([whole[i] or 1 for i in active], [left[i] for i in active])
        for i, own in zip(active, slots, strict=True):
            at = used[i]
            used[i] += len(own)
            for first in range(at // frame * frame, used[i], frame):
                start, end = max(first, at), min(first + frame, used[i])
                if start < end:
                    rows.append((sources[i][0], first // frame, start, end, [base + t for t in own[start - at : end - at]]))
        base += sum(map(len, slots))
    return rows


def mix_sources(df: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block: int | None = None, source: str = "source", size: Column | None = None, key: str = "doc_id", seed: int = 17, frame: int = 1024) -> DataFrame:
    """df with __block (of its source), __slot (of the schedule) and __offset (within the block); (slot, offset) is the mixed order.

    weights: target weight of each source; by default its size to the power of temperature. Sources that weights leaves
    out, and rows without a source, share the weight of the smallest one given. size: of a row, in the units of block;
    default is the text's characters, and every row counts as 1 at least. A row longer than a block takes up the blocks it
    covers. block: BLOCK, or more on tables of more than BLOCKS of them, by default. Within a source, rows come in the order of a
    seeded hash of all columns but maps, so null and repeated keys spread like any other; rows alike in all columns are side by side.
    The driver gets one row a source and makes the schedule: one integer a block, in rows of `frame` blocks. Its time grows with
    the blocks and, as a phase ends with each source, with the square of the number of sources. Rows are numbered in ranges
    of the hash, more of them the larger the largest source is, so no task gets a whole source. Empty tables stay empty.
    """
    spark = df.sparkSession
    size = F.length("text") if size is None else size
    plain = [F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    name = F.col(source).cast("string")
    sized = df.withColumn("__size", F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(1)))
    sized = sized.withColumn("__hash", F.xxhash64(F.lit(seed), F.col(key), *plain)).withColumn("__source", F.coalesce(F.concat(F.lit("s"), name), F.lit("n")))
    totals = sized.groupBy("__source").agg(F.sum("__size").alias("n")).orderBy("__source").collect()
    block = block or max(BLOCK, -(-sum(r["n"] for r in totals) // BLOCKS))
    least = min(weights.values()) if weights else 1.0
    weight = lambda r: weights.get(r["__source"][1:] if r["__source"] != "n" else None, least) if weights else float(r["n"]) ** temperature
    plan = schedule([(r["__source"], -(-r["n"] // block), weight(r)) for r in totals], frame)
    # at most BLOCKS and a block a source; as an Arrow table, since rows in a list would start Python workers of their own beside those of functions
    kinds = [("__source", pa.string()), ("__frame", pa.int64()), ("__first", pa.int64()), ("__end", pa.int64()), ("__slots", pa.list_(pa.int64()))]
    table = pa.table({name: pa.array([row[k] for row in plan], kind) for k, (name, kind) in enumerate(kinds)})
    plan_df = F.broadcast(spark.createDataFrame(table))
    bits = min(24, max(6, (max((r["n"] for r in totals), default=0) // RANGE).bit_length()))
    sized = sized.withColumn("__range", F.shiftright("__hash", 64 - bits))
    parts = sized.groupBy("__source", "__range").agg(F.sum("__size").alias("__sum"))
    before = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("__source", "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__source", "__range").orderBy("__hash", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sized.withColumn("__run", F.sum("__size").over(within) - F.col("__size")).join(bases, ["__source", "__range"])
    at = F.col("__run") + F.col("__base")
    placed = run.withColumn("__block", F.floor(at / block)).withColumn("__offset", at % block).withColumn("__frame", F.floor(F.col("__block") / frame))
    placed = placed.join(plan_df, ["__source", "__frame"]).filter((F.col("__block") >= F.col("__first")) & (F.col("__block") < F.col("__end")))
    slot = F.element_at("__slots", (F.col("__block") - F.col("__first") + 1).cast("int"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], "__block", slot.alias("__slot"), "__offset")


def mixed_order(df: DataFrame, **options) -> DataFrame:
    """df's own columns in mixed order: rows are dealt by range of slots and sorted within partitions. Empty tables stay empty."""
    mixed = mix_sources(df, **options)
    return mixed.repartitionByRange("__slot", "__offset").sortWithinPartitions("__slot", "__offset").select(*[F.col(f"`{c}`") for c in df.columns])
