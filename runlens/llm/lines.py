"""Line dedup by winnowing over line hashes.

A run is the shortest sequence of lines from a given line on that has at least min_words words, or that sequence with further
lines, as long as no run from the next line on ends there too. So every sequence of at least min_words words is a union of runs
within it, and a match is deleted in its full length: a line goes exactly if some repeated sequence of at least min_words words
holds it. Runs are winnowed: the line with the smallest hash in the shortest run from a line is the fingerprint of all runs from
it, so two equal runs always select the same line. Fingerprints that occur once are dropped; at the others, the runs around
them are compared. Of each run the first place, by (doc_id, line), stays; lines of the later ones go. Blank lines aren't part of
runs and stay, except inside of runs. Lines are compared by their words, with white space collapsed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, salted_join, values

BASE = 0x9E3779B97F4A7C15


def runs_of(text: str | None, min_words: int) -> list[tuple[int, int, int, int, int, int]]:
    """(fingerprint, run hash, words, first line, last line, line of the fingerprint) of every run."""
    from xxhash import xxh64_intdigest

    if not text:
        return []
    at, hashes, sizes = [], [], []
    for k, line in enumerate(text.encode().split(b"\n")):
        if words := line.split():
            at.append(k)
            hashes.append(xxh64_intdigest(b" ".join(words)))
            sizes.append(len(words))
    n = len(at)
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.searchsorted(total, total[:-1] + min_words).tolist()  # the shortest run from i has lines i .. ends[i] - 1
    out: list[tuple[int, int, int, int, int, int]] = []
    power, prefix = [1], [0]
    for h in hashes:
        power.append(power[-1] * BASE & 0xFFFFFFFFFFFFFFFF)
        prefix.append((prefix[-1] * BASE + h) & 0xFFFFFFFFFFFFFFFF)
    least: list[int] = []  # indices of a rising sequence of hashes: the sliding minimum
    head, filled = 0, 0
    for i, e in enumerate(ends):
        if e > n:
            break
        while filled < e:
            while len(least) > head and hashes[least[-1]] > hashes[filled]:
                least.pop()
            least.append(filled)
            filled += 1
        while least[head] < i:
            head += 1
        last = ends[i + 1] - 1 if i + 1 < n else n
        for stop in range(e, max(e, last) + 1):
            run = (prefix[stop] - prefix[i] * power[stop - i]) & 0xFFFFFFFFFFFFFFFF
            out.append((hashes[least[head]], run, int(total[stop] - total[i]), at[i], at[stop - 1], at[least[head]]))
    return out


def repeated_lines(df: DataFrame, min_words: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_key, and the sorted numbers (from 0) of the lines that go, for documents that lose any.

    text_key tells rows with one doc_id apart by their text. Rows alike in both are one document. A run that overlaps its own first
    place is not a repeat. Null and empty texts, and an empty table, give no rows.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, k, *r) for d, k, t in zip(*map(values, batch.columns), strict=True) for r in runs_of(t, min_words)]
            wrap = lambda i: pa.array(np.array([r[i] for r in rows], dtype=np.uint64).view(np.int64))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), wrap(2), wrap(3), *(pa.array([r[i] for r in rows], pa.int32()) for i in (4, 5, 6, 7))], ["doc_id", "text_key", "mark", "run", "words", "first", "last", "spot"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).cast("string").alias("text"))
    runs = checkpoint(rows.mapInArrow(emit, "doc_id long, text_key long, mark long, run long, words int, first int, last int, spot int"))
    # a fingerprint meets another only at a second place; neighbouring runs share theirs
    spot = F.struct("doc_id", "text_key", "spot")
    twice = runs.groupBy("mark").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).filter("a <> b").select("mark")
    runs = salted_join(runs, twice, ["mark"], F.xxhash64("doc_id", "text_key")).drop("spot")
    runs = checkpoint(runs.withColumn("order", F.coalesce("doc_id", F.lit((1 << 63) - 1))))
    place = F.struct("order", "text_key", "first", "last")
    # the first place by grouping twice, as a run may hold a third of all rows: min() of four numbers keeps one row a task
    origin = runs.groupBy("run", "words").agg(F.min(place).alias("o"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("run", "words", "o")
    later = salted_join(runs, origin, ["run", "words"], F.xxhash64("doc_id", "text_key", "first"), how="inner")
    same = (F.col("o.order") == F.col("order")) & (F.col("o.text_key") == F.col("text_key"))
    later = later.filter(~same | (F.col("first") > F.col("o.last")))
    gone = later.select("doc_id", "text_key", F.explode(F.sequence("first", "last")).alias("line")).distinct()
    return gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def dedup_lines(df: DataFrame, min_words: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df without later repeated runs of lines, and __removed, the number of lines that went (0 for most).

    Null and empty texts stay as they are. A text all of whose lines went is empty.
    """

    gone = repeated_lines(df, min_words, text, doc_id).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("lines").alias("__lines"))
    both = df.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__key")), "left")
    both = both.withColumn("__parts", F.when(F.col("__lines").isNotNull(), F.split(text, "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), "__lines")
    new = F.array_join(F.transform(kept, lambda i: F.get("__parts", i)), "\n")
    both = both.withColumn("__new", F.when(F.col("__lines").isNotNull(), new).otherwise(F.col(text)))
    removed = F.coalesce(F.when(F.col("__lines").isNotNull(), F.size("__lines")), F.lit(0)).alias("__removed")
    return both.select(*[(F.col("__new").alias(c) if c == text else F.col(f"`{c}`")) for c in df.columns], removed)
