"""Approximate nearest neighbours: a forest of random-projection trees searched through a shared priority queue.

Trees are fitted on a bounded sample and cut at medians of random projections; every row is then indexed by its leaf in
each tree. A query descends all trees through one queue ordered by the margin to the hyperplanes it crossed, until the
leaves it reached hold the wanted share of the sample. Depth and share are the deepest trees and the smallest share that find
the wanted part of the sample's own neighbours, so clustered vectors are searched in few small leaves and vectors without
structure nearly whole. Its leaves' rows are compared exactly, in blocks, each in the first tree that reaches it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint


class Forest:
    """Complete binary trees of `depth` levels: a direction and a cut for each inner node, sample rows for each leaf."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        n, dim = sample.shape
        inner = (1 << depth) - 1
        self.depth, self.n = depth, n
        self.axes = rng.standard_normal((trees, inner, dim))
        self.axes /= np.linalg.norm(self.axes, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, inner))
        self.leaves: list[list[np.ndarray]] = []
        for t in range(trees):
            held = [np.arange(n)]
            for level in range(depth):
                below = []
                for k, rows in enumerate(held):
                    node = (1 << level) - 1 + k
                    p = sample[rows] @ self.axes[t, node]
                    self.cuts[t, node] = np.median(p) if len(p) else 0.0
                    right = p > self.cuts[t, node]
                    below += [rows[~right], rows[right]]
                held = below
            self.leaves.append(held)

    def place(self, x: np.ndarray) -> np.ndarray:
        """(n, trees): leaf numbers."""
        out = np.zeros((len(x), len(self.axes)), dtype=np.int64)
        for t in range(len(self.axes)):
            side = x @ self.axes[t].T > self.cuts[t]
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + side[np.arange(len(x)), node]
            out[:, t] = node - len(self.cuts[t])
        return out

    def search(self, q: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs in the order of the queue until their leaves hold that share of the sample."""
        margins = np.einsum("tnd,d->tn", self.axes, q) - self.cuts
        queue = [(0.0, t, 0) for t in range(len(self.axes))]
        seen, count, out, inner = np.zeros(self.n, dtype=bool), 0, [], self.cuts.shape[1]
        while queue and count < share * self.n:
            worst, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t, node]
                near = 2 * node + 1 + (m > 0)
                heapq.heappush(queue, (max(worst, abs(m)), t, 4 * node + 3 - near))
                node = near
            leaf = node - inner
            out.append((t, leaf))
            rows = self.leaves[t][leaf]
            count += int((~seen[rows]).sum())
            seen[rows] = True
        return out


def calibrated(sample: np.ndarray, trees: int, k: int, found: float, leaves: int, seed: int, asked: int = 100) -> tuple[Forest, float]:
    """The forest with the deepest trees whose queries reach at most `leaves` leaves on average, and the smallest share of rows that
    holds `found` of the k nearest of up to `asked` rows of the sample, the nearest by brute force."""
    n = len(sample)
    pick = np.random.default_rng(seed).choice(n, min(asked, n), replace=False)
    scores = sample[pick] @ sample.T
    scores[np.arange(len(pick)), pick] = -np.inf
    k = min(k, n - 1)
    near = np.argpartition(-scores, max(0, k - 1), axis=1)[:, :k] if k else np.zeros((len(pick), 0), int)
    best = None
    for depth in range(0, max(0, round(math.log2(max(1, n / 16)))) + 1):
        forest, needed, reached = Forest(sample, trees, depth, seed), [], []
        for q, nearest in zip(pick, near, strict=True):
            order = forest.search(sample[q], 1.0)
            at, seen, count = np.full(n, np.inf), np.zeros(n, dtype=bool), []
            for t, leaf in order:
                rows = forest.leaves[t][leaf]
                fresh = rows[~seen[rows]]
                seen[fresh] = True
                count.append((count[-1] if count else 0) + len(fresh))
                at[fresh] = count[-1] / n
            needed.append(at[nearest])
            reached.append(np.array(count) / n)
        share = float(np.quantile(np.concatenate(needed), found, method="higher")) if k else 1.0
        if best and np.mean([np.searchsorted(c, share) + 1 for c in reached]) > leaves:
            break
        best = forest, share
    return best


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def nearest_neighbours(df: DataFrame, every: int = 20, k: int = 20, found: float = 0.96, share: float | None = None, trees: int = 6, sample: int = 10_000, leaves: int = 64, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found, by inner product, of each row whose id is divisible by `every`.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id or with another
    number of dimensions than most. An empty table gives no rows. The forest is fitted on at most `sample` rows (the smallest hashes of
    ids), every row is indexed. Equal vectors are one entry with its k + 1 smallest ids, which is all a query can return, so copies cost
    nothing; they rank by id. found: part of the sample's neighbours that its own search has to find, which sets the share of
    rows that a query compares, unless share gives it. leaves: that a query reaches on average, at most, which sets the depth. Rows of a leaf and queries of it
    are split into blocks of about 20,000.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad).filter(F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes[0]["d"]
    rows = rows.filter(F.size("v") == dim)
    copies = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("place", F.row_number().over(copies)).filter(F.col("place") <= k + 1)  # the limit is applied before the shuffle too
    entries = checkpoint(kept.groupBy("v").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = entries.count()
    fitted = np.array([r["v"] for r in entries.orderBy(F.xxhash64("node"), "node").select("v").limit(sample).collect()])
    model, least = calibrated(fitted, trees, k, found, leaves, seed)
    share = least if share is None else share
    forest = spark.sparkContext.broadcast(model)  # bounded by sample and trees
    size = 1 << model.depth
    blocks = max(1, -(-n // (size * 20_000)))
    query_blocks = max(1, -(-n // (every * 20_000)))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                leaf = forest.value.place(_matrix(b["v"]))
                for t in range(trees):
                    for part in range(query_blocks):
                        yield pd.DataFrame({"tree": t, "leaf": leaf[:, t], "block": b["node"] % blocks, "part": part, "node": b["node"], "leaves": list(leaf), "v": b["v"]})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q, v in zip(b["node"], b["v"], strict=True):
                reached = forest.value.search(np.asarray(v), share)
                marks = np.zeros((trees, size), dtype=bool)
                marks[tuple(np.array(reached).T)] = True
                packed = np.packbits(marks).tobytes()
                rows += [(t, leaf, block, q % query_blocks, q, packed, v) for t, leaf in reached for block in range(blocks)]
            yield pd.DataFrame(rows, columns=["tree", "leaf", "block", "part", "query", "reached", "q"])

    def compare(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """The best of a leaf's rows for each query that reaches it, without rows that an earlier tree has shown to it."""
        out = []
        if len(queries) and len(held):
            x, ids, placed = _matrix(held["v"]), held["node"].to_numpy(), np.stack(held["leaves"].to_list())
            tree, longest = int(held["tree"].iloc[0]), np.linalg.norm(x, axis=1).max()
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                q = _matrix(part["q"])
                marks = np.unpackbits(np.frombuffer(b"".join(part["reached"]), np.uint8).reshape(len(part), -1), axis=1)[:, : trees * size].reshape(len(part), trees, size)
                fresh = np.ones((len(part), len(ids)), dtype=bool)
                for t in range(tree):
                    fresh &= marks[:, t][:, placed[:, t]] == 0
                rough = np.full(fresh.shape, -np.inf)
                if fresh.mean() > 0.5:
                    rough[fresh] = (q @ x.T)[fresh]
                else:
                    for i, own in enumerate(fresh):
                        rough[i, own] = x[own] @ q[i]
                m = min(len(ids), k + 1)
                # scores that round alike at the edge are all kept
                edge = np.partition(rough, len(ids) - m, axis=1)[:, len(ids) - m] - 1e-12 * np.linalg.norm(q, axis=1) * longest
                i, j = np.nonzero(fresh & (rough >= edge[:, None]))
                out.append(pd.DataFrame({"query": part["query"].to_numpy()[i], "node": ids[j], "score": (q[i] * x[j]).sum(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "node": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    vectors = entries.select("node", "v").mapInPandas(index, "tree int, leaf int, block long, part int, node long, leaves array<long>, v array<double>")
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    heads = entries.select("v", "node", F.explode("ids").alias("id")).filter(F.col("id") % every == 0).select("node", "v").distinct()
    # a vector with many copies may hold queries only beyond its first ids
    heads = heads.union(asked.join(entries.filter(F.size("ids") > k).select("v", "node"), "v").select("node", "v")).distinct()
    queries = heads.mapInPandas(route, "tree int, leaf int, block long, part int, query long, reached binary, q array<double>")
    by = ["tree", "leaf", "block", "part"]
    pairs = queries.groupBy(*by).cogroup(vectors.groupBy(*by)).applyInPandas(compare, "query long, node long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    pairs = pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    # copies of the found vectors, then each query without itself
    listed = pairs.join(entries.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = checkpoint(listed.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r"))
    of = asked.join(entries.select("v", F.col("node").alias("query")), "v").select("query_id", "query")
    answers = of.join(listed, "query").filter(F.col("vec_id") != F.col("query_id"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
