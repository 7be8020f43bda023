"""Ranked lexical search: hierarchies over items and over documents hold coordinate maxima, and bounds of node pairs prune exactly."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, values

#: Code points that end a term, as bytes, and the lower case of A-Z. All bytes of other code points than ASCII belong to terms.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Items of a block hold about this many terms together, so that block, vocabulary and hierarchy are of bounded size.
BLOCK_TERMS = 200_000
LEAF, FANOUT, ITEM_LEAF, ITEM_FANOUT = 32, 8, 8, 4
#: Postings of documents that are made into one hierarchy.
TREE_POSTINGS = 1_000_000


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of a-z, 0-9 and all code points from U+0080, only A-Z in lower case."""
    return text.translate(TABLE).split()


def count_postings(docs: DataFrame, terms: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, tids, tfs) of documents with at least one term: how many they have, and occurrences of those in `terms`."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = []
            for t in values(batch.column(1)):
                found = terms_of(t) if t else []
                own = Counter(found)
                met = own.keys() & known.keys()
                rows.append((len(found), [known[k] for k in met], [own[k] for k in met]))
            ns, tids, tfs = zip(*rows, strict=True) if rows else ((), (), ())
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(tids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "tids", "tfs"])
            yield made.filter(pa.compute.greater(made.column(1), 0))

    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return plain.mapInArrow(counted, "doc_id long, n long, tids array<int>, tfs array<long>")


class Level:
    """Coordinate maxima of nodes, by term: rows of term t are at[t] to at[t + 1], each a node and its maximum."""

    def __init__(self, tids: np.ndarray, nodes: np.ndarray, maxima: np.ndarray, n_terms: int, n_nodes: int):
        order = np.lexsort((nodes, tids))
        tids, nodes, maxima = tids[order], nodes[order], maxima[order]
        first = np.flatnonzero(np.r_[True, (np.diff(tids) != 0) | (np.diff(nodes) != 0)]) if len(tids) else np.zeros(0, np.int64)
        self.maxima = np.maximum.reduceat(maxima, first) if len(first) else maxima
        self.tids, self.nodes, self.n_nodes = tids[first], nodes[first], n_nodes
        self.at = np.searchsorted(self.tids, np.arange(n_terms + 1))

    def bounds(self, tids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For every node the sum of weights times maxima, in 64-bit integers: no score of a document below it is greater."""
        out = np.zeros(self.n_nodes, np.int64)
        for t, w in zip(tids.tolist(), weights.tolist(), strict=True):
            a, b = self.at[t], self.at[t + 1]
            out[self.nodes[a:b]] += w * self.maxima[a:b]  # a term has a node once
        return out

    def scores(self, tids: np.ndarray, weights: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the ranges of `width` from each of first, and their sums of weights times maxima; only rows in these ranges are read."""
        at = np.arange(len(first))
        out = np.zeros(len(first) * width, np.int64)
        for t, w in zip(tids.tolist(), weights.tolist(), strict=True):
            nodes = self.nodes[self.at[t] : self.at[t + 1]]
            lo, hi = np.searchsorted(nodes, first), np.searchsorted(nodes, first + width)
            n = hi - lo
            rows = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            out[np.repeat(at * width - first, n) + nodes[rows]] += w * self.maxima[self.at[t] + rows]
        return (first[:, None] + np.arange(width)).ravel(), out

    def above(self, fanout: int, n_terms: int) -> Level:
        return Level(self.tids, self.nodes // fanout, self.maxima, n_terms, -(-self.n_nodes // fanout))


def document_tree(tids: np.ndarray, docs: np.ndarray, impacts: np.ndarray, w: np.ndarray, n_docs: int) -> tuple[list[Level], np.ndarray]:
    """Levels from single documents to at most FANOUT nodes, and the order of documents in them: those with one heaviest term lie together."""
    order = np.lexsort((tids, -(w[tids] * impacts), docs))
    heads = np.full(n_docs, len(w))
    heads[docs[order][::-1]] = tids[order][::-1]
    place = np.argsort(heads, kind="stable")
    rank = np.empty(n_docs, np.int64)
    rank[place] = np.arange(n_docs)
    levels = [Level(tids, rank[docs], impacts, len(w), n_docs)]
    levels.append(levels[0].above(LEAF, len(w)))
    while levels[-1].n_nodes > FANOUT:
        levels.append(levels[-1].above(FANOUT, len(w)))
    return levels, place


def item_tree(items: list[tuple[np.ndarray, np.ndarray]]) -> list:
    """Nodes (children or None, items below, terms, largest count of each), from the root; items that hold the same rare term lie together.

    items: their terms, ordered by weight, the heaviest first, and how often each occurs.
    """
    nodes = [(None, [k], *items[k]) for k in sorted(range(len(items)), key=lambda k: items[k][0].tolist())]
    size = ITEM_LEAF
    while len(nodes) > 1:
        groups = [nodes[a : a + size] for a in range(0, len(nodes), size)]
        nodes = []
        for g in groups:
            tids = np.concatenate([n[2] for n in g])
            counts = np.concatenate([n[3] for n in g])
            level = Level(tids, np.zeros(len(tids), np.int64), counts, int(tids.max()) + 1 if len(tids) else 0, 1)
            nodes.append((g, [k for n in g for k in n[1]], level.tids, level.maxima))
        size = ITEM_FANOUT
    return nodes[0]


class Best:
    """The k best (score, doc_id) of each item so far; equal scores by ascending doc_id, null last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * n_items
        self.ids = [np.zeros(0, np.int64)] * n_items
        self.nulls = [np.zeros(0, bool)] * n_items
        self.kth = np.ones(n_items, np.int64)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        s, i, z = np.r_[self.scores[item], scores], np.r_[self.ids[item], ids], np.r_[self.nulls[item], nulls]
        top = np.lexsort((i, z, -s))[: self.k]
        self.scores[item], self.ids[item], self.nulls[item] = s[top], i[top], z[top]
        if len(top) == self.k:
            self.kth[item] = s[top[-1]]


def search_trees(node: tuple, levels: list[Level], at: int, open_: np.ndarray, best: Best, w: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
    """Dual-tree search of the items below node in the nodes open_ of levels[at].

    A pair of nodes whose bound is below the weakest kth score of its items is left, and all pairs below it: bounds that equal it stay, as
    equal scores are settled by doc_id. Single items look into leaves in falling order of their bounds.
    """
    children, below, tids, counts = node
    weights = w[tids] * counts
    bound = levels[at].bounds(tids, weights)[open_]
    open_ = open_[bound >= best.kth[below].min()]
    if not len(open_):
        return
    if at > 1:
        fan = FANOUT
        open_ = (open_[:, None] * fan + np.arange(fan)).ravel()
        open_ = open_[open_ < levels[at - 1].n_nodes]
        for child in children or (node,):
            search_trees(child, levels, at - 1, open_, best, w, ids, nulls)
    elif children:
        for child in children:
            search_trees(child, levels, at, open_, best, w, ids, nulls)
    else:
        item = below[0]
        bound = levels[1].bounds(tids, weights)
        leaves = open_[np.argsort(-bound[open_], kind="stable")]
        a, size = 0, FANOUT
        while a < len(leaves):
            some = leaves[a : a + size]
            some = some[bound[some] >= best.kth[item]]
            if not len(some):
                return
            docs, scores = levels[0].scores(tids, weights, some * LEAF, LEAF)  # a document's own maxima: exact scores
            high = scores >= best.kth[item]
            best.add(item, scores[high], ids[docs[high]], nulls[docs[high]])
            a, size = a + size, 2 * size


def search_block(postings: DataFrame, items: list[list[tuple[int, int]]], w: np.ndarray, n_docs: int, n_terms: int, k: int, start: np.ndarray | None) -> DataFrame:
    """(item, doc_id, score): each task's k best documents for every item (terms and their counts), of those that reach `start`, a score that k documents have."""
    shared = postings.sparkSession.sparkContext.broadcast((items, w, start))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w, start = shared.value
        heavy = [sorted(own, key=lambda t: (-w[t[0]], t[0])) for own in items]
        root = item_tree([(np.array([t for t, _ in own], np.int64), np.array([c for _, c in own], np.int64)) for own in heavy])
        best = Best(len(items), k)
        if start is not None:
            best.kth = start.copy()
        for batch in batches:
            for part in parts_of(batch):
                ids, nulls, n, sizes, tids, tfs = part
                m = 25 + (75 * n * n_docs) // n_terms
                docs = np.repeat(np.arange(len(n)), sizes)
                impacts = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[docs])
                levels, place = document_tree(tids, docs, impacts, w, len(n))
                top = len(levels) - 1
                search_trees(root, levels, top, np.arange(levels[top].n_nodes), best, w, ids[place], nulls[place])
        for item in range(len(items)):
            if len(best.scores[item]):
                ids = pa.array(best.ids[item], pa.int64(), mask=best.nulls[item])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, np.int32)), ids, pa.array(best.scores[item])], ["item", "doc_id", "score"])

    return postings.mapInArrow(searched, "item int, doc_id long, score long")


def parts_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts of a batch of at most about TREE_POSTINGS postings: ids, which are null, n, numbers of postings, terms and occurrences."""
    lists = batch.column(2)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TREE_POSTINGS, "right")))
        part = batch.slice(a, b - a)
        ids = part.column(0)
        nulls = ids.is_null().to_numpy(zero_copy_only=False)
        number = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
        yield pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False), nulls, part.column(1).to_numpy(), sizes[a:b], number(2), number(3)
        a = b


def top_rows(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank, first of salted parts, as an item has k rows from every task."""
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    some = found.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))).withColumn("rank", rank("item", "__salt")).filter(F.col("rank") <= k)
    return some.withColumn("rank", rank("item")).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def ranked_search(items: DataFrame, docs: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of all with the highest score above 0 for each item, equal scores by ascending doc_id.

    Scores are those of a lexical ranking with saturated occurrences and document lengths, in 64-bit integers: with N documents that have
    terms, L terms in all, n of a document, df documents with a term and tf occurrences in one, a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), and a
    document scores the sum over the item's terms, repeats included, of w * (10^9 tf div (1000 tf + 8 m)), where m = 25 + (75 n N) div L.

    Items are searched in blocks of about block_terms terms, so that what is broadcast, and what the driver holds of them, is bounded. Documents are read once a
    block; N, L and df count all of them. Each task makes hierarchies of its documents and of the block's items, with
    coordinate maxima, and leaves pairs of nodes whose bound is below the weakest kth score of the node's items. What a first sample of one
    task in a hundred finds is where all tasks start: those are real scores of k documents, so nothing is lost by them.

    Null or empty texts have no terms: such documents are none of N, such items give no rows. Items that are alike in id and text are one; several texts of one id are ranked each.
    Repeated documents are documents each; without doc_id they come last among equals. Very long texts are used whole. No items or no documents give no rows.
    """
    spark = docs.sparkSession
    wanted = checkpoint(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).filter("text is not null").distinct())
    terms = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(terms / 5 / block_terms))
    out = None
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        own = [(r.item_id, Counter(terms_of(r.text.encode()))) for r in rows]
        own = [(i, c) for i, c in own if c]
        if not own:
            continue
        known = {t: k for k, t in enumerate(sorted(set().union(*(c for _, c in own))))}
        postings = checkpoint(count_postings(docs, known, doc_id, text))
        n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(known), np.int64)
        for t, n in postings.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count(F.lit(1))).collect():  # at most one row a term of the block
            df[t] = n
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        vectors = [[(known[t], c) for t, c in counts.items()] for _, counts in own]
        sample = search_block(postings.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(100)) == 0), vectors, w, n_docs, n_terms, k, None)
        kth = top_rows(sample, k).filter(F.col("rank") == k).select("item", "score").collect()  # at most one row an item of the block
        start = np.ones(len(own), np.int64)
        for item, score in kth:
            start[item] = score
        names = spark.createDataFrame([(i, None if own[i][0] is None else int(own[i][0])) for i in range(len(own))], "item int, item_id long")
        found = top_rows(search_block(postings, vectors, w, n_docs, n_terms, k, start), k)
        best = checkpoint(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def lexical_sql() -> str:
    return r"""
with pat as (select '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' as p),
own as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p) as terms from documents, pat where text is not null),
docs as (select doc_id, len(terms) as n, terms from own where len(terms) > 0),
total as (select count(*) as nn, sum(n)::bigint as ll from docs),
tf as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(terms) as term from docs) group by all),
df as (select term, count(*) as df from tf group by term),
items as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p)) as term from benchmark, pat),
scored as (
  select i.item_id, t.doc_id,
    sum(floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::bigint as score
  from items i join tf t using (term) join df using (term), total group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from scored where score > 0)
select item_id, r::integer as rank, doc_id, score from ranked where r <= 10
"""
