"""Lexical search against a plain scorer."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from runlens.llm import queries, search

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(items, docs, k=10):
    own = [(d, Counter(t), len(t)) for d, text in docs if (t := terms(text))]
    n_docs, total = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
    out = []
    for item, text in sorted(set(items), key=str):
        wanted, scored = Counter(terms(text)), []
        for d, c, n in own:
            m = 25 + (75 * n * n_docs) // total
            score = sum(q * w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in wanted.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_query_equals_plain_scorer(spark):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    out = queries.op11_search(spark, SF)
    assert dict(out.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert rows(out) == plain(items, docs)


def test_odd_texts_ties_repeats_and_blocks(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "É", "日本", "ß7", "²", "a\u0300"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(("", "!", "-X", "\n")) for _ in range(n))
    docs = [(i, text(rng.randint(0, 30))) for i in range(300)]
    docs += [(i, "tie of equals w1") for i in range(1000, 1030)] + [(1001, "tie of equals w1"), (None, "tie of equals w1"), (None, None), (5, None), (6, ""), (7, " \t.!"), (8, "Very w2 " * 40_000)]
    items = [(i, text(rng.randint(0, 12))) for i in range(60)] + [(70, "tie"), (70, "tie"), (70, "equals w1"), (None, "w2 W2 w2"), (71, None), (72, ""), (73, "unknown"), (74, "w3 " * 3000)]
    frame = spark.createDataFrame([(*d, 1, 2.0) for d in docs], "doc_id long, text string, rank int, score double").repartition(5)
    wanted = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    want = plain([i for i in items if terms(i[1])], docs)
    assert rows(search.ranked_search(wanted, frame)) == want
    assert rows(search.ranked_search(wanted, frame, block_terms=300)) == want
    assert rows(search.ranked_search(wanted, frame.limit(0))) == rows(search.ranked_search(wanted.limit(0), frame)) == []


def test_bounds_prune_and_lose_nothing():
    """On clustered documents most are never scored, and the best are those of all scores."""
    rng = np.random.default_rng(2)
    n_docs, n_terms = 4096, 600
    docs = np.repeat(np.arange(n_docs), 12)
    tids = (rng.integers(0, 60, n_docs)[docs] * 10 + rng.integers(0, 10, len(docs))).astype(np.int64)
    pair = np.unique(np.c_[docs, tids], axis=0)
    docs, tids = pair.T
    impacts, w = rng.integers(1, 1000, len(docs)), rng.integers(1, 50, n_terms)
    levels, place = search.document_tree(tids, docs, impacts, w, n_docs)
    items = [(np.arange(c * 10, c * 10 + 10), np.ones(10, np.int64)) for c in range(0, 60, 3)]
    read, scores = [], search.Level.scores

    class Counted(search.Level):
        def scores(self, tids, weights, first, width):
            read.append(len(first) * width)
            return scores(self, tids, weights, first, width)

    levels[0].__class__ = Counted
    best = search.Best(len(items), 10)
    search.search_trees(search.item_tree(items), levels, len(levels) - 1, np.arange(levels[-1].n_nodes), best, w, np.arange(n_docs)[place], np.zeros(n_docs, bool))
    for k, (own, counts) in enumerate(items):
        dense = np.zeros(n_docs, np.int64)
        mine = np.isin(tids, own)
        np.add.at(dense, docs[mine], w[tids[mine]] * impacts[mine])
        top = np.lexsort((np.arange(n_docs), -dense))[:10]
        assert best.ids[k].tolist() == top.tolist() and best.scores[k].tolist() == dense[top].tolist()
    assert sum(read) < len(items) * n_docs / 4
