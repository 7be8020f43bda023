"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from runlens.llm import queries, spelling

SF = "/root/testdata/sf0.01"
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(docs, slip, min_length=5, min_count=3):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def near_pairs(words):
    """By deletions: two words within one edit share one of themselves without one code point, or one is that of the other."""
    shared = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shared[w[:i] + w[i + 1 :], i].add(w)
    found = {frozenset((a, b)) for own in shared.values() for a in own for b in own if a != b}  # replaced
    return found | {frozenset((w, w[:i] + w[i + 1 :])) for w in words for i in range(len(w)) if w[:i] + w[i + 1 :] in words}


def variants(counts):
    near = defaultdict(set)
    for pair in near_pairs(set(counts)):
        a, b = pair
        near[a].add(b)
        near[b].add(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def rows(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    out = queries.op12_spelling(spark, SF)
    assert {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}.items() <= dict(out.dtypes).items()
    assert rows(out) == variants(words_of(docs, True))


@pytest.mark.parametrize("max_bucket", [1, 4, 10_000])
def test_near_words_equal_brute_force(spark, max_bucket):
    """Dense words, of which many share each chunk, short ones, long ones and code points of two bytes."""
    rng = random.Random(1)
    made = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(900)} | {"", "a", "x" * 500, "x" * 501, "x" * 250 + "y" + "x" * 250, "x" * 499 + "z"}
    frame = spark.createDataFrame([(w,) for w in made] + [(None,)], "word string").repartition(6)
    got = [(r.x, r.y) for r in spelling.near_words(frame, max_bucket).collect()]
    assert len(got) == len({frozenset(p) for p in got}) and {frozenset(p) for p in got} == near_pairs(made - {""}) | {frozenset(("", w)) for w in made if len(w) == 1}


def test_odd_documents(spark):
    docs = [(1, "Colour colour COLOUR colour colours\u00d7 \u00c9t\u00e9s \u00c9t\u00e9s \u00c9t\u00e9s"), (1, "Colour colour COLOUR colour"), (None, "color color color colr"), (None, None), (3, ""), (4, "12 _ \n"), (5, "colours colourss colourss colourss " * 3 + "abcde" * 20_000 + " ") , (6, ("q" * 30_000 + " ") * 3)]
    frame = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, n int, word string")
    for slip in (False, True):
        assert rows(spelling.spelling_variants(frame, one_in=97 if slip else None)) == variants(words_of(docs, slip))
    assert rows(spelling.spelling_variants(frame.limit(0))) == set()
