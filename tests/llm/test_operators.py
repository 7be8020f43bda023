"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import bpe, fingerprints, licenses, lines, mixing, neighbours, quality, queries, simhash, token_files

SF = "/root/testdata/sf0.01"
DOCS = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids int, rank int, component_id string, keep string"
ODD = [
    (1, "one two three four five six", "en", "a", 27, 1, 1, "x", "y"),
    (1, "one two three four five six", "en", "a", 27, 1, 1, "x", "y"),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "de", "b", 0, 1, 1, "x", "y"),
    (4, " \n\t ", "de", None, 4, 1, 1, "x", "y"),
    (None, "no id here <|endoftext|> end", "fr", "b", 20, 1, 1, "x", "y"),
    (None, None, "fr", "b", 20, 1, 1, "x", "y"),
    (5, "long " * 60_000 + "Released under the MIT License.", "en", "a", 300_000, 1, 1, "x", "y"),
    (6, "same line of words again and again\n" * 300, "en", "a", 10, 1, 1, "x", "y"),
    (7, "日本語 🙂  text\x00with odd \x1c spaces", "en", "c", 10, 1, 1, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def components(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


# 1 mixing


def edf(weights, left):
    """Slot by slot, by exact fractions: the released block with the earliest deadline, ties to the first source."""
    out, done, base = [], [0] * len(left), 0
    while any(n - d for n, d in zip(left, done)):
        active = [i for i, n in enumerate(left) if n - done[i]]
        total, begun, t = sum(weights[i] for i in active), [0] * len(left), 0
        while all(n > done[i] + begun[i] for i, n in enumerate(left) if i in active):
            ready = [i for i in active if math.floor(begun[i] * total / weights[i]) <= t]
            i = min(ready, key=lambda i: (math.ceil((begun[i] + 1) * total / weights[i]), i))
            out.append(i)
            begun[i] += 1
            t += 1
        for i in active:
            done[i] += begun[i]
    return out


def ordered(rows):
    """Slot -> (source, block)."""
    return {t: (source, b) for source, _, first, end, slots in rows for b, t in zip(range(first, end), slots, strict=True)}


def test_schedule_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(40):
        n = rnd.randint(1, 9)
        left, weights = [rnd.randint(1, 60) for _ in range(n)], [Fraction(rnd.randint(1, 50), rnd.randint(1, 9)) for _ in range(n)]
        got = ordered(mixing.schedule([(f"s{i}", left[i], weights[i]) for i in range(n)], rnd.choice([1, 7, 64])))
        want = edf(weights, left)
        assert [got[t][0] for t in range(len(want))] == [f"s{i}" for i in want] and len(got) == len(want)
        for i in range(n):
            assert [b for _, (s, b) in sorted(got.items()) if s == f"s{i}"] == list(range(left[i]))


@pytest.mark.parametrize("weights", [[0.7, 0.2, 0.05, 0.03, 0.02], [1 / (k + 1) ** 2 for k in range(300)], [9.5, *[1.0] * 19]])
def test_schedule_keeps_within_one_block_of_target_weights(weights):
    total, slots = sum(map(Fraction, weights)), 100_000
    got = ordered(mixing.schedule([(i, math.ceil(slots * w / total) + 2, w) for i, w in enumerate(weights)], 4096))
    taken = [0] * len(weights)
    for t in range(slots):
        taken[got[t][0]] += 1
        if t % 997 == 0 or t == slots - 1:
            assert all(abs(n - (t + 1) * Fraction(w) / total) < 1 for n, w in zip(taken, weights)), t


def test_schedule_of_weight_zero():
    assert [(r[0], r[4]) for r in mixing.schedule([("a", 3, 1.0), ("z", 2, 0.0)], 64)] == [("a", [0, 1, 2]), ("z", [3, 4])]


def test_mixing_query_equals_brute_force(spark):
    """The query's slots are those of the slot-by-slot schedule of the sources' blocks, whatever the rows' order in a source."""
    out = queries.op1_mixing(spark, SF).collect()
    sizes = Counter()
    for _, text, _, source in DOCS:
        sizes[source] += max(1, len(text or ""))
    names = sorted(sizes, key=lambda s: (s is not None, s or ""))
    want = edf([Fraction(float(sizes[s]) ** 0.5) for s in names], [-(-sizes[s] // mixing.BLOCK) for s in names])
    count, slots = Counter(), {}
    for t, i in enumerate(want):
        slots[names[i], count[i]] = t
        count[i] += 1
    assert len(out) == len(DOCS)
    assert all(r["slot"] == slots[r["source"], r["source_block"]] for r in out)


def test_mixing_of_many_sources(spark):
    docs = spark.range(3 * 5000).selectExpr("id AS doc_id", "concat('s', id % 5000) AS source", "'some text' AS text")
    out = mixing.mix_sources(docs, block=9).select("source", "__slot").collect()
    assert sorted(r["__slot"] for r in out) == list(range(15_000)) and len({r["source"] for r in out}) == 5000


def test_mixing_keeps_rows_and_shares(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = {f"src{i}": 1.0 + (i % 3) for i in range(20)}
    out = mixing.mix_sources(docs, weights, block=4000).select("doc_id", "source", "__block", "__slot", "__offset", F.length("text").alias("n")).collect()
    assert sorted(r[0] for r in out) == sorted(d[0] for d in DOCS)
    assert len({(r["__slot"], r["__offset"]) for r in out}) == len(out)
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["__slot"], r["__offset"])):
        by[r["source"]].append((r["__block"], r["__offset"], r["n"]))
    for own in by.values():  # blocks hold consecutive characters of the source
        at = 0
        for block, offset, n in own:
            assert block * 4000 + offset == at
            at += n
    assert mixing.mixed_order(odd).count() == len(ODD) and mixing.mixed_order(odd).columns == odd.columns
    assert mixing.mixed_order(empty).count() == 0


# 2 BPE and 7 files


def test_bpe_equals_library(spark, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library, own, rnd = Tokenizer.from_file(path), bpe.Bpe(path), random.Random(1)
    alphabet = "aaabcde  \n\t\r '’sStTABé日本🙂  \x1c\x85019_%!.<|endoftext|>"
    for k in range(3000):
        x = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        x = x.replace("b", "<|endoftext|>") if k % 7 == 0 else x
        ids = np.frombuffer(own.encode(x), "<u4").tolist()
        assert ids == library.encode(x, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for table in (odd, empty):
        got = bpe.bpe_decode(bpe.bpe_encode(table.withColumnRenamed("ids", "other"), path), path).select("text", "ids", "decoded").collect()
        for r in got:
            assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    got = {r["doc_id"]: r for r in queries.op2_bpe(spark, SF).collect()}
    assert len(got) == len(DOCS)
    for d, t, *_ in DOCS:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_files(spark, odd, empty):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    got = {r["doc_id"]: r for r in queries.op7_token_files(spark, SF).collect()}
    for d, t, *_ in sorted(DOCS):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for table, n in ((odd, len(ODD)), (empty, 0)):
        folder = queries.new_folder(spark, "t")
        token_files.write_token_files(table, folder, queries.tokenizer_path(), end_id=2)
        rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r["start"])
        assert len(rows) == n and [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x or 0))
        want = Counter((d[0], *library.encode(d[1] or "", add_special_tokens=False).ids, 2) for d in (ODD if n else []))
        assert Counter((r["doc_id"], *np.frombuffer(r["ids"], "<u4").tolist()) for r in rows) == want


# 3 licences


def test_licenses(spark, empty):
    rows = [
        (1, "/a/b/c/x.py", "Released under the MIT License.\ncode code"),
        (2, "/a/b/c/y.py", "nothing"),
        (3, "/a/LICENSE", "some words\nLicensed under the Apache License, Version 2.0."),
        (4, "/a/b/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."),
        (5, "/a/z.py", "apache version license"),
        (6, "/q/z.py", None),
        (7, None, "licensed under cc by nc 4 0"),
        (8, "/a/b/c/d/e.py", "the terms of the work"),
        (8, "/a/b/c/d/e.py", "the terms of the work"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("licence", F.lit("clash"))
    got = {r["doc_id"]: (r["licence"], r["origin"], r["inherited_from"]) for r in licenses.scan_licenses(df, F.col("path")).collect()}
    assert got == {
        1: ("MIT", "notice", None),
        2: ("GPL-3.0", "inherited", "/a/b"),
        3: ("Apache-2.0", "notice", None),
        4: ("GPL-3.0", "notice", None),
        5: ("Apache-2.0", "inherited", "/a") if got[5][1] == "inherited" else got[5],
        6: (None, "none", None),
        7: ("CC-BY-NC-4.0", "notice", None),
        8: ("GPL-3.0", "inherited", "/a/b"),
    }
    assert licenses.scan_licenses(empty, F.lit("/x")).count() == 0


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software."""
HEADERS = {
    GRANT: "MIT",
    "MIT License": "MIT",
    "The MIT License (MIT)": "MIT",
    "_MIT License_": "MIT",
    "// SPDX-License-Identifier: MIT": "MIT",
    "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
    'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:': "MIT",
    '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0': "Apache-2.0",
    " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.": "GPL-3.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991": "GPL-2.0",
    "GNU GENERAL PUBLIC LICENSE": "GPL",
    "GNU LESSER GENERAL PUBLIC LICENSE": "LGPL",
    "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.": None,
    "BSD 2-Clause License\n\n" + BSD: "BSD-2-Clause",
    "Copyright 2020 A. Person\n\n" + BSD: "BSD-2-Clause",
    BSD + "\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.": "BSD-3-Clause",
    "The above copyright notice and this permission notice shall be included in\nall copies or substantial portions of the Software.": None,
    GRANT + "\n\nExcept as contained in this notice, the name of the X Consortium shall not be\nused in advertising or otherwise to promote the sale, use or other dealings\nin this Software without prior written authorization from the X Consortium.": "X11",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.": "0BSD",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "ISC",
    "# SPDX-License-Identifier: (MIT OR Apache-2.0)": "(MIT OR Apache-2.0)",
    "/* SPDX-License-Identifier: Apache-2.0 OR  MIT */": "Apache-2.0 OR MIT",
    "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0-only WITH Classpath-exception-2.0",
    "SPDX-License-Identifier: (MIT)": "MIT",
    "SPDX-License-Identifier: Nobody-1.0 OR Nothing": None,
    "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */": "MPL-2.0",
    "ISC License": "ISC",
    "Boost Software License - Version 1.0 - August 17th, 2003": "BSL-1.0",
    "License": None,
    "See the licence of the project for more.": None,
    "Lizenz mit Bedingungen": None,
    "This program is software that counts words": None,
}


def test_headers_as_they_stand_in_files(spark):
    filler = [(1000 + k, f"/d/{k}.py", f"def f{k}():\n\n    return the of this program to {k}") for k in range(60)]
    rows = [(k, f"/h/{k}/x.py", f"#!/bin/sh\n\n{text}\n\nint main() {{}}") for k, text in enumerate(HEADERS)]
    df = spark.createDataFrame(rows + filler, "doc_id long, path string, text string")
    got = {r["doc_id"]: r["licence"] for r in licenses.scan_licenses(df, F.col("path")).collect() if r["doc_id"] < 1000}
    assert {text: got[k] for k, text in enumerate(HEADERS)} == HEADERS


def test_anchors_lose_nothing():
    idf, unknown, vectors, anchors = licenses.weigh(1000, {"the": 900, "of": 800, "under": 500, "this": 700, "work": 10})
    by, named = defaultdict(dict), defaultdict(set)
    for name, k, t, w, is_name in vectors:
        by[name, k][t] = w
        if is_name:
            named[name, k].add(t)
    for key, own in by.items():  # a unit without anchors lacks a name or is too far away
        assert named[key] & set(anchors) or sum(w * w for t, w in own.items() if t not in anchors) < licenses.THRESHOLD**2


# 4 neighbours


def test_neighbours_recall_and_order(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    ids = np.array([r["vec_id"] for r in rows])
    got = defaultdict(list)
    for r in queries.op4_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        best = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        own = got[ids[q]]
        assert len(own) == 20 and all(abs(x[np.flatnonzero(ids == v)[0]] @ x[q] - sc) < 1e-12 for v, sc in own)
        assert own == sorted(own, key=lambda y: (-y[1], y[0]))
        hits += len({ids[i] for i in best} & {v for v, _ in own})
    assert hits / (20 * len(got)) >= 0.9


def test_neighbours_copies_and_odd_rows(spark):
    rows = [(i, [1.0, 2.0], "x") for i in range(0, 100)] + [(100, [0.0, 0.0], "x"), (120, None, "x"), (140, [None, 1.0], "x"), (160, [float("nan"), 1.0], "x"), (180, [5.0], "x"), (200, [-1.0, 0.5], "x"), (None, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(df, share=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert sorted(got) == [0, 20, 40, 60, 80, 200]
    assert got[0] == list(range(1, 21)) and got[20] == list(range(20)) and got[80] == list(range(20)) and got[200] == list(range(20))
    assert neighbours.nearest_neighbours(df.limit(0)).count() == 0


# 5 lines


def test_lines_equal_brute_force(spark, odd, empty):
    docs = [(d, t) for d, t, *_ in DOCS]
    gone = whole_matches(docs, 50)
    assert sum(map(len, gone.values())) > 50
    got = {r["doc_id"]: r for r in queries.op5_lines(spark, SF).collect()}
    for d, t in docs:
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d])
        # blank lines inside runs go with them
        assert got[d]["lines_removed"] == len(gone[d]) and got[d]["text_md5"] == hashlib.md5(left.encode()).hexdigest(), d
    out = lines.dedup_lines(odd)
    assert out.count() == len(ODD) and out.columns == [*odd.columns, "__removed"]
    assert out.filter("doc_id = 6").first()["__removed"] == 292
    assert out.filter("doc_id = 1 and __removed = 0").count() == 2
    assert lines.dedup_lines(empty).count() == 0


def whole_matches(docs, least):
    """Lines that lie in a sequence of at least `least` words with an earlier place, by comparing all places of each shortest run."""
    body = {d: [(k, tuple(x.split())) for k, x in enumerate((t or "").encode().split(b"\n")) if x.split()] for d, t in docs}
    places, gone = defaultdict(list), defaultdict(set)
    for d in sorted(body):
        own = body[d]
        for i in range(len(own)):
            n, e = 0, i
            while e < len(own) and n < least:
                n += len(own[e][1])
                e += 1
            if n < least:
                break
            key = tuple(w for _, w in own[i:e])
            for p, o in places[key]:
                if p == d and o + e - i > i:
                    continue
                stop = 0
                while i + stop < len(own) and o + stop < len(body[p]) and own[i + stop][1] == body[p][o + stop][1]:
                    stop += 1
                gone[d] |= set(range(own[i][0], own[i + stop - 1][0] + 1))
            places[key].append((d, i))
    return gone


def test_lines_extend_matches_to_their_ends(spark):
    line = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    rnd, docs = random.Random(11), []
    docs.append((0, "\n".join([line("a", 60), line("b", 40), line("x", 70)])))
    docs.append((1, "\n".join([line("p", 55), line("a", 60), line("b", 40), line("y", 70)])))
    docs.append((2, "\n".join([line("a", 60), line("b", 40), line("c", 5)])))
    pool = [line(f"l{i}_", rnd.randint(1, 45)) for i in range(14)]
    for d in range(3, 60):
        docs.append((d, "\n".join("" if rnd.random() < 0.1 else rnd.choice(pool) for _ in range(rnd.randint(1, 14)))))
    gone = whole_matches(docs, 50)
    assert gone[1] == {1, 2} and gone[2] == {0, 1} and sum(map(len, gone.values())) > 30
    out = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, t in docs:
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d])
        assert out[d]["text"] == left and out[d]["__removed"] == len(gone[d]), d
    real = [(d, t) for d, t, *_ in DOCS]
    gone = whole_matches(real, 50)
    assert {r["doc_id"]: r["lines_removed"] for r in queries.op5_lines(spark, SF).collect()} == {d: len(gone[d]) for d, _ in real}


# 6 language


def test_language_accuracy_on_held_out(spark, odd, empty):
    lang = {d: x for d, _, x, _ in DOCS}
    got = queries.op6_language(spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(DOCS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    from runlens.llm import language

    model = language.fit_language_model(odd)
    out = language.predict_language(odd, model).collect()
    assert len(out) == len(ODD) and [r["lang_pred"] for r in out if r["doc_id"] in (2, 3, 4)] == ["und"] * 3
    assert language.fit_language_model(empty) is None and language.predict_language(odd, None).filter("lang_pred <> 'und'").count() == 0


# 8 SimHash


def simhash_of(text, size):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), seed=42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_golay_code_is_perfect():
    assert len(set(simhash.corrections().tolist())) == 2048
    w = np.random.default_rng(0).integers(0, 1 << 23, 4000)
    k = simhash.golay_keys(w)
    for d in (1, 2):
        v = w.copy()
        for _ in range(d):
            v = v ^ (1 << np.random.default_rng(d).integers(0, 23, len(w)))
        assert all(set(a) & set(b) for a, b in zip(k.tolist(), simhash.golay_keys(v).tolist()))


def test_simhash_equals_brute_force(spark, odd, empty):
    got = {r["doc_id"]: r for r in queries.op8_simhash(spark, SF).collect()}
    docs = sorted(DOCS)
    fp = np.array([simhash_of(t, 3) for _, t, *_ in docs], dtype=np.uint64)
    assert [got[d[0]]["fingerprint"] for d in docs] == [f"{int(x):016x}" for x in fp]
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 2)
    comp = components(len(docs), zip(a.tolist(), b.tolist()))
    assert [got[d[0]]["component_id"] for d in docs] == [docs[c][0] for c in comp]
    out = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.simhash_components(odd).collect()}
    assert out[2, 0] == 2 and out[3, 0] == 2 and out[4, 0] == 2 and out[None, 0] == 2
    assert simhash.simhash_components(empty).count() == 0


def test_components_of_links_between_chains(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = []
    for b in base:  # chains whose ends are far apart
        for _ in range(25):
            b ^= 1 << rnd.randrange(64) | 1 << rnd.randrange(64)
            prints.append(b)
    nodes = sorted(set(prints))
    signed = [x - (1 << 64) if x >> 63 else x for x in nodes]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.bucket_links(simhash.fingerprint_keys(df), F.expr("bit_count(x.node ^ y.node) <= 2"), lambda p: p)
    got = {r["node"]: r["component"] for r in simhash.connected_components(links).collect()}
    x = np.array(nodes, dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 2)
    comp = components(len(nodes), zip(a.tolist(), b.tolist()))
    groups, own = defaultdict(set), defaultdict(set)
    for i, c in enumerate(comp):
        groups[c].add(signed[i])
        own[got.get(signed[i], signed[i])].add(signed[i])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_near_duplicates_find_edited_copies(spark, odd, empty):
    rnd, texts = random.Random(7), []
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    for g in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(80, 500))]
        texts.append(base)
        for _ in range(4):
            copy = list(base)
            for _ in range(max(1, len(base) // 60)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(copy)
    docs = [(i, " ".join(w)) for i, w in enumerate(texts)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    true = [(i, j) for g in range(0, 300, 5) for i in range(g, g + 5) for j in range(i + 1, g + 5) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    comp = components(len(docs), true)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(true) > 200 and sum(got[i] == comp[i] for i in got) / len(docs) > 0.98
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert out == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 6, 7: 7}
    assert simhash.near_duplicates(empty).count() == 0


def test_near_duplicates_find_every_edit_shape(spark):
    rnd = random.Random(13)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    more = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    texts, shapes = [], []
    for _ in range(100):
        base = more(rnd.randint(120, 600))
        k, cut = len(base), rnd.randrange(len(base) // 2)
        edits = {"cut": base[: k * 83 // 100], "appended": base + more(k // 5), "block": base[:cut] + more(k * 9 // 100) + base[cut + k * 9 // 100 :]}
        for shape, edited in edits.items():
            texts += [base, edited]
            shapes.append(shape)
    # each pair has a vocabulary of its own, so only the two meet
    docs = [(i, " ".join(f"{w}{i // 2}" for w in t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    pairs = [i for i in range(0, len(docs), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for shape in ("cut", "appended", "block"):
        own = [i for i in pairs if shapes[i // 2] == shape]
        found = sum(got[i + 1] == i for i in own) / len(own)
        print(shape, len(own), found)
        assert len(own) > 40 and found >= 0.97, shape
    assert all(got[i + 1] == i + 1 for i in range(0, len(docs), 2) if i not in pairs)


def test_near_dups_keep_one_row_of_each_group(spark):
    x, y, z = (" ".join(f"{w}{k}" for k in range(60)) for w in "xyz")
    rows = [(1, x), (2, x), (2, y), (3, y), (5, z), (5, z), (None, z), (None, "alone"), (None, "alone"), (7, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((tuple(r) for r in corpus_pipeline.near_dups(spark, docs, SF).collect()), key=str)
    assert out == sorted([(1, x), (2, y), (5, z), (None, "alone"), (7, "")], key=str)


# 9 fingerprints


def test_fingerprints(spark, odd, empty):
    docs = sorted(DOCS, reverse=True)
    rows = {r["doc_id"]: r for r in queries.op9_fingerprints(spark, SF).collect()}
    assert len(rows) == len(docs)
    errors, same = [], defaultdict(set)
    for k, (d, t, *_) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = rows[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        same[t].add(r["fingerprint"])
        for other, near in ((edited, r["near_edited"]), (after, r["near_next"])):
            a, b = (Counter(w for w in re.split(r"[ \t\n\x0b\f\r]+", x) if w) for x in (t, other))
            union = sum((a | b).values())
            errors.append(near - (sum((a & b).values()) / union if union else 1.0))
    assert all(len(x) == 1 for x in same.values())
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.07
    assert fingerprints.edited_fingerprints(odd).count() == len(ODD)
    assert fingerprints.edited_fingerprints(empty).count() == 0
    one = fingerprints.edited_fingerprints(odd.filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


# 10 quality


def test_quality_on_held_out(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rated = quality.graded(docs, labels)
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    out = quality.rate_quality(rated.filter(test), quality.fit_quality_model(rated.filter(~test))).collect()
    good = [r["tail_probability"] >= quality.CUT for r in out if r["grade"] == 2]
    junk = [r["tail_probability"] >= quality.CUT for r in out if r["grade"] == 1]
    assert np.mean(good) > 0.95 and np.mean(junk) < 0.35
    assert all(0 <= r["expected_grade"] <= 2 for r in out)
    own = corpus_pipeline.quality(spark, odd.withColumn("expected_grade", F.lit("mine")).withColumn("__keep", F.lit("too")), SF)
    assert {(r["keep"], r["expected_grade"], r["__keep"]) for r in own.filter("doc_id = 1").collect()} <= {("y", "mine", "too")} and own.columns == [*odd.columns, "expected_grade", "__keep"]
    none = quality.select_quality(odd, labels.limit(0))
    assert none.filter("keep").count() == len(ODD) and quality.select_quality(empty, labels).count() == 0
    assert quality.select_quality(odd, labels).count() == len(ODD)


def test_quality_model_equals_plain_likelihood():
    """Tails of the model are the sums of its grades' probabilities, and its fit lowers the mean negative log-likelihood that loops compute."""
    rnd = np.random.default_rng(2)
    texts = [" ".join(rnd.choice(["good", "fine", "bad", "junk", "the", "of"], 12, p=p)) for p in ([0.3, 0.3, 0.05, 0.05, 0.15, 0.15], [0.05, 0.05, 0.3, 0.3, 0.15, 0.15]) for _ in range(40)]
    grade = np.array([2] * 40 + [0] * 20 + [1] * 20)
    made = [quality.features()(t) for t in texts]
    index, value = np.concatenate([i for i, _ in made]), np.concatenate([v for _, v in made])
    ends = np.cumsum([len(i) for i, _ in made])

    def loss(model):
        total = 0.0
        for (i, v), y in zip(made, grade):
            s = sum(float(model.w[a]) * float(b) for a, b in zip(i, v))
            cut = [-math.inf, *model.t.tolist(), math.inf]
            below = [0.0 if c == -math.inf else 1.0 if c == math.inf else 1 / (1 + math.exp(s - c)) for c in cut]
            probabilities = [below[k + 1] - below[k] for k in range(3)]
            tail = model.tails(np.array([s]))[0]
            assert abs(sum(probabilities) - 1) < 1e-9 and abs(tail[0] - probabilities[1] - probabilities[2]) < 1e-6 and abs(tail[1] - probabilities[2]) < 1e-6
            total -= math.log(max(probabilities[y], 1e-9))
        return total / len(made)

    start = loss(quality.OrdinalModel(3))
    model = quality.OrdinalModel(3).fit(index, value, ends, grade, epochs=15, batch=20)
    assert loss(model) < 0.6 * start and model.t[0] <= model.t[1]


def test_language_network_equals_loops():
    from runlens.llm import language

    net = language.ByteCnn(["a", "b"], seed=5)
    x, _ = language.windows(("Das ist ein Text. " * 3).encode())
    e, w, out = net.p["e"], net.p["w"].reshape(max(language.WIDTHS), language.EMBED, -1), []
    for f in range(w.shape[2]):
        best = max(sum(float(e[x[0, at + o]] @ w[o, :, f]) for o in range(w.shape[0])) for at in range(x.shape[1] - w.shape[0] + 1))
        out.append(max(0.0, best + float(net.p["b"][f])))
    z = [sum(h * float(u) for h, u in zip(out, net.p["u"][:, c])) + float(net.p["c"][c]) for c in range(2)]
    want = np.exp(np.array(z) - max(z)) / np.exp(np.array(z) - max(z)).sum()
    assert np.allclose(net.predict(x)[0], want, atol=1e-4)


# pipeline


def test_pipeline_stages(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for table in (odd, empty):
        step = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, SF)
            assert step.columns == table.columns, name
            step.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.filter("not round_trip").count() == 0 and 0 < out.count() < docs.count()
    kept = corpus_pipeline.near_dups(spark, docs, SF)
    first = {}
    for d, t, *_ in sorted(DOCS):
        first.setdefault(t, d)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} <= set(first.values())


def test_pipeline_result_carries_the_mixed_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 5 = 0")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        corpus_pipeline.mixing(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "mixed").glob("part-*"))) > 2
    out = corpus_pipeline.bpe(spark, spark.read.parquet(str(tmp_path / "mixed")), SF).select("doc_id", "position").collect()
    mixed = mixing.mix_sources(docs, temperature=0.5).select("doc_id", "__slot", "__offset").collect()
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["position"])] == [r["doc_id"] for r in sorted(mixed, key=lambda r: (r["__slot"], r["__offset"]))]
    assert len({r["position"] for r in out}) == len(mixed)
