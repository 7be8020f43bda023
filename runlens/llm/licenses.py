"""License scan in DataFrame functions only: TF-IDF cosine to templates, then inheritance from the nearest directory above.

Every line and every block of lines between blank ones is a possible header or notice, and a licence file also counts as a whole. A
text takes the template with the largest cosine of TF-IDF vectors to one of these units, if that holds the names in the
template. Paragraphs that several licences share name none alone: only if a text has nothing of a licence's own, it is what all of
a set of them makes. An SPDX tag counts as its licence, or as its whole expression if that has an identifier known here. Document frequencies come from the whole corpus. Files without a notice of their
own inherit from the licence file in the nearest directory at or above theirs.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, salted_join

#: Titles, notices, headers and paragraphs of common licences, by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "0BSD": ["BSD Zero Clause License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "AGPL-3.0": ["GNU Affero General Public License version 3", "GNU AFFERO GENERAL PUBLIC LICENSE", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "Artistic-2.0": ["The Artistic License 2.0", "This package is free software; you may redistribute it and/or modify it under the terms of the Artistic License 2.0."],
    "BSD-2-Clause": ["BSD 2-Clause License", "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted. Licensed under the BSD 3-Clause License.", "BSD 3-Clause License", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["CC0 1.0 Universal", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0 Universal."],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    "GPL": ["GNU GENERAL PUBLIC LICENSE", "You should have received a copy of the GNU General Public License along with this program."],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL": ["GNU LESSER GENERAL PUBLIC LICENSE"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": ["Released under the MIT License.", "MIT License", "The MIT License (MIT)"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "The Unlicense"],
    "X11": ["Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."],
    "Zlib": ["zlib License", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}
#: Paragraphs that several licences have, which name none of them alone.
SHARED: dict[str, str] = {
    "+conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "+source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "+binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "+grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "+notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
}
#: What a text is that holds all of these paragraphs and nothing of a licence's own.
SETS: dict[str, list[str]] = {"BSD-2-Clause": ["+conditions", "+source", "+binary"], "MIT": ["+grant"]}
#: Terms that name a licence or its version; a unit has to hold all of those that a template has.
NAMES = {"affero", "apache", "artistic", "bsd", "boost", "cc", "cc0", "noncommercial", "sharealike", "nc", "sa", "eclipse", "gnu", "lesser", "isc", "mit", "mozilla", "unlicense", "zlib", "unencumbered"}
THRESHOLD = 0.7
SPLIT = "[^a-z0-9]+"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)"
#: Blank lines part the blocks of a text.
BLANK = r"\n[ \t\r\n]*\n"
#: A tag counts as a template of so many terms.
TAG_TERMS = 1000
TAG = r"(?i)spdx-license-identifier:[ \t]*(\(*[ \t]*[a-z0-9.+-]+(?:[ \t)]+(?:or|and|with)[ \t(]+[a-z0-9.+-]+)*[ \t]*\)*)"
OPERATORS = ("or", "and", "with")


def tag_ids() -> dict[str, str]:
    """The licence of each identifier in lower case."""
    return {name.lower() + tail: name for name in TEMPLATES for tail in ("", "-only", "-or-later")}


def template_terms() -> list[tuple[str, int, str, int]]:
    """(licence, number of its text, term, count)."""
    out = []
    for name, texts in (TEMPLATES | {k: [t] for k, t in SHARED.items()}).items():
        for k, text in enumerate(texts):
            words = [w for w in re.split(SPLIT, text.lower()) if w]
            out += [(name, k, w, words.count(w)) for w in sorted(set(words))]
    return out


def weigh(n: int, df: dict[str, int]) -> tuple[dict[str, float], float, list[tuple[str, int, str, float, int]], list[str]]:
    """Inverse document frequencies, that of unknown terms, unit template vectors with a mark of names, and anchors.

    A unit that holds none of a template's anchors has a cosine below THRESHOLD to it: the other terms' share of the
    template's norm bounds the cosine (Cauchy-Schwarz). One of a template's names is anchor enough, as units lack none.
    """
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for _, _, t, _ in template_terms()}
    unknown = math.log(1 + n) + 1
    vectors, anchors = [], set()
    held: dict[tuple[str, int], dict[str, float]] = {}
    for a, b, t, c in template_terms():
        held.setdefault((a, b), {})[t] = c * idf[t]
    for (name, k), own in held.items():
        norm = math.sqrt(sum(w * w for w in own.values()))
        vectors += [(name, k, t, w / norm, int(t in NAMES)) for t, w in own.items()]
        named = [t for t in own if t in NAMES]
        if named:
            anchors.add(max(named, key=lambda t: (idf[t], t)))
            continue
        left = 1.0
        for t, w in sorted(own.items(), key=lambda x: (-x[1], x[0])):
            if left < (THRESHOLD - 0.01) ** 2:
                break
            anchors.add(t)
            left -= (w / norm) ** 2
    return idf, unknown, vectors, sorted(anchors)


def literal_rows(df: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small DataFrame from literals."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]
    return df.sparkSession.range(1).select(F.inline(F.array(*structs)))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit_hits(tokens: Column, told: Column, idf: dict[str, float], unknown: float, vectors: list[tuple[str, int, str, float, int]]) -> Column:
    """Array of (licence, score, terms): the templates whose cosine to a unit of these tokens (empty ones don't count) is at least THRESHOLD.

    A unit that holds none of `told` has none. Only templates whose names the unit holds all, and whose terms in the unit
    have a large enough share of the template's norm (Cauchy-Schwarz), are multiplied. No unit leaves its row, so copies,
    and units that share their words with many templates, make no rows.
    """
    held: dict[tuple[str, int], list[tuple[str, float, int]]] = {}
    for licence, variant, t, tw, is_name in vectors:
        held.setdefault((licence, variant), []).append((t, tw, is_name))
    # literals by JSON: thousands of columns would take the driver long
    literal = lambda x, schema: F.from_json(F.lit(json.dumps(x)), schema)
    shapes = [{"licence": a, "terms": len(own), "names": [t for t, _, n in own if n], "ts": [t for t, *_ in own], "tws": [w for _, w, _ in own]} for (a, _), own in held.items()]
    templates = literal(shapes, "array<struct<licence:string,terms:int,names:array<string>,ts:array<string>,tws:array<double>>>")
    vocabulary, known = literal(list(idf), "array<string>"), literal(list(idf.values()), "array<double>")
    none = F.expr("cast(array() as array<struct<licence:string,score:double,terms:int>>)")
    weight = lambda v, t: F.coalesce(F.get(v["tws"], F.array_position(v["ts"], t).cast("int") - 1), F.lit(0.0))
    share = lambda v, terms: F.aggregate(terms, F.lit(0.0), lambda s, t: s + weight(v, t) * weight(v, t))
    fits = lambda terms: lambda v: F.forall(v["names"], lambda x: F.array_contains(terms, x)) & (share(v, terms) >= (THRESHOLD - 0.01) ** 2)

    def squares(words: Column) -> Column:
        """The sum of squared counts of all words."""
        start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))
        same = lambda s, x: F.when(s["last"] == x, s["n"]).otherwise(F.lit(0).cast("long"))
        return F.aggregate(F.array_sort(words), start, lambda s, x: F.struct(x.alias("last"), (same(s, x) + 1).alias("n"), (s["total"] + 2 * same(s, x) + 1).alias("total")), lambda s: s["total"])

    def scores(words: Column, terms: Column, near: Column) -> Column:
        counted = F.transform(terms, lambda t: F.struct(t.alias("t"), F.size(F.filter(words, lambda x: x == t)).alias("n"), F.get(known, F.array_position(vocabulary, t).cast("int") - 1).alias("idf")))

        def each(own: Column) -> Column:
            w = lambda x: x["n"] * x["idf"]
            rest = F.aggregate(own, squares(words), lambda s, x: s - x["n"].cast("long") * x["n"])
            norm = F.sqrt(F.aggregate(own, rest * F.lit(unknown * unknown), lambda s, x: s + w(x) * w(x)))
            score = lambda v, norm: F.round(F.aggregate(own, F.lit(0.0), lambda s, x: s + w(x) * weight(v, x["t"])) / norm, 6)
            all_ = once(norm, lambda n: F.transform(near, lambda v: F.struct(v["licence"].alias("licence"), score(v, n).alias("score"), v["terms"].alias("terms"))))
            return F.filter(all_, lambda h: h["score"] >= THRESHOLD)

        return once(counted, each)

    def judged(words: Column) -> Column:
        of_terms = lambda terms: once(F.filter(templates, fits(terms)), lambda near: F.when(F.size(near) > 0, scores(words, terms, near)).otherwise(none))
        return F.when(F.arrays_overlap(words, told), once(F.array_intersect(words, vocabulary), of_terms)).otherwise(none)

    return once(F.filter(tokens, lambda x: x != ""), judged)


def scan_licenses(df: DataFrame, path: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, path, licence, score, origin (`notice`, `inherited`, `none`) and inherited_from (directory) of every row of df.

    Paths have `/` between parts; null paths count as files of the root. Null and empty texts have no notice, and an empty table gives
    no rows. Of equal scores the
    template with more terms wins, then the first licence in alphabetical order; of a directory's licence files the best score, then the smallest path. Each row of
    a repeated key is judged by itself. Whole texts are scanned.
    """
    where = F.coalesce(path, F.lit("/"))
    files = df.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias(key), where.alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    terms = sorted({t for _, _, t, _ in template_terms()})
    vocabulary = F.array(*map(F.lit, terms))
    counts = df.select(F.explode(F.array_append(F.array_intersect(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPLIT), vocabulary), F.lit(""))).alias("term")).groupBy("term").count()
    df_of = {r["term"]: r["count"] for r in counts.collect()}  # at most one row a template term
    idf, unknown, vectors, anchors = weigh(df_of.pop("", 0), df_of)
    name = F.element_at(F.split("path", "/"), -1)
    tokens_of = lambda t: F.split(F.lower(t), SPLIT)
    told = F.array(*map(F.lit, [*anchors, "spdx"]))
    units = F.concat(F.split("text", "\n", -1), F.filter(F.split("text", BLANK, -1), lambda b: F.contains(b, F.lit("\n"))))
    units = F.when(name.rlike(LICENCE_FILE), F.concat(units, F.array(F.col("text")))).otherwise(units)
    found = files.filter(F.arrays_overlap(tokens_of("text"), told)).select("rid", F.explode(units).alias("t"))
    scored = checkpoint(found.select("rid", F.explode(unit_hits(tokens_of("t"), told, idf, unknown, vectors)).alias("hit")).select("rid", "hit.*"))
    # what names a licence comes before sets of shared paragraphs
    shared = scored.filter(F.col("licence").startswith("+")).groupBy("rid", F.col("licence").alias("part")).agg(F.max("score").alias("score"), F.max("terms").alias("terms"))
    sets = literal_rows(df, [(name, part, len(parts)) for name, parts in SETS.items() for part in parts], ["licence", "part", "size"])
    whole = shared.join(F.broadcast(sets), "part").groupBy("rid", "licence", "size").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"), F.sum("terms").cast("int").alias("terms")).filter("n = size")
    ids = tag_ids()
    tag = F.trim(F.regexp_replace("tag", "[ \\t]+", " "))
    tokens = F.filter(F.split(F.lower(F.trim(F.regexp_replace("tag", "[() \\t]+", " "))), " "), lambda x: ~x.isin(*OPERATORS))
    known_ids = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    said = F.when(F.size("tokens") == 1, F.try_element_at(known_ids, F.col("tokens")[0])).when(F.arrays_overlap("tokens", F.array(*map(F.lit, ids))), F.col("tag"))
    tags = files.filter(F.contains(F.lower("text"), F.lit("spdx-license-identifier:"))).select("rid", F.explode(F.regexp_extract_all("text", F.lit(TAG), F.lit(1))).alias("tag")).select("rid", tag.alias("tag"), tokens.alias("tokens")).select("rid", said.alias("licence")).filter("licence is not null")
    scored = scored.filter(~F.col("licence").startswith("+")).select("rid", "score", "terms", "licence", F.lit(1).alias("own")).unionByName(whole.select("rid", "score", "terms", "licence", F.lit(0).alias("own"))).unionByName(tags.select("rid", F.lit(1.0).alias("score"), F.lit(TAG_TERMS).alias("terms"), "licence", F.lit(1).alias("own")))
    best = checkpoint(scored.groupBy("rid").agg(F.min(F.struct((-F.col("own")).alias("last"), (-F.col("score")).alias("minus"), (-F.col("terms")).alias("fewer"), "licence")).alias("b")).select("rid", (-F.col("b.minus")).alias("score"), F.col("b.licence").alias("licence")))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    own = files.select("rid", key, "path", folder.alias("folder")).join(best, "rid", "left")
    given = own.filter(F.col("licence").isNotNull() & name.rlike(LICENCE_FILE)).groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("minus"), "path", "licence")).alias("g")).select(F.col("folder").alias("above"), F.col("g.licence").alias("given"))
    # folders first: many files share one
    folders = own.filter("licence is null").select("folder").distinct()
    parts = F.split("folder", "/")
    ways = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))).alias("x")).select("folder", "x.depth", "x.above")
    near = ways.join(given, "above").groupBy("folder").agg(F.max(F.struct("depth", "above", "given")).alias("n")).select("folder", F.col("n.above").alias("above"), F.col("n.given").alias("given"))
    all_ = salted_join(own, near, ["folder"], F.col("rid"), how="left")
    return all_.select(key, "path", F.coalesce("licence", "given").alias("licence"), F.when(F.col("licence").isNotNull(), F.col("score")).alias("score"), F.when(F.col("licence").isNotNull(), "notice").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(F.col("licence").isNull(), F.when(F.col("above") == "", "/").otherwise(F.col("above"))).alias("inherited_from"))
