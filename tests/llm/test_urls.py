"""URL filters against a plain loop over the rules."""

import random
import re

from pyspark.sql import functions as F

from runlens.llm import urls

RULES = [*urls.RULES, ("block", "a.b"), ("allow", "a.b/x"), ("block", "a.b/x/y"), ("allow", "/admin/"), ("block", "c.d/z"), ("allow", "c.d/z"), ("block", "A.B/Q/"), ("allow", "x.a.b/x/yy/")]


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group().translate({c: c + 32 for c in range(65, 91)})
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    best = None
    for verdict, entry in rules:
        h, p = urls.entry_parts(entry)
        if (not h or host == h or host.endswith(f".{h}")) and path.startswith(p):
            depth = len(h.split(".")) if h else 0
            best = max(best or (-1,), (depth, len(p), verdict == "block", h + p, verdict))
    return (host, path, *(best[3:] if best else (None, default)))


def some_urls(n=600):
    rng = random.Random(3)
    hosts = ["com", "example.com", "www.example.com", "EXAMPLE.com", "a.example.net", "net", "a.b", "x.a.b", "xa.b", "c.d", "é.d", "", "example.com.", "example.com:80", "user@a.b"]
    paths = ["", "/", "/en", "/en/", "/en/5", "/es/1", "/fr/", "/x", "/xy", "/x/y", "/x/yy/z", "/z", "/admin/a", "/Q/1", "//en/", "/" + "s/" * 3000]
    tails = ["", "?a=/en/", "#/en/", "?x://y", "/\n?"]
    made = [f"{rng.choice(('http', 'https', ''))}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(n)]
    return [*made, None, "", "no scheme", "://", "a://b://c/en/", "mailto:x@a.b"]


def test_filter_equals_plain_loop(spark):
    data = [(i, u, "own") for i, u in enumerate(some_urls())]
    pages = spark.createDataFrame(data, "page_id long, url string, __url_host string").repartition(4)
    want = {i: plain(u, RULES) for i, u, _ in data}
    table = spark.createDataFrame([*RULES, (None, "a.b"), ("block", None), ("odd", "a.b/")], "verdict string, entry string")
    for rules, limit in ((RULES, urls.MAX_CHARS), (table, urls.MAX_CHARS), (RULES, 3), (table, 3)):
        out = urls.filter_urls(pages, rules, max_chars=limit)
        assert out.columns == ["page_id", "url", "__url_host", "host", "path", "rule", "verdict"]
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
        assert got == want, limit


def test_repeats_empty_tables_and_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://net/es/", "old"), (1, "http://net/es/", "old"), (None, None, None)], "page_id long, url string, verdict string")
    for limit in (urls.MAX_CHARS, 0):
        out = urls.filter_urls(pages, urls.RULES, max_chars=limit, default="block")
        assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(1, "http://net/es/", "net", "/es/", "net/es/", "block")] * 2 + [(None, None, "", "", None, "block")]))
        assert urls.filter_urls(pages.limit(0), urls.RULES, max_chars=limit).count() == 0
        assert urls.filter_urls(pages, [], max_chars=limit).filter(F.col("verdict") == "allow").count() == 3
