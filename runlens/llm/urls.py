"""URL filters: a trie over reversed host labels and path segments, with longest-match precedence between allow and block entries."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, salted_join

#: Characters of the entries that are still sent to every worker as one trie, of about 100 bytes an entry besides.
MAX_CHARS = 32_000_000
RESULT = "rule string, verdict string"


def entry_parts(entry: str) -> tuple[str, str]:
    """Host and path of an entry like `example.com/en/`; one without a slash has the empty path, which every path starts with."""
    host, slash, path = entry.partition("/")
    return host.translate(str.maketrans(ascii_uppercase, ascii_lowercase)), slash + path


class UrlTrie:
    """Host labels from the last to the first, and below each host the segments of paths.

    A node of hosts is [children, root of paths or None]; one of paths is [children by whole segment, entries by the beginning of
    the next segment, lengths of these beginnings, longest first]. Of an entry listed twice `block` wins.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.hosts: list = [{}, None]
        for verdict, entry in rules:
            host, path = entry_parts(entry)
            at = self.hosts
            for label in reversed(host.split(".")) if host else ():
                at = at[0].setdefault(label, [{}, None])
            at[1] = node = at[1] or [{}, {}, []]
            *whole, last = path.split("/")
            for segment in whole:
                node = node[0].setdefault(segment, [{}, {}, []])
            if node[1].get(last, ("", ""))[1] != "block":
                node[1][last] = (host + path, verdict)
                node[2] = sorted({len(k) for k in node[1]}, reverse=True)

    @staticmethod
    def deepest(node: list, path: str) -> tuple[str, str] | None:
        """The entry below a host with the longest path that `path` starts with."""
        found = None
        for segment in path.split("/"):
            for n in node[2]:
                if (hit := node[1].get(segment[:n])) and len(segment) >= n:
                    found = hit
                    break
            node = node[0].get(segment)
            if node is None:
                break
        return found

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Entry and verdict of the longest match: most host labels first, then the longest path."""
        at, met = self.hosts, [self.hosts]
        for label in reversed(host.split(".")) if host else ():
            at = at[0].get(label)
            if at is None:
                break
            met.append(at)
        for node in reversed(met):
            if node[1] is not None and (found := self.deepest(node[1], path)):
                return found
        return None


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path of a url; both empty if it is null or has no `://`."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_trie(parts: DataFrame, rules: list[tuple[str, str]], host: str, path: str, out: str) -> DataFrame:
    trie = parts.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf(RESULT)
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        match = trie.value.match
        for hosts, paths in batches:
            found = [match(h, p) or (None, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return parts.withColumn(out, judged(host, path))


def by_join(parts: DataFrame, rules: DataFrame, host: str, path: str, out: str) -> DataFrame:
    """The same for entries of any number (host, path, verdict): different (host, path) meet entries on the trie's nodes.

    A node is a host without some of its first labels and a beginning of the path, of one of the lengths that entries have.
    """
    best = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # of allow and block the greater is block
    lengths = best.agg(F.array_sort(F.collect_set(F.length("path"))).alias("lengths"))  # one row, at most the longest path's length
    labels = F.split(F.col("h"), r"\.")
    hosts = F.array_append(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")), F.lit(""))
    starts = F.transform(F.filter("lengths", lambda n: n <= F.length("p")), lambda n: F.substring("p", F.lit(1), n))
    different = parts.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    nodes = different.join(F.broadcast(lengths)).select("h", "p", F.explode(F.array_distinct(hosts)).alias("host"), starts.alias("starts")).select("h", "p", "host", F.explode("starts").alias("path"))
    met = salted_join(nodes, best, ["host", "path"], F.xxhash64("h", "p"), how="inner")
    depth = F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\.")))
    won = met.groupBy("h", "p").agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.struct(depth, F.length("path"))).alias(out))
    return salted_join(parts, won.select(F.col("h").alias(host), F.col("p").alias(path), out), [host, path], F.xxhash64(*parts.columns), how="left")


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame, url: str = "url", default: str = "allow", host: str = "host", path: str = "path", rule: str = "rule", verdict: str = "verdict", max_chars: int = MAX_CHARS) -> DataFrame:
    """pages with the host and path of their urls, the entry that decides and its verdict.

    rules: (verdict, entry) in Python or a table of these two columns, `allow` or `block` and a host with a path, as `example.com/en/`.
    An entry fits its host and all subdomains if the path starts with its own; the entry with most host labels wins, then the
    one with the longest path; of an entry that is listed as both, block. A url that none fits gets `default`: a filter lets pass what it doesn't name.
    An entry without host fits all hosts; null entries and verdicts other than the two are ignored.

    The trie is broadcast while its entries have at most max_chars characters; larger tables are joined with the urls' nodes
    instead, with the same result. A null url, or one without `://`, has empty host and path. Repeated pages are judged each; no pages
    give none. Very long urls are walked once. The four result columns take the place of columns of these names.
    """
    spark = pages.sparkSession
    h, p, found = (free(pages, f"__{c}") for c in ("url_host", "url_path", "url_found"))
    made = host_and_path(F.col(f"`{url}`"))
    parts = pages.withColumns({h: made[0], p: made[1]})
    if isinstance(rules, DataFrame):
        rules = rules.filter(F.col("verdict").isin("allow", "block") & F.col("entry").isNotNull())
        size = rules.agg(F.sum(F.length("entry"))).first()[0] or 0
        small = size <= max_chars and [tuple(r) for r in rules.select("verdict", "entry").distinct().collect()]
    else:
        rules = [(v, e) for v, e in rules if v in ("allow", "block") and e is not None]
        small = sum(len(e) for _, e in rules) <= max_chars and rules
        if small is False:
            rules = spark.createDataFrame(rules, "verdict string, entry string")
    if small is not False:
        out = by_trie(parts, list(small), h, p, found)
    else:
        slash = F.locate("/", "entry")
        entry_host = F.translate(F.when(slash > 0, F.substring("entry", F.lit(1), slash - 1)).otherwise(F.col("entry")), ascii_uppercase, ascii_lowercase)
        split = rules.select(entry_host.alias("host"), F.when(slash > 0, F.substring("entry", slash, F.length("entry"))).otherwise("").alias("path"), "verdict")
        out = by_join(parts, split, h, p, found)
    wanted = {host: F.col(h), path: F.col(p), rule: F.col(f"{found}.rule"), verdict: F.coalesce(F.col(f"{found}.verdict"), F.lit(default))}
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in {w.lower() for w in wanted}]
    return out.select(*kept, *itertools.starmap(lambda name, c: c.alias(name), wanted.items()))


#: The rules of the registered query (fixed values).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

SQL = """
with parts as (
  select page_id, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages),
split as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
rules(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
won as (
  select s.page_id, s.host, s.path, arg_max(r.h || r.p, length(r.h || r.p)) as rule, arg_max(r.verdict, length(r.h || r.p)) as verdict
  from split s left join rules r on (s.host = r.h or ends_with(s.host, '.' || r.h)) and starts_with(s.path, r.p)
  group by s.page_id, s.host, s.path)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from won
"""
