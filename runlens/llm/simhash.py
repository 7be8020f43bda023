"""SimHash near-duplicates found by Golay-code fuzzy hashing.

The perfect (23, 12, 7) Golay code has exactly one codeword within 3 bits of any 23-bit segment. The codewords that the
segment and its 23 one-bit neighbours decode to are its keys: 1 or 6 of them, and two segments at most 2 bits apart share one,
as some word within 1 bit of both decodes to it. Errors that are spread over several segments leave most of them with few.
Keys are joined, links verified.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_links, checkpoint, connected_components, salted_join, values

#: Fixed value: generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials modulo the generator."""
    r = words.astype(np.int64)
    for k in range(22, 10, -1):
        r = np.where(r >> k & 1, r ^ (GENERATOR << (k - 11)), r)
    return r


@functools.lru_cache(maxsize=1)
def corrections() -> np.ndarray:
    """Error pattern of at most 3 bits for each of the 2,048 syndromes."""
    one = [1 << i for i in range(23)]
    errors = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
    table = np.zeros(2048, dtype=np.int64)
    table[syndromes(np.array(errors))] = errors
    return table


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ corrections()[syndromes(words)]) >> 11


def golay_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6): the codewords within reach of each word, its nearest first; the nearest is repeated where there are fewer."""
    words = words.astype(np.int64)
    own = nearest(words)
    all_ = np.sort(np.stack([nearest(words ^ e) for e in [0, *(1 << i for i in range(23))]], axis=1), axis=1)
    fresh = np.concatenate([np.ones((len(words), 1), bool), all_[:, 1:] != all_[:, :-1]], axis=1) & (all_ != own[:, None])
    out = np.repeat(own[:, None], 6, axis=1)
    row, col = np.nonzero(fresh)
    place = np.cumsum(fresh, axis=1)[row, col]
    out[row, place] = all_[row, col]
    return out


def different(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the different values of each row."""
    values = np.sort(values, axis=1)
    fresh = np.concatenate([np.ones((len(values), 1), bool), values[:, 1:] != values[:, :-1]], axis=1)
    row, col = np.nonzero(fresh)
    return row, values[row, col]


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and the five ASCII controls from tab on, A-Z lower-cased."""
    return (text or "").encode().translate(LOWER).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words joined by spaces; of all words if there are fewer; none without words."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    view, last = memoryview(line), ends[min(size, len(words)) - 1 :]
    return np.fromiter((xxh64_intdigest(view[a : b - 1], 42) for a, b in zip(starts[:n], last, strict=False)), dtype=np.uint64, count=n)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash_fingerprints(df: DataFrame, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp (signed 64 bits): majority of the shingles' hashes over the whole text, repeats counted; 0 without words."""

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([_signed(majority(h)) if len(h := shingle_hashes(words_of(t), shingle)) else 0 for t in values(texts)], pa.int64())

    return df.select(F.col(doc_id).alias("doc_id"), fingerprint(text).alias("fp"))


def fingerprint_keys(df: DataFrame) -> DataFrame:
    """node (fp) and key of df's fp: every two fingerprints at most 2 bits apart share a key.

    64 bits are segments A (23), B (20) and C (21). If B is equal, A has at most 2 errors: a Golay key of A with B. If C is equal,
    a Golay key of A with C. Else B and C have one error each and A none: A with a Golay key of B. That is up to
    18 keys of 32 bits and more, so that fingerprints seldom meet by chance, however many there are.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            a, b, c = (((fp >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 20), (43, 21)))
            of_a, of_b = golay_keys(a), golay_keys(b)
            nodes, found = [], []
            for kind, both in enumerate((of_a << 20 | b[:, None], of_a << 21 | c[:, None], of_b << 23 | a[:, None])):
                row, values = different(both | kind << 40)
                nodes.append(row)
                found.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)[np.concatenate(nodes)]), pa.array(np.concatenate(found))], ["node", "key"])

    return df.select("fp").mapInArrow(keys, "node long, key long")


def simhash_components(df: DataFrame, shingle: int = 3, max_bits: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id: smallest doc_id reachable over links of at most max_bits (0 to 2) differing bits.

    Only different fingerprints are linked; copies follow their fingerprint. Null and empty texts have fingerprint 0 and link
    like any other. A null doc_id gets a component but never names one unless it is alone.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys find links of 0 to 2 bits")
    docs = checkpoint(simhash_fingerprints(df, shingle, text, doc_id))
    nodes = docs.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    near = F.expr(f"bit_count(x.node ^ y.node) <= {max_bits}")
    links = bucket_links(fingerprint_keys(nodes), near, lambda pairs: pairs)
    comp = connected_components(links)
    placed = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = placed.join(least, "component").select("fp", "component_id")
    # a fingerprint may hold a third of all rows: documents are dealt by (fingerprint, salt)
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(8)).cast("int")).join(spread, ["fp", "salt"]).select("doc_id", "fp", "component_id")


#: Bands of minima; 12 bands of 4 find a pair at a Jaccard similarity of 0.8 in 1 - (1 - 0.8^4)^12 = 99.8 % of cases, whatever was edited.
BANDS, BAND = 12, 4
#: Of one bit of each of the 48 minima, pairs at 0.8 differ in 4.8 on average, with a standard deviation of 2.1.
NEAR_BITS = 14
#: Words of the shingles, and differing bits, of the SimHash fingerprints that find near copies first.
PRINT_SHINGLE, PRINT_BITS = 3, 2


def row_key(text: str, doc_id: str) -> Column:
    """Digest of doc_id and text: rows alike in both share it."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))))


def run_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the different runs of `size` words (of all words if there are fewer), in their order as unsigned numbers."""
    from xxhash import xxh64_intdigest

    one = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n, size = max(1, len(one) - size + 1), min(size, len(one))
    runs = np.zeros(n, np.uint64)
    for k in range(size):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n]
    runs = (runs ^ (runs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(runs ^ (runs >> np.uint64(32)))


def min_hashes(runs: np.ndarray) -> np.ndarray:
    """The minima of BANDS * BAND hash functions over runs."""
    odd = np.random.default_rng(23).integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    return np.array([(runs * m).min() for m in odd])


def common_least(n: int, similarity: float) -> tuple[int, int]:
    """How many of the smallest of n runs to take, and how many of these at least are among those of any near set.

    Near sets of n and m runs have ceil(similarity * max(n, m)) in common or more. With ceil(similarity * n) - extra(n) of n runs left out, which are the
    largest, at most as many of the common ones are out on either side, so the smaller extra of both is common to what was taken; and m is similarity * n at least.
    """
    extra = lambda n: max(1, n // 10)
    least = math.ceil(similarity * n - 1e-9)
    return min(n, n - least + extra(n)), extra(least)


def min_prints(df: DataFrame, shingle: int) -> DataFrame:
    """row, doc_id, digest (128 bits) of the words, the keys of the bands (none without words), s, a bit of each minimum, and fp, the SimHash fingerprint."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_hexdigest, xxh64_intdigest

        for batch in batches:
            keys, digests, bits, fps = [], [], np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k, t in enumerate(values(batch.column(2))):
                words = words_of(t)
                digests.append(xxh3_128_hexdigest(b" ".join(words)))
                if not words:
                    keys.append([])
                    continue
                fps[k] = _signed(majority(shingle_hashes(words, PRINT_SHINGLE)))
                least = min_hashes(run_hashes(words, shingle))
                keys.append([_signed(xxh64_intdigest(x.tobytes(), b)) for b, x in enumerate(least.reshape(BANDS, BAND))])
                bits[k] = np.sum((least >> np.uint64(40) & np.uint64(1)) << np.arange(len(least), dtype=np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits), pa.array(fps)], ["row", "doc_id", "digest", "keys", "s", "fp"])

    return df.select("row", "doc_id", "text").mapInArrow(prints, "row string, doc_id long, digest string, keys array<long>, s long, fp long")


def smallest_runs(df: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """digest of the words of each different text with words, and what common_least says: its smallest runs, and how many of them are common."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_hexdigest

        for batch in batches:
            digests, smallest, common = [], [], []
            for words in map(words_of, values(batch.column(0))):
                if words:
                    runs = run_hashes(words, shingle)
                    n, least = common_least(len(runs), similarity)
                    digests.append(xxh3_128_hexdigest(b" ".join(words)))
                    smallest.append(runs[:n].view(np.int64))
                    common.append(least)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(smallest, pa.list_(pa.int64())), pa.array(common, pa.int64())], ["digest", "smallest", "common"])

    return df.select("text").mapInArrow(taken, "digest string, smallest array<long>, common long").groupBy("digest").agg(F.first("smallest").alias("smallest"), F.first("common").alias("common"))


def linked(few: pd.DataFrame, many: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """(a, b): for each of few and each other component among many, one node whose set s has a Jaccard similarity of at least `similarity` to its own."""
    out: list[np.ndarray] = []
    if len(few) and len(many):
        sizes = many["s"].map(len).to_numpy()
        flat, owner = np.concatenate(many["s"].to_list()), np.repeat(np.arange(len(many)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        nodes, components = many["node"].to_numpy(), many["component"].to_numpy()
        for node, component, own in zip(few["node"], few["component"], few["s"], strict=True):
            start, end = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
            hits = end - start
            at = np.arange(hits.sum()) + np.repeat(start - np.cumsum(hits) + hits, hits)
            common = np.bincount(owner[at], minlength=len(many))
            near = np.nonzero((common >= similarity * (len(own) + sizes - common)) & (components != component))[0]
            first = near[np.unique(components[near], return_index=True)[1]]
            out.append(np.stack([np.minimum(node, nodes[first]), np.maximum(node, nodes[first])], axis=1))
    found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pd.DataFrame(found.astype(np.int64), columns=["a", "b"])


def near_groups(df: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """row (see row_key), doc_id and component of each row of df, by pairs of texts whose sets of word shingles have a Jaccard similarity of at least `similarity`.

    SimHash comes first: texts whose fingerprints differ in at most PRINT_BITS bits share a Golay key and meet its heads. At a similarity
    of 0.8 fingerprints differ in more bits, so texts that are in other components than those of their buckets then also meet
    if they share a band of minima over the shingles, where recall depends on the similarity alone, and not on which words
    differ. What bands leave apart is found without a chance of loss: a text that is near one of another component has most of its shingles in common
    with such ones. Of texts for which that may hold, by their smallest runs, the rarest shingles are compared: near texts share one of
    those that they can't all differ in. Each time the similarity is computed exactly from whole texts.
    Exact copies (by 128-bit digest of their words) are one node. Texts without words are alike.
    """

    @F.arrow_udf("array<long>")
    def shingles(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(words_of(t), shingle).view(np.int64)) for t in values(texts)], pa.list_(pa.int64()))

    rows = df.select(row_key(text, doc_id).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    copies = checkpoint(min_prints(rows, shingle))
    firsts = copies.groupBy("digest").agg(F.min("row").alias("row"), F.min("keys").alias("keys"), F.min("s").alias("s"), F.min("fp").alias("fp"))
    firsts = checkpoint(firsts.withColumn("node", F.monotonically_increasing_id()))
    near = F.expr(f"bit_count(x.s ^ y.s) <= {NEAR_BITS}")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """node and its shingles; a row may be repeated: one array of each node."""
        asked = firsts.select("node", "row").join(nodes.distinct(), "node")
        return rows.join(asked, "row").select("node", shingles("text").alias("s")).groupBy("node").agg(F.first("s").alias("s"))

    def compare(few: DataFrame, many: DataFrame) -> DataFrame:
        few, many = checkpoint(few), checkpoint(many)
        sets = checkpoint(sets_of(many.select("node")))
        by = ["key", "part"]
        held = lambda df: df.join(sets, "node").select(*by, "node", "component", F.col("s").alias("s"))
        both = held(few).groupBy(*by).cogroup(held(many).groupBy(*by))
        return both.applyInPandas(functools.partial(linked, similarity=similarity), "a long, b long").distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = checkpoint(pairs)
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        both = both.withColumn("c", F.size(F.array_intersect("sa", "sb")))
        return both.filter(F.col("c") >= similarity * (F.size("sa") + F.size("sb") - F.col("c"))).select("a", "b").distinct()

    def elsewhere(tokens: DataFrame) -> DataFrame:
        """tokens (key, node, component) whose key is in several components, with how many have it."""
        by = Window.partitionBy("key")
        counted = tokens.withColumns({"low": F.min("component").over(by), "high": F.max("component").over(by), "n": F.count(F.lit(1)).over(by)})
        return counted.filter("low <> high").drop("low", "high")

    def left_apart(links: DataFrame) -> DataFrame:
        """links, and those between what they leave apart."""
        comp = connected_components(links)
        placed = checkpoint(worded.select("digest", "node").join(comp, "node", "left").select("digest", "node", F.coalesce("component", "node").alias("component")))
        tokens = placed.join(smallest_runs(rows, shingle, similarity), "digest").select("node", "component", "common", F.explode("smallest").alias("key"))
        asked = elsewhere(tokens).groupBy("node", "component", "common").agg(F.count(F.lit(1)).alias("met")).filter("met >= common")
        asked = checkpoint(asked.select("node", "component"))
        sets = checkpoint(sets_of(asked.select("node")).join(asked, "node").withColumn("size", F.size("s")))
        # shingles that no other component has come first, then the rarest; all but similarity * size - 1 of them have one that a near text has there
        of_node = Window.partitionBy("node")
        met = elsewhere(sets.select("node", "component", "size", F.explode("s").alias("key")))
        met = met.withColumns({"place": F.row_number().over(of_node.orderBy("n", "key")), "met": F.count(F.lit(1)).over(of_node)})
        first = F.col("met") - F.ceil(similarity * F.col("size") - 1e-9) + 1
        members = checkpoint(met.filter(F.col("place") <= first).select("node", "key"))
        if members.isEmpty():
            return links
        as_large = F.expr(f"least(x.size, y.size) >= {similarity} * greatest(x.size, y.size) - 1e-9")
        return bucket_links(members, as_large, verify, sets.select("node", "size"), known=links)

    # by SimHash; texts without words are one node
    worded = firsts.filter(F.size("keys") > 0)
    prints = fingerprint_keys(worded.select("fp").distinct()).withColumnRenamed("node", "fp")
    alike = F.expr(f"bit_count(x.fp ^ y.fp) <= {PRINT_BITS}")
    links = checkpoint(bucket_links(salted_join(worded.select("node", "fp"), prints.groupBy("fp").agg(F.collect_list("key").alias("of_fp")), ["fp"], F.col("node"), how="inner").select("node", F.explode("of_fp").alias("key")), alike, verify, firsts.select("node", "fp"), rest=False))
    # by bands, what those links leave apart
    members = firsts.select("node", F.explode("keys").alias("key"))
    links = checkpoint(bucket_links(members, near, verify, firsts.select("node", "s"), compare, known=links).distinct())
    comp = connected_components(left_apart(links))
    named = firsts.select("digest", "node").join(comp, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    # a digest may hold a third of all rows: documents are dealt by (digest, salt)
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return copies.select("row", "doc_id", "digest", F.pmod(F.xxhash64("row"), F.lit(8)).cast("int").alias("salt")).join(spread, ["digest", "salt"]).select("row", "doc_id", "component")


def near_duplicates(df: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and component_id, the smallest doc_id of its near_groups.

    Rows without doc_id are left out; one row for each different doc_id, with the smallest of its texts' components.
    """
    groups = checkpoint(near_groups(df.filter(F.col(doc_id).isNotNull()), shingle, similarity, text, doc_id))
    named = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    out = groups.withColumn("salt", F.pmod("doc_id", F.lit(8)).cast("int")).join(spread, ["component", "salt"])
    return out.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def drop_near_duplicates(df: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Exactly one row of each of df's near_groups: that with the smallest doc_id, null last, then by row_key.

    Rows are told apart by doc_id and text, so one doc_id may hold several texts; of rows alike in both any one stays.
    """
    groups = checkpoint(near_groups(df, shingle, similarity, text, doc_id))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    kept = groups.groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.row").alias("row"), F.lit(True).alias("kept"))
    marks = groups.groupBy("row").agg(F.count(F.lit(1)).alias("n")).join(kept, "row", "left")
    marks = checkpoint(marks.filter("kept is null or n > 1").select(F.col("row").alias("__marked"), F.col("kept").isNotNull().alias("again")))
    left = df.withColumn("__row", row_key(text, doc_id))
    left = left.join(marks.filter("not again"), F.col("__row") == F.col("__marked"), "left_anti")
    again = marks.filter("again")
    if again.limit(1).count():
        same = F.col("__row") == F.col("__marked")
        left = left.join(again, same, "left_anti").union(left.join(again, same, "left_semi").dropDuplicates(["__row"]))
    return left.drop("__row")
