"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a bag of words weighted by their counts. Each word draws r and c from Gamma(2, 1) and b from U(0, 1), all from
hashes of the word; with t = floor(ln(w) / r + b) its value is ln(a) = ln(c) - r (t - b + 1), and the smallest value in a bin wins
(word, t) as the bin's sample. Words are dealt to BINS bins by hash, so each is drawn once; samples of two documents agree
with the probability of their generalised Jaccard similarity, over the bins that either has. Weights above CHUNK are split into parts
of at most CHUNK, which leaves the similarity as it is and lets bins weigh about the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, LANES, CHUNK = 128, 4, 2
#: Tasks of the one shuffle at most; the plan holds about twice as many bounds of blocks, whatever the number of documents.
MAX_PARTS = 10_000
#: A 64-bit column holds LANES samples of 14 bits, each below a guard bit.
LANE_BITS = 15
ONES = sum(((1 << 14) - 1) << (LANE_BITS * i) for i in range(LANES))
GUARDS = sum((1 << 14) << (LANE_BITS * i) for i in range(LANES))


def _unit(bits: Column) -> Column:
    """(0, 1) from the low 32 bits."""
    return (bits.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)) / F.lit(float(1 << 32))


def sample_columns(term: list[Column], weight: Column) -> tuple[Column, Column]:
    """Bin, and the sample packed below its value: the smallest packed number of a bin is the bin's sample."""
    h1, h2, h3 = (F.xxhash64(*term, F.lit(k)) for k in (1, 2, 3))
    high = lambda h: F.shiftrightunsigned(h, 32)
    r = -F.log(_unit(h1) * _unit(high(h1)))
    log_c = F.log(-F.log(_unit(h2) * _unit(high(h2))))
    beta = _unit(h3)
    t = F.floor(F.log(weight.cast("double")) / r + beta)
    log_a = log_c - r * (t - beta + F.lit(1.0))
    rank = F.floor((F.greatest(F.least(log_a, F.lit(1000.0)), F.lit(-1000.0)) + F.lit(1024.0)) * F.lit(float(1 << 37)))
    token = F.pmod(F.xxhash64(*term, t), F.lit(16383)) + F.lit(1)
    return F.pmod(high(h3), F.lit(BINS)).cast("int"), rank * F.lit(16384) + token


def signatures(df: DataFrame, by: list[str], text: str, variants: dict[str, Column]) -> DataFrame:
    """One row for each `by`, with BINS / LANES bigint columns `<variant>_<i>` for each variant of `text`'s rows (a condition).

    Nulls and texts without words have no samples (zeros). All grouping is on `by` first, so rows that are already
    dealt by a part of `by` aren't shuffled again.
    """
    words = df.select(*by, *[c.alias(f"is_{v}") for v, c in variants.items()], F.explode(F.split(text, r"\s+")).alias("term")).filter("term <> ''")
    flags = [f"is_{v}" for v in variants]
    counted = words.groupBy(*by, *flags, "term").agg(F.count(F.lit(1)).alias("w"))
    counted = counted.select(*by, *flags, "term", "w", F.explode(F.sequence(F.lit(0), F.floor((F.col("w") - 1) / CHUNK).cast("int"))).alias("part"))
    bin_, packed = sample_columns([F.col("term"), F.col("part")], F.least(F.col("w") - F.col("part") * CHUNK, F.lit(CHUNK)))
    drawn = counted.select(*by, *flags, bin_.alias("bin"), packed.alias("packed")).groupBy(*by, *flags, "bin").agg(F.min("packed").alias("packed"))
    drawn = drawn.select(*by, *flags, (F.col("bin") / LANES).cast("int").alias("place"), F.expr(f"shiftleft(pmod(packed, 16384), (bin % {LANES}) * {LANE_BITS})").alias("lane"))
    columns = [F.coalesce(F.bit_or(F.when(F.col(f"is_{v}") & (F.col("place") == i), F.col("lane"))), F.lit(0)).alias(f"{v}_{i}") for v in variants for i in range(BINS // LANES)]
    return drawn.groupBy(*by).agg(*columns)


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal samples among the bins that either has; 1 if neither has any."""
    same = held = F.lit(0)
    for x, y in zip(a, b, strict=True):
        nx, ny = (x + F.lit(ONES)).bitwiseAND(F.lit(GUARDS)), (y + F.lit(ONES)).bitwiseAND(F.lit(GUARDS))
        differ = (x.bitwiseXOR(y) + F.lit(ONES)).bitwiseAND(F.lit(GUARDS))
        same = same + F.bit_count(nx.bitwiseAND(F.bitwise_not(differ)))
        held = held + F.bit_count(nx.bitwiseOR(ny))
    return F.when(held == 0, F.lit(1.0)).otherwise(same.cast("double") / F.greatest(held, F.lit(1)).cast("double"))


def as_text(columns: list[Column]) -> Column:
    """Fixed-length lowercase hexadecimal form of a signature."""
    return F.concat(*[F.lpad(F.lower(F.hex(c)), LANE_BITS, "0") for c in columns])


def with_neighbour(df: DataFrame, parts: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of df dealt by `block`, consecutive ids in descending order, each with the next document's text.

    Returns block, doc_id, text, next_text, seat (its place in the block) and halo. A block's last document meets the first one of the next block, which
    is sent along as a halo row (its own next_text is of no use); the last document of all meets the first. Ties in doc_id come in
    order of the texts' hashes, null ids last. Bounds of blocks are approximate quantiles of doc_id, so their sizes are even
    whatever the ids; the driver gets two numbers a block.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    coarse = max(1, round((2 * parts) ** 0.5))
    n = coarse * coarse
    ids = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("id"))
    found = ids.agg(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], 20 * n).alias("q")).first()["q"]
    bounds = sorted(set(found or [0]))
    groups = [bounds[i : i + coarse] for i in range(0, len(bounds), coarse)]
    fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
    firsts = F.array(*[F.lit(g[0]).cast("long") for g in groups])

    def block_of(c: Column) -> Column:
        """Number of bounds at or below the id, in two steps of the root of their number each."""
        k = F.size(F.filter(firsts, lambda x: x <= c))
        return F.when(k == 0, F.lit(0)).otherwise((k - 1) * coarse + F.size(F.filter(F.get(fine, k - 1), lambda x: x <= c)))

    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    heads = ids.select(block_of(F.col("id")).alias("block"), "id").groupBy("block").agg(F.max("id").alias("head")).orderBy(F.desc("block")).collect()
    rows = rows.withColumn("block", block_of(order)).withColumn("halo", F.lit(False))
    if heads:  # a union, as Spark uses one shuffle for all that reads it
        before = {heads[i]["block"]: heads[i - 1]["block"] for i in range(len(heads))}
        to = F.map_from_arrays(F.array(*map(F.lit, before)), F.array(*map(F.lit, before.values())))
        first = rows.filter(order.isin([h["head"] for h in heads]))
        rows = rows.unionByName(first.withColumn("block", F.element_at(to, F.col("block"))).withColumn("halo", F.lit(True)))
    next_ = Window.partitionBy("block").orderBy("halo", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).desc(), F.xxhash64("text"))
    return rows.repartition(parts, "block").withColumn("next_text", F.lead("text").over(next_)).withColumn("seat", F.row_number().over(next_))


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document (null text: empty).

    The edited text has the last floor(n_chars / 2) code points replaced by as many first ones (or all) of the next document in
    descending order of doc_id, after the last the first. One shuffle deals the texts; all later steps keep
    its partitions.
    """
    # about a thousand documents each, as a task's words are grouped in memory
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(df.count() // 1000, MAX_PARTS))
    base = with_neighbour(df, parts, doc_id, text)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    base = base.withColumn("edited", F.when(F.col("halo"), F.lit("")).otherwise(edited))
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    quarters = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long").alias(f"sha_{i}") for i in range(4)]
    by = ["block", "seat", "doc_id", "halo", "n_chars", *(f"sha_{i}" for i in range(4))]
    # what belongs to a document is part of its key, so nothing is joined; a third text keeps documents without words
    as_struct = lambda v, t: F.struct(F.lit(v).alias("v"), t.alias("t"))
    texts = F.array(as_struct(0, F.col("text")), as_struct(1, F.col("edited")), as_struct(2, F.lit("-")))
    base = base.select("block", "seat", "doc_id", "halo", F.length("text").cast("long").alias("n_chars"), *quarters, texts.alias("texts"))
    long = base.select(*by, F.inline("texts"))
    both = signatures(long, by, "t", {"own": F.col("v") == 0, "edited": F.col("v") == 1})
    names = [f"own_{i}" for i in range(BINS // LANES)]
    seats = Window.partitionBy("block").orderBy("seat")
    both = both.withColumn("after", F.lead(F.struct(*names)).over(seats)).filter(~F.col("halo"))
    own, new, after = [F.col(n) for n in names], [F.col(f"edited_{i}") for i in range(BINS // LANES)], [F.col(f"after.{n}") for n in names]
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"sha_{i}")), 16, "0") for i in range(4)])
    return both.select("doc_id", "n_chars", sha.alias("edited_sha256"), as_text(own).alias("fingerprint"), as_text(new).alias("edited_fingerprint"), likeness(own, new).alias("near_edited"), likeness(own, after).alias("near_next"))
