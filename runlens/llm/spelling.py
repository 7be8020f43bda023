"""Spelling variants: words within one edit by asymmetric q-chunks, and the commoner form each is written for."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, salted_join, values

#: Bytes in ISO 8859-1 of letters, A-Z in lower case; all else ends a run, and so does "?", which stands for code points above U+00FF.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Different words that a task counts before it hands them on.
HELD = 200_000


def runs_of_letters(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in ISO 8859-1, only A-Z in lower case."""
    return text.encode("iso-8859-1", "replace").translate(TABLE).split()


def slip(run: bytes, h: int) -> bytes:
    """run without its code point at h mod its length."""
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, min_length: int = 5, min_count: int = 3, one_in: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of words that are long and frequent enough. Each task adds up its own counts first.

    With one_in, a document lacks one code point of each of its runs whose unsigned crc32 of `<doc_id>:<run>` it divides.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("iso-8859-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc, t in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                runs = Counter(r for r in runs_of_letters(t) if len(r) >= min_length) if t else {}
                if one_in is None:
                    held.update(runs)
                else:
                    start = crc32(f"{'' if doc is None else doc}:".encode())
                    for run, n in runs.items():
                        h = crc32(run if run.isascii() else run.decode("iso-8859-1").encode(), start)
                        if h % one_in:
                            held[run] += n
                        elif len(run) > min_length:
                            held[slip(run, h)] += n
                if len(held) > HELD:
                    yield handed()
        yield handed()

    plain = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return plain.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _key(length: Column) -> Column:
    """Hash of the characters outside of the open interval [a, b) of the chunked word, which has `length` code points."""
    before, behind = F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.length("word") - length + F.col("b") + 1, F.length("word"))
    return F.xxhash64(length, "a", "b", before, behind)


def _halves(rows: DataFrame) -> DataFrame:
    """rows with their open interval replaced by its two halves: the edit is in one, and the other is a chunk that stays whole.

    An interval of one code point halves into the two empty ones beside it, where a code point may have been inserted, and itself is left for replacements.
    """
    mid = (F.col("a") + F.floor((F.col("b") - F.col("a") + 1) / 2)).cast("int")
    half = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    one = F.array(half(F.col("a"), F.col("a")), half(F.col("b"), F.col("b")))
    two = F.array(half(F.col("a"), mid), half(mid, F.col("b")))
    cut = rows.withColumn("open", F.when(F.col("b") - F.col("a") == 1, one).otherwise(two)).drop("a", "b")
    return cut.select("word", "length", F.inline("open"))


def near_words(words: DataFrame, max_bucket: int = 32) -> DataFrame:
    """(x, y): every pair of different words (word, distinct) that one inserted, deleted or replaced code point tells apart, x the shorter, or the smaller of two of one length.

    Asymmetric q-chunks: a word is cut into two disjoint chunks; the edit is in one of them, so the other is found whole in its partner,
    shifted by the difference of their lengths, which is 0 or 1 as the shorter word is the one that is cut. The partner gives its grams at these
    positions for both lengths it may have been made from. Words that share a chunk at such a place meet, and are verified in the join itself.

    Common chunks don't make all pairs of the words that hold them: while more than max_bucket words meet at one, what is open
    beside the chunk is cut into two chunks in the same way, for those words only. At the end of that all words that meet are near pairs,
    so the work is bounded by words, cuts and results. A null word is near none; words of one code point have no chunks and meet as they are, like the empty word; no words give no pairs.
    """
    rows = words.filter("word is not null").select("word", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("length")).filter("length >= 0").withColumns({"a": F.lit(0), "b": F.col("length")})
    open_ = _halves(rows.filter("length > 1")).unionByName(rows.filter("length < 2"))
    found = None
    while True:
        keyed = open_.withColumn("key", _key(F.col("length")))
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("word") == F.col("length")).alias("cut")).filter("n > 1 and cut > 0")
        met = checkpoint(salted_join(keyed, sizes, ["key"], F.xxhash64("word"), how="inner"))
        # an interval of one code point gives pairs of equal length at once, as all that meet there are near; its halves are for insertions
        final = (F.col("b") - F.col("a") == 0) | (F.col("n") <= max_bucket)
        ready = met.withColumn("final", final).filter(F.col("final") | ((F.col("b") - F.col("a") == 1) & (F.length("word") == F.col("length"))))
        x, y = ready.filter(F.length("word") == F.col("length")).select("key", F.col("word").alias("x")), ready.select("key", F.col("word").alias("y"))
        near = F.expr("(length(y) > length(x) or x < y) and levenshtein(x, y, 1) = 1")
        pairs = checkpoint(x.join(y, "key").filter(near).select("x", "y"))
        found = pairs if found is None else found.unionByName(pairs)
        more = met.filter(~final & ~((F.col("b") - F.col("a") == 1) & (F.col("cut") == F.col("n"))))
        if more.isEmpty():
            return found.distinct()
        open_ = _halves(more.select("word", "length", "a", "b"))


def variant_forms(words: DataFrame, pairs: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of words (word, n) and their near pairs.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that is factor times its own n or more. root is where forms lead to, the
    word itself if it has none. n grows by factor with each form, so chains end; each round follows twice as many forms at once.
    """
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("other")).unionByName(pairs.select(F.col("y").alias("word"), F.col("x").alias("other")))
    known = words.select("word", "n")
    best = both.join(known.withColumnsRenamed({"word": "other", "n": "other_n"}), "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("top"))
    joined = known.join(best, "word", "left")
    formed = -F.col("top.rank") >= factor * F.col("n")
    forms = checkpoint(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("top.other")).alias("form"), F.when(formed, -F.col("top.rank")).alias("form_n")))
    up = open_ = checkpoint(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    done = up.limit(0)
    while not open_.isEmpty():
        above = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        step = checkpoint(salted_join(open_, above, ["root"], F.xxhash64("word"), how="left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        done, open_ = done.unionByName(step.filter("not moved").drop("moved")), step.filter("moved").drop("moved")
        up = done.unionByName(open_)
    return forms.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, factor: int = 2, one_in: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of all whole texts with their counts, commoner form, root and number of near words; one row a word.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, that have at least min_length code points and occur at
    least min_count times in all texts. With one_in, each document first misspells about one in so many of its different runs (see count_words), which
    gives known variants to look for. Null and empty texts have no words; rows without doc_id misspell as if it were empty text; repeated rows count each time; very long texts and
    runs are used whole; no documents give no rows. Only the two named columns are read.
    """
    words = checkpoint(count_words(docs, min_length, min_count, one_in, doc_id, text))
    return variant_forms(words, near_words(words.select("word")), factor)
