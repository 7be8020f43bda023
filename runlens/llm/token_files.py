"""Token-id files: flat unsigned integers with 64-bit document offsets, memory-mapped when read.

A folder holds, for each shard of consecutive doc_ids: `shard-NNNNN.ids` (little-endian unsigned 16- or 32-bit ids,
16 if the vocabulary fits), `.offsets` (n + 1 signed 64-bit positions within the shard, starting with 0), `.docs` (n signed
64-bit doc_ids, nulls as the smallest integer, which sorts first) and a row in `manifest` (Parquet): shard, n_docs,
n_tokens, id_bytes. Bases of shards are prefix sums of n_tokens in order of shard. Files are written under another
name and renamed, so a task that runs again leaves the same files. The folder must be mounted on all machines.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_in_worker, mounted, slices
from .cuts import Recent, cut_texts

NULL_ID = -(1 << 63)
#: Chunks and words that a worker keeps at most in each of two generations, and words that are encoded at once.
CHUNKS, WORDS, AT_ONCE = 100_000, 250_000, 20_000
#: Texts that are encoded together.
TEXTS = 1000
#: Punctuation that may be cut from a word's end.
TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


class Chunks:
    """Ids of texts by the tokenizers library, which gets every different chunk of a text once.

    Words of chunks that weren't seen before go to the library as one text, and its ids are dealt to them by their bytes. Texts with
    special tokens go to it whole, and so do all if the vocabulary's tokens aren't bytes.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype(dtype)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = list(special)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.size_of = np.zeros(max([*vocabulary.values(), *special.values()]) + 1, np.int64)
        for t, i in vocabulary.items():
            self.size_of[i] = len(t)  # a character of the byte alphabet stands for a byte
        kind = json.loads(self.library.to_str())
        first = kind["pre_tokenizer"] or {}
        self.cuts = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not kind["normalizer"]
        self.chunks, self.words, self.tails = Recent(CHUNKS, self.make_chunks), Recent(WORDS, self.make_parts), Recent(10_000, self.make_tails)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def make_parts(self, parts: list[str]) -> list[bytes]:
        """Encodes parts as one text and cuts its ids where the parts end."""
        out = []
        for a in range(0, len(parts), AT_ONCE):
            some = parts[a : a + AT_ONCE]
            ids = self.whole("".join(some))
            ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in some])
            at = np.searchsorted(np.cumsum(self.size_of[ids]), ends) + 1
            raw, at = ids.tobytes(), (np.concatenate([[0], at]) * self.dtype.itemsize).tolist()
            out += [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        return out

    def make_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks. Punctuation that ends a word is encoded by itself, as many words come with and without it."""
        words = [w if w[0] == "\n" else " " + w for w in chunks]
        bare = [w.rstrip(TAIL) for w in words]
        bare = [b if b != w and b[-1:].isalnum() else w for b, w in zip(bare, words, strict=True)]
        tails = [w[len(b) :] for b, w in zip(bare, words, strict=True)]
        ids, ends = self.words(set(bare)).__getitem__, self.tails({t for t in tails if t})
        return [ids(b) + ends[t] if t else ids(b) for b, t in zip(bare, tails, strict=True)]

    def make_tails(self, tails: list[str]) -> list[bytes]:
        return [self.whole(t).tobytes() for t in tails]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text. Chunks that are new to all of them are encoded together."""
        usable = [bool(t) and self.cuts and not any(s in t for s in self.special) for t in texts]
        cuts, chunks = cut_texts([t for t, ok in zip(texts, usable, strict=True) if ok])
        ids, each = self.chunks(chunks).__getitem__, iter(cuts)
        own = lambda c: (self.whole(c[0]).tobytes() if c[0] else b"") + b"".join(map(ids, c[1:]))
        return [own(next(each)) if ok else self.whole(t).tobytes() if t else b"" for t, ok in zip(texts, usable, strict=True)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


@kept_in_worker
def chunks(path: str, dtype: str) -> Chunks:
    return Chunks(path, dtype)


def id_type(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def write_token_files(df: DataFrame, folder: str, path: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Encodes whole texts (null: empty), appends end_id to each, writes them in ascending doc_id order; returns the manifest.

    doc_ids are dealt by range, so a shard is a task's rows and memory holds one batch. Repeated doc_ids stay, side by
    side. An empty table gives an empty manifest.
    """
    spark, at, dtype = df.sparkSession, mounted(folder), id_type(path)
    os.makedirs(at, exist_ok=True)
    end = b"" if end_id is None else np.array([end_id], dtype=dtype).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{at}/shard-{task.partitionId():05d}"
        own = f".{task.taskAttemptId()}"
        encoder, position, n = chunks(path, dtype), 0, 0
        width = np.dtype(dtype).itemsize
        os.makedirs(at, exist_ok=True)
        with open(f"{name}.ids{own}", "wb") as ids, open(f"{name}.offsets{own}", "wb") as offsets, open(f"{name}.docs{own}", "wb") as docs:
            offsets.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                sizes = []
                for some in slices(batch.column(1), TEXTS):
                    for found in encoder.encode_all(some):
                        ids.write(found + end)
                        sizes.append((len(found) + len(end)) // width)
                offsets.write((position + np.cumsum(sizes, dtype="<i8")).tobytes())
                docs.write(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                position, n = position + sum(sizes), n + len(sizes)
        for kind in ("ids", "offsets", "docs"):
            os.replace(f"{name}.{kind}{own}", f"{name}.{kind}")
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([position], pa.int64()), pa.array([width], pa.int32())], ["shard", "n_docs", "n_tokens", "id_bytes"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(write, "shard int, n_docs long, n_tokens long, id_bytes int").write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit) of each document.

    One task maps a shard's files into memory and walks them in batches.
    """
    at = mounted(folder)
    manifest = spark.read.parquet(f"{folder}/manifest")
    # one row a shard: the window over all shards is small whatever the corpus
    based = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["base"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, n, width, base in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                name = f"{at}/shard-{shard:05d}"
                docs = np.memmap(f"{name}.docs", "<i8", "r", shape=(n,))
                offsets = np.memmap(f"{name}.offsets", "<i8", "r", shape=(n + 1,))
                ids = np.memmap(f"{name}.ids", f"<u{width}", "r") if offsets[-1] else np.zeros(0, "<u4")
                a = 0
                while a < n:
                    b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 20))) - 1)
                    step = np.asarray(offsets[a : b + 1])
                    part = np.asarray(ids[step[0] : step[-1]]).astype("<u4").tobytes()
                    cut = (step - step[0]) * 4
                    found = np.asarray(docs[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64(), mask=found == NULL_ID), pa.array(base + step[:-1], pa.int64()), pa.array(np.diff(step), pa.int64()), pa.array([part[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                    a = b

    spread = based.select("shard", "n_docs", "id_bytes", "base").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
