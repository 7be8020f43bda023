"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One set of weights over hashed features of the text gives a score s; ordered thresholds t_0 < t_1 < ... turn it into
P(grade <= k) = sigmoid(t_k - s). Features are words, word shapes and repetition, each with the square root of its
share of the text, so texts of any length have one scale. Whole texts are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, values

DIM = 1 << 18
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class Features:
    """Hashed features of texts; words are kept in a bounded table."""

    def __init__(self, keep: int = 150_000):
        self.keep, self.of, self.word, self.shape = keep, {}, [], []

    def learn(self, w: str) -> int:
        bare = w.strip(EDGE).lower()
        kind = "A" if w.isupper() else "a" if w.islower() else "0" if w.isnumeric() else "Aa" if w.istitle() else "x"
        head, tail = w[: len(w) - len(w.lstrip(EDGE))], w[len(w.rstrip(EDGE)) :] if bare else ""
        self.word.append(zlib.crc32(b"w" + bare.encode()) % DIM)
        self.shape.append(zlib.crc32(f"s{head[:3]}|{kind}{min(len(bare), 12) // 4}|{tail[:3]}".encode()) % DIM)
        self.of[w] = n = len(self.word) - 1
        return n

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, values)."""
        words = (text or "").split()
        if not words:
            return np.array([zlib.crc32(b"#empty") % DIM]), np.ones(1, np.float32)
        of = self.of
        if len(of) > self.keep:
            of.clear()
            self.word.clear()
            self.shape.clear()
        for w in set(words):
            if w not in of:
                self.learn(w)
        ids, n = np.fromiter(map(of.__getitem__, words), dtype=np.int64, count=len(words)), len(words)
        seen, count = np.unique(ids, return_counts=True)
        word = np.array([self.word[i] for i in seen.tolist()])
        shapes, place = np.unique([self.shape[i] for i in seen.tolist()], return_inverse=True)
        lines = [x for x in text.split("\n") if x]
        measures = {"adjacent": (ids[1:] == ids[:-1]).mean() if n > 1 else 0.0, "words": 1 - len(seen) / n, "lines": 1 - len(set(lines)) / max(1, len(lines))}
        extra = [zlib.crc32(f"#{k}{int(10 * v)}".encode()) % DIM for k, v in measures.items()]
        return np.concatenate([word, shapes, extra]), np.concatenate([np.sqrt(count / n), np.sqrt(np.bincount(place, weights=count) / n), np.full(len(extra), 0.3)]).astype(np.float32)


class OrdinalModel:
    """Weights and ordered thresholds, fitted with Adagrad on the mean negative log-likelihood."""

    def __init__(self, grades: int):
        self.w = np.zeros(DIM, np.float32)
        self.t = np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(grades - 1)

    def tails(self, s: np.ndarray) -> np.ndarray:
        """(n, grades - 1): P(grade > k)."""
        return 1 / (1 + np.exp(np.clip(self.t[None] - s[:, None], -40, 40)))

    def fit(self, index: np.ndarray, value: np.ndarray, ends: np.ndarray, grade: np.ndarray, epochs: int = 40, batch: int = 100, rate: float = 5.0, decay: float = 1e-6, seed: int = 9) -> OrdinalModel:
        rng, n, k = np.random.default_rng(seed), len(grade), len(self.t)
        starts = np.concatenate([[0], ends[:-1]])
        gw2, gt2 = np.full(DIM, 1e-3, np.float32), np.full(k, 1e-2)
        for epoch in range(epochs):
            order = rng.permutation(n)
            for a in range(0, n, batch):
                pick = order[a : a + batch]
                size = ends[pick] - starts[pick]
                row = np.repeat(np.arange(len(pick)), size)
                flat = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[pick], size)
                i, v = index[flat], value[flat]
                s = np.bincount(row, weights=v * self.w[i], minlength=len(pick))
                below = np.concatenate([np.zeros((len(pick), 1)), 1 - self.tails(s), np.ones((len(pick), 1))], axis=1)
                y, r = grade[pick], np.arange(len(pick))
                p = np.maximum(below[r, y + 1] - below[r, y], 1e-9)
                d = below * (1 - below)  # of the sigmoids with respect to the threshold
                upper, lower = d[r, y + 1] / p, d[r, y] / p
                ds = upper - lower
                gt = np.bincount(np.clip(y, 0, k - 1), weights=-upper * (y < k), minlength=k) + np.bincount(np.clip(y - 1, 0, k - 1), weights=lower * (y > 0), minlength=k)
                u, at = np.unique(i, return_inverse=True)
                g = np.bincount(at, weights=v * ds[row]) / len(pick) + decay * self.w[u]
                gw2[u] += g * g
                self.w[u] -= rate / (1 + 0.05 * epoch) * g / np.sqrt(gw2[u])
                gt /= len(pick)
                gt2 += gt * gt
                self.t = np.maximum.accumulate(self.t - 0.1 * gt / np.sqrt(gt2))
        return self


@kept_in_worker
def features() -> Features:
    return Features()


def fit_quality_model(df: DataFrame, grade: str = "grade", grades: int = 3, max_rows: int = 6000, text: str = "text", key: str = "doc_id") -> OrdinalModel | None:
    """A model fitted on at most max_rows rated rows, those with the smallest hashes of their keys. None without rated rows.

    Rows whose grade is null are left out. The driver gets the features of the sample only.
    """

    @F.arrow_udf("struct<i array<int>, v array<float>>")
    def hashed(texts: pa.Array) -> pa.Array:
        made = [features()(t) for t in values(texts)]
        return pa.StructArray.from_arrays([pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())), pa.array([v for _, v in made], pa.list_(pa.float32()))], ["i", "v"])

    rated = df.filter(F.col(grade).isNotNull()).select(F.col(key).alias("k"), F.col(grade).cast("int").alias("grade"), F.col(text).cast("string").alias("text"))
    chosen = rated.select("k").orderBy(F.xxhash64("k"), "k").limit(max_rows).distinct()
    got = rated.join(F.broadcast(chosen), "k", "left_semi").select("k", "grade", hashed("text").alias("x")).orderBy("k", "grade").limit(max_rows).toArrow()
    if not got.num_rows:
        return None
    x = got.column("x").combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    i, v = x.field("i"), x.field("v")
    ends = i.offsets.to_numpy()[1:] - i.offsets.to_numpy()[0]
    return OrdinalModel(grades).fit(i.flatten().to_numpy().astype(np.int64), v.flatten().to_numpy(), ends.astype(np.int64), np.clip(got.column("grade").to_numpy(), 0, grades - 1))


def rate_quality(df: DataFrame, model: OrdinalModel | None, text: str = "text", expected: str = "expected_grade", tail: str = "tail_probability") -> DataFrame:
    """df with the expected grade and the tail probability, P(highest grade), in place of columns of these names.

    Without a model every row gets the highest grade 0 with probability 1, so nothing is rejected. Null texts are empty ones.
    Repeated rows are rated alike; an empty table stays empty.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected double, tail double>")
    def rate(texts: pa.Array) -> pa.Array:
        model = held.value
        if model is None:
            return pa.StructArray.from_arrays([pa.array(np.zeros(len(texts))), pa.array(np.ones(len(texts)))], ["expected", "tail"])
        s = np.zeros(len(texts))
        for k, t in enumerate(values(texts)):
            i, v = features()(t)
            s[k] = float(model.w[i] @ v)
        p = model.tails(s)
        return pa.StructArray.from_arrays([pa.array(p.sum(axis=1)), pa.array(p[:, -1])], ["expected", "tail"])

    out = df.withColumn("__r", rate(F.col(text).cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in (expected, tail)], F.col("__r.expected").alias(expected), F.col("__r.tail").alias(tail))


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rated documents: grade 0 for toxic ones, 1 for low quality, 2 for the rest; several ratings of one document give its lowest.

    Toxic documents are the lowest grade, as a few words have to outweigh an otherwise good text.

    Ratings without quality are left out; an unknown toxicity counts as none.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(grade).alias("__grade"))
    return docs.join(known, "doc_id").select("doc_id", "text", F.col("__grade").alias("grade"))


#: Documents with a smaller probability of the highest grade are rejected.
CUT = 0.5


def select_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT, expected: str = "expected_grade", tail: str = "tail_probability", keep: str = "keep") -> DataFrame:
    """docs with the expected grade, the tail probability and whether to keep, by a model fitted on the labelled ones.

    The three come in place of columns of their names, which callers may choose. A probability equal to the cut is kept.
    Repeated rows are rated alike. Without labels all are kept; an empty table stays empty.
    """
    return rate_quality(docs, fit_quality_model(graded(docs, labels)), expected=expected, tail=tail).withColumn(keep, F.col(tail) >= cut)
