"""Language ID with a byte convolutional network, written and trained in numpy.

Bytes are embedded, filters of several widths slide over a window, their largest responses are pooled and a softmax gives the
languages. A text is cut into windows of fixed length that overlap by the widest filter less one; its prediction is the mean
of its windows' probabilities, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import values

WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 10
STEP = WINDOW - max(WIDTHS) + 1


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(n, WINDOW) bytes, zero-padded, and the number of bytes of each."""
    n = max(1, -(-(len(text) - max(WIDTHS) + 1) // STEP)) if text else 0
    flat = np.zeros(n * STEP + WINDOW, dtype=np.uint8)
    flat[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    out = np.lib.stride_tricks.as_strided(flat, (n, WINDOW), (STEP, 1)).copy()
    return out, np.minimum(WINDOW, len(text) - STEP * np.arange(n)).astype(np.float32)


class ByteCnn:
    """embedding -> convolutions -> relu, max over positions -> softmax."""

    def __init__(self, classes: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.classes = classes
        wide, pooled = max(WIDTHS), len(WIDTHS) * FILTERS
        self.mask = np.zeros((wide, EMBED, pooled), np.float32)  # a narrow filter is a wide one with zeros
        for i, w in enumerate(WIDTHS):
            self.mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(wide * EMBED, pooled)
        init = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.p = {"e": init(256, EMBED, scale=0.5), "w": init(wide * EMBED, pooled, scale=0.3) * self.mask, "b": np.zeros(pooled, np.float32), "u": init(pooled, len(classes), scale=0.3), "c": np.zeros(len(classes), np.float32)}

    def patches(self, x: np.ndarray) -> np.ndarray:
        """(n, positions, widest * EMBED)."""
        e, wide = self.p["e"][x], max(WIDTHS)
        return np.concatenate([e[:, o : x.shape[1] - wide + 1 + o] for o in range(wide)], axis=2)

    def forward(self, x: np.ndarray):
        p = self.patches(x)
        n, m, _ = p.shape
        r = (p.reshape(n * m, -1) @ self.p["w"]).reshape(n, m, -1)
        at = r.argmax(axis=1)
        top = np.take_along_axis(r, at[:, None, :], 1)[:, 0] + self.p["b"]
        h = np.maximum(top, 0)
        return p, at, h, softmax(h @ self.p["u"] + self.p["c"])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of windows, 64 at a time so that memory stays small."""
        out = np.zeros((len(x), len(self.classes)), np.float32)
        for a in range(0, len(x), 64):
            p = self.patches(x[a : a + 64])
            r = (p.reshape(-1, p.shape[2]) @ self.p["w"]).reshape(p.shape[0], p.shape[1], -1).max(axis=1)
            out[a : a + 64] = softmax(np.maximum(r + self.p["b"], 0) @ self.p["u"] + self.p["c"])
        return out

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 4e-3, seed: int = 4) -> ByteCnn:
        """Adam on the mean cross-entropy."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        wide = max(WIDTHS)
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            xb, yb = x[pick], y[pick]
            p, at, h, q = self.forward(xb)
            d = q.copy()
            d[np.arange(batch), yb] -= 1
            d /= batch
            g = {"u": h.T @ d, "c": d.sum(0)}
            dh = (d @ self.p["u"].T) * (h > 0)
            g["b"] = dh.sum(0)
            won = np.take_along_axis(p, at[:, :, None], 1)  # (batch, filters, patch) that gave the maxima
            g["w"] = np.einsum("nfk,nf->kf", won, dh) * self.mask
            back = (dh[:, :, None] * self.p["w"].T[None]).reshape(batch, -1, wide, EMBED)
            g["e"] = np.zeros_like(self.p["e"])
            where = xb[np.arange(batch)[:, None, None], at[:, :, None] + np.arange(wide)[None, None]]
            np.add.at(g["e"], where, back)
            for k in self.p:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                self.p[k] = self.p[k] - (rate * min(1, 3 * (1 - t / steps) + 0.05) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit_language_model(df: DataFrame, max_rows: int = 1500, text: str = "text", lang: str = "lang", key: str = "doc_id", max_windows: int = 24) -> ByteCnn | None:
    """A network fitted on at most max_rows labelled rows (the smallest hashes of their keys), spread evenly over each one's windows.

    None without labelled texts. The driver gets at most max_rows * max_windows windows.
    """
    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, y = [], []
            for label, t in zip(b.column(0).to_pylist(), values(b.column(1)), strict=True):
                x, _ = windows(t.encode())
                pick = np.unique(np.linspace(0, len(x) - 1, max_windows).astype(int))
                w += [r.tobytes() for r in x[pick]]
                y += [label] * len(pick)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.string()), pa.array(w, pa.binary())], ["lang", "window"])

    # the ids first, so that texts of the sample alone are sorted
    chosen = rows.select("k", F.xxhash64("k").alias("h")).orderBy("h", "k").limit(max_rows).select("k").distinct()
    got = rows.join(F.broadcast(chosen), "k", "left_semi").select("lang", "text").mapInArrow(cut, "lang string, window binary").orderBy(F.xxhash64("window")).limit(max_rows * max_windows).toArrow()
    if not got.num_rows:
        return None
    labels = got.column("lang").to_pylist()
    classes = sorted(set(labels))
    x = np.frombuffer(b"".join(got.column("window").to_pylist()), dtype=np.uint8).reshape(-1, WINDOW)
    y = np.array([classes.index(v) for v in labels])
    return ByteCnn(classes).train(x, y)


def predict_language(df: DataFrame, model: ByteCnn | None, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the predicted language and its probability (0 to 1), from the whole text.

    Null texts, texts without a letter and an absent model give `und` with probability 1.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang string, score double>")
    def predict(texts: pa.Array) -> pa.Array:
        model, names, scores = held.value, [], []
        for a in range(0, len(texts), 200):
            part = texts.slice(a, 200).to_pylist()
            usable = [t if model and t and any(map(str.isalpha, t)) else None for t in part]
            for t in usable:
                if t is None:
                    names.append("und")
                    scores.append(1.0)
                    continue
                x, n = windows(t.encode())
                q = (n @ np.concatenate([model.predict(x[i : i + 4096]) for i in range(0, len(x), 4096)])) / n.sum()
                k = int(q.argmax())
                names.append(model.classes[k])
                scores.append(min(1.0, max(0.0, float(q[k]))))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    both = df.withColumn("__p", predict(F.col(text).cast("string")))
    return both.select(*[F.col(f"`{c}`") for c in df.columns if c not in (out, score)], F.col("__p.lang").alias(out), F.col("__p.score").alias(score))
