"""Quality by a convolutional network on bytes, in numpy.

Bytes are embedded; learned filters run over overlapping chunks that together cover the whole text. Each
chunk keeps the strongest answer of each filter; a text keeps their mean and maximum over its chunks, which
one linear layer turns into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_mod, map_arrow, table
from .sampling import labelled
from .words import byte_slices, text_bytes

#: Bytes that a chunk's filters begin in; they reach WIDTH - 1 bytes into the next one.
CHUNK, WIDTH, STRIDE = 256, 8, 2
EMBED, FILTERS = 6, 16


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in whole chunks (zeros behind each text, one chunk at least), and where each text's chunks begin."""
    chunks = np.maximum(1, -(-np.diff(offsets) // CHUNK))
    first = np.concatenate([[0], np.cumsum(chunks)])
    out = np.zeros(first[-1] * CHUNK + WIDTH, np.uint8)
    for a, b, c in zip(offsets[:-1], offsets[1:], first[:-1] * CHUNK):
        out[c : c + b - a] = data[a:b]
    return out, first


@dataclass
class Net:
    embed: np.ndarray  # 256, EMBED; the zero byte is no byte and stays zero
    filters: np.ndarray  # WIDTH * EMBED, FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS + 1

    @classmethod
    def fresh(cls, seed: int = 4) -> Net:
        r = np.random.default_rng(seed)
        embed = r.normal(0, 0.5, (256, EMBED))
        embed[0] = 0
        return cls(*(x.astype(np.float32) for x in (embed, r.normal(0, 0.3, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS), np.append(r.normal(0, 0.3, 2 * FILTERS), 0))))

    def windows(self, data: np.ndarray) -> np.ndarray:
        """A row of embedded bytes for each place at which filters look."""
        x = self.embed[data]
        n = (len(data) - WIDTH) // STRIDE
        view = np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (STRIDE * x.strides[0], x.itemsize))
        return np.ascontiguousarray(view)

    def pooled(self, data: np.ndarray, block: int = 256):
        """The strongest answers of each chunk, and where they were (places in the chunk)."""
        n, per = (len(data) - WIDTH) // CHUNK, CHUNK // STRIDE
        top, at = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64)
        for a in range(0, n, block):
            b = min(n, a + block)
            z = (self.windows(data[a * CHUNK : b * CHUNK + WIDTH]) @ self.filters).reshape(b - a, per, FILTERS)
            at[a:b] = z.argmax(1)
            top[a:b] = z.max(1)
        return np.maximum(top + self.bias, 0), at

    def head(self, top: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of each text and its probability."""
        h = np.hstack([np.add.reduceat(top, first[:-1]) / np.diff(first)[:, None], np.maximum.reduceat(top, first[:-1])])
        return h, 1 / (1 + np.exp(-np.clip(h @ self.out[:-1] + self.out[-1], -30, 30)))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        data, first = chunked(data, offsets)
        return self.head(self.strongest(data), first)[1]

    def strongest(self, data: np.ndarray, block: int = 256) -> np.ndarray:
        n, per = (len(data) - WIDTH) // CHUNK, CHUNK // STRIDE
        top = np.empty((n, FILTERS), np.float32)
        for a in range(0, n, block):
            b = min(n, a + block)
            z = self.windows(data[a * CHUNK : b * CHUNK + WIDTH]) @ self.filters
            top[a:b] = z.reshape(b - a, per, FILTERS).max(1)
        return np.maximum(top + self.bias, 0)

    def gradients(self, data: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        data, first = chunked(data, offsets)
        top, at = self.pooled(data)
        h, p = self.head(top, first)
        d = (weight * (p - y)).astype(np.float32)
        g_out = np.append(h.T @ d, d.sum())
        n = np.diff(first)
        owner = np.repeat(np.arange(len(n)), n)
        mean, peak = self.out[:FILTERS], self.out[FILTERS:-1]
        best = top == h[owner, FILTERS:]  # ties all get the gradient
        g = d[owner, None] * (mean / n[owner, None] + peak * best)
        g = np.where(top > 0, g, 0).astype(np.float32)
        g_embed, g_filters = np.zeros_like(self.embed), np.zeros_like(self.filters)
        c, f = np.nonzero(g)
        if len(c):
            start = c * CHUNK + at[c, f] * STRIDE
            seen = data[start[:, None] + np.arange(WIDTH)]
            x = self.embed[seen].reshape(len(c), -1)
            np.add.at(g_filters.T, f, x * g[c, f][:, None])
            np.add.at(g_embed, seen.ravel(), (self.filters.T[f] * g[c, f][:, None]).reshape(-1, EMBED))
            g_embed[0] = 0
        return [g_embed, g_filters, g.sum(0), g_out]


def train(texts: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 9) -> Net:
    """Adam on the weighted log loss."""
    net, rng = Net.fresh(), np.random.default_rng(seed)
    params = [net.embed, net.filters, net.bias, net.out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, weight = 0, weight / weight.mean()
    for e in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])])
            step += 1
            lr = rate * (1 - e / epochs)
            for p, g, a_, b_ in zip(params, net.gradients(data, offsets, y[rows], weight[rows] / len(rows)), m, v):
                a_[:] = 0.9 * a_ + 0.1 * g
                b_[:] = 0.999 * b_ + 0.001 * g * g
                p -= lr * (a_ / (1 - 0.9**step)) / (np.sqrt(b_ / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_chars: int = 16_000_000) -> Net | None:
    """Learn from docs (doc_id, text) and labels (doc_id, quality 0 or 1): a sample of at most per_class rows and
    most_chars characters of either label. Of labels that contradict each other the better counts."""
    sample = labelled(docs, labels, [F.max("quality").alias("quality")], "quality", per_class, most_chars)
    rows = sample.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "quality", "share").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([r["quality"] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return train([r["text"].encode() for r in rows], y, np.array([1 / r["share"] for r in rows]))


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, score and predicted for each row of docs (doc_id, text); 0.5 where nothing could be learned."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def run(b):
        data, offsets = text_bytes(b.column(1))
        for lo, hi in byte_slices(offsets):
            p = shared.value.predict(data, offsets[lo : hi + 1]) if shared.value else np.full(hi - lo, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p.astype(np.float64)), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from labels of those whose crc32(doc_id) mod 3 is not 1; null text is empty."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = id_mod(F.col("doc_id"), 3) != 1
    net = fit(docs.where(seen).select("doc_id", "text"), labels.where(seen))
    return score(docs, net).withColumn("held_out", id_mod(F.col("doc_id"), 3) == 1).select("doc_id", "held_out", "score", "predicted")
