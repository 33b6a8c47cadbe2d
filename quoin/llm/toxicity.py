"""Toxicity by a classifier chain: one linear model a category, each fed the probabilities of those before.

The categories are what the labels table says of a text: whether it is of low quality, then whether it is toxic.
Each link is a logistic regression on the words and the beginnings of words that a text holds, hashed into a fixed
number of buckets, learned by FTRL with elastic-net penalties, so that few of the buckets have a weight. Later
links learn from out-of-fold probabilities of earlier ones, so that they see them as wrong as they will be; no
feature is picked by a label, so that the folds stay apart.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ftrl
from .common import map_arrow, table, without_ids
from .sampling import labelled
from .words import word_stem_hashes

CATEGORIES = ("low_quality", "toxic")
STEMS = (4, 5, 6, 7, 8, 9)
#: Buckets of words and stems.
LOG2_BUCKETS = 20
BUCKETS = 1 << LOG2_BUCKETS


def held_buckets(col: pa.Array, live: np.ndarray | None = None):
    """For ranges of texts: the sorted distinct buckets (of those that are live) of each, as owner << LOG2_BUCKETS | bucket."""
    for lo, hi, words, at, stems in word_stem_hashes(col, STEMS):
        owner = np.repeat(np.arange(hi - lo), np.diff(at))
        keys = []
        for h, o in ((words, owner), *((h, owner[i]) for i, h in stems)):
            bucket = (h >> np.uint64(64 - LOG2_BUCKETS)).astype(np.int64)
            if live is not None:
                near = np.flatnonzero(live[bucket])
                bucket, o = bucket[near], o[near]
            keys.append((o << LOG2_BUCKETS) | bucket)
        yield lo, hi, np.unique(np.concatenate(keys))


@dataclass
class Chain:
    """links: weights of each category: buckets, earlier probabilities, bias."""

    links: list = field(default_factory=list)
    threshold: float = 0.5  # of the last category

    def live(self) -> np.ndarray:
        return np.any([w[:BUCKETS, 0] != 0 for w in self.links], 0)

    def predict(self, keys: np.ndarray, n: int) -> np.ndarray:
        """A column of probabilities for each category of n texts given by their buckets; 0 where nothing was learned."""
        owner, bucket = keys >> LOG2_BUCKETS, keys & (BUCKETS - 1)
        out = np.zeros((n, len(CATEGORIES)))
        for k, w in enumerate(self.links):
            z = np.bincount(owner, weights=w[bucket, 0], minlength=n) + w[-1, 0]
            out[:, k] = ftrl.chances((z + out[:, :k] @ w[BUCKETS:-1, 0])[:, None])[:, 0]
        return out


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the best F score that counts precision twice, the highest of equals."""
    grid = np.linspace(0.9, 0.1, 81)
    total = (weight * y).sum()
    score = [1.25 * (weight * y)[p >= t].sum() / max(1e-9, weight[p >= t].sum() + 0.25 * total) for t in grid]
    return float(grid[int(np.argmax(score))])


def fit_chain(x: ftrl.Rows, ys: np.ndarray, weight: np.ndarray, folds: int = 3, seed: int = 1) -> tuple[list, np.ndarray]:
    """A link for each column of ys (NaN: not known, and not learned from), and out-of-fold probabilities, as which
    the columns before it enter."""
    fold = np.random.default_rng(seed).integers(0, folds, len(x))
    before, links = np.zeros((len(x), 0)), []
    for k in range(ys.shape[1]):
        known = ~np.isnan(ys[:, k])
        sizes = x.sizes + k
        idx, val = np.empty(sizes.sum(), np.int64), np.ones(sizes.sum(), np.float32)
        starts = np.cumsum(sizes) - sizes
        own = np.ones(len(idx), bool)
        for j in range(k):
            at = starts + x.sizes + j
            idx[at], val[at], own[at] = BUCKETS + j, before[:, j], False
        idx[own], val[own] = x.idx, x.val
        z = ftrl.Rows(sizes, idx, val)
        learn = lambda rows: ftrl.fit(z, np.nan_to_num(ys[:, k : k + 1]), BUCKETS + k, rows, weight, alpha=1.0, l1=0.5, epochs=4, steps=400)  # noqa: E731, B023
        links.append(learn(np.flatnonzero(known)).astype(np.float32))
        apart = np.zeros((len(x), 1))
        for f in range(folds):
            if (fold == f).any() and ((fold != f) & known).any():
                apart[fold == f] = ftrl.chances(z.take(np.flatnonzero(fold == f)).times(learn(np.flatnonzero((fold != f) & known))))
        before = np.hstack([before, apart])
    return links, before


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Chain:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic, quality): a sample of at most per_class rows of
    either value of toxic. Of labels that contradict each other the worse counts: toxic, of low quality."""
    marks = [F.max("toxic").alias("toxic"), F.min("quality").alias("quality")]
    rows = labelled(docs, labels, marks, "toxic", per_class)

    def features(b):
        for lo, hi, keys in held_buckets(b.column(1)):
            cuts = np.searchsorted(keys >> LOG2_BUCKETS, np.arange(hi - lo + 1))
            held = (keys & (BUCKETS - 1)).astype("<i4")
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in (0, 2, 3, 4)), pa.array([held[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], names=["doc_id", "toxic", "quality", "share", "held"])

    got = map_arrow(rows.select("doc_id", "text", F.col("toxic").cast("int"), F.col("quality").cast("int"), "share"), features, "doc_id long, toxic int, quality int, share double, held binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["held"]))
    toxic = np.array([r["toxic"] for r in got], float)
    if not len(got) or toxic.min() == toxic.max():
        return Chain()
    low = np.array([1.0 - r["quality"] if r["quality"] in (0, 1) else np.nan for r in got])
    held = [np.frombuffer(r["held"], "<i4") for r in got]
    x = ftrl.Rows(np.array([len(h) for h in held]), np.concatenate(held).astype(np.int64), np.ones(sum(map(len, held)), np.float32))
    weight = np.array([1 / r["share"] for r in got])
    links, apart = fit_chain(x, np.stack([low, toxic], 1), weight / weight.mean())
    return Chain(links, best_threshold(apart[:, -1], toxic, weight))


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, low_quality and score (probabilities; score is that of toxic) and toxic (score at least the chain's threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # BUCKETS numbers a link

    def run(b):
        own = shared.value
        live = own.live() if own.links else np.zeros(BUCKETS, bool)
        for lo, hi, keys in held_buckets(b.column(1), live):
            p = own.predict(keys, hi - lo)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] >= own.threshold)], names=["doc_id", "low_quality", "score", "toxic"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, low_quality double, score double, toxic boolean")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its probabilities and whether it is toxic; empty and null texts hold no feature."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs less those that the chain calls toxic."""
    return without_ids(docs, classify(docs, fit(docs, labels)).where("toxic").select("doc_id"))
