"""Sparse logistic regression by follow-the-regularised-leader with elastic-net penalties, on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: features idx[ends[i - 1] : ends[i]] of row i, with their values."""

    sizes: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    def __post_init__(self) -> None:
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.sizes)

    def take(self, rows: np.ndarray) -> Rows:
        n = self.sizes[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return Rows(n, self.idx[at], self.val[at])

    def times(self, w: np.ndarray) -> np.ndarray:
        """Products with a matrix of weights a feature, its last row for the bias."""
        out = np.zeros((len(self), w.shape[1]))
        for a in range(0, len(self), 256):
            b = min(a + 256, len(self))
            lo, hi = self.starts[a], self.starts[b]
            part = np.zeros((hi - lo + 1, w.shape[1]))
            np.cumsum(self.val[lo:hi, None] * w[self.idx[lo:hi]], 0, out=part[1:])
            out[a:b] = part[self.starts[a + 1 : b + 1] - lo] - part[self.starts[a:b] - lo]
        return out + w[-1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def chances(z: np.ndarray) -> np.ndarray:
    """Probabilities of classes, or of the one class."""
    return softmax(z) if z.shape[1] > 1 else 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Rows, y: np.ndarray, features: int, rows: np.ndarray, weight: np.ndarray | None = None, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-3, epochs=6, batch=16, seed=7, steps=800) -> np.ndarray:
    """Weights (features + 1 bias, classes), learned from mini-batches of the given rows; a step touches the
    features of its batch alone. y: a column a class (one: yes or no). Small samples are gone over more often."""
    epochs = max(epochs, -(-steps * batch // max(1, len(rows))))
    z, n = np.zeros((features + 1, y.shape[1])), np.zeros((features + 1, y.shape[1]))
    rng = np.random.default_rng(seed)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        order = rng.permutation(rows)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            part = x.take(some)
            own, place = np.unique(part.idx, return_inverse=True)
            own = np.append(own, features)
            w = weights(z[own], n[own])
            d = chances(Rows(part.sizes, place, part.val).times(w)) - y[some]
            d *= (1 if weight is None else weight[some][:, None]) / len(some)
            g = np.zeros_like(w)
            g[-1] = d.sum(0)
            if len(place):
                by = np.argsort(place, kind="stable")
                g[:-1] = np.add.reduceat((part.val[:, None] * np.repeat(d, part.sizes, 0))[by], np.flatnonzero(np.diff(place[by], prepend=-1)))
            z[own] += g - (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / alpha * w
            n[own] += g * g
    return weights(z, n)
