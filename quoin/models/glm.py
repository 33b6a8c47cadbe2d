"""Generalised linear models on rows (x array<double>, y double).

Each iteration is one aggregation: partitions sum their part of the gradient and Hessian, Spark sums those
cell by cell, and the driver takes a step of p numbers. An intercept column is added and not penalised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linalg import _sum_of


#: Columns, the intercept's included, up to which sums of products are expressions of one aggregation.
JVM_COLUMNS = 12


def _design(b: pa.RecordBatch, p: int) -> np.ndarray:
    """The rows x of a batch, and a column of ones."""
    out = np.ones((b.num_rows, p))
    out[:, :-1] = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, p - 1)
    return out


class GLM:
    """penalty: None, l1, l2 or elasticnet; solver: newton (newton-cg), irls, lbfgs, gd, sgd or block_sgd."""

    def __init__(self, penalty=None, alpha: float = 1.0, l1_ratio: float = 0.5, tol: float = 1e-4, max_iter: int = 100, solver: str = "newton", lr: float = 1e-2, seed: int = 0):
        self.penalty, self.alpha, self.l1_ratio = penalty, alpha, l1_ratio
        self.tol, self.max_iter, self.solver, self.lr, self.seed = tol, max_iter, solver, lr, seed
        self.beta: np.ndarray | None = None

    #: Whether the loss is a quadratic in beta, so that one pass gives it, its gradient and its Hessian everywhere.
    quadratic = False

    # what a family defines, on arrays
    @staticmethod
    def mean(eta: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    @staticmethod
    def weight(mu: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    @staticmethod
    def loss(eta: np.ndarray, y: np.ndarray) -> float:
        raise NotImplementedError

    @staticmethod
    def deviance(y: np.ndarray, mu: np.ndarray) -> float:
        raise NotImplementedError

    def rates(self) -> tuple[float, float]:
        """l1 and l2 of the gradient."""
        a, r = self.alpha, self.l1_ratio
        return {None: (0.0, 0.0), "l1": (a, 0.0), "l2": (0.0, a), "elasticnet": (r * a, 0.5 * (1 - r) * a)}[self.penalty]

    def _penalty(self, beta: np.ndarray) -> np.ndarray:
        l1, l2 = self.rates()
        g = l2 * beta + l1 * np.sign(beta)
        g[-1] = 0
        return g

    def _sums(self, rows: DataFrame, beta: np.ndarray, hessian: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and Hessian without penalties."""
        p, mean, weight, loss = len(beta), self.mean, self.weight, self.loss

        def part(b: pa.RecordBatch) -> np.ndarray:
            x, y = _design(b, p), b.column(1).to_numpy(zero_copy_only=False).astype(float)
            eta = x @ beta
            mu = mean(eta)
            out = np.zeros((p + 2 if hessian else 2, p))
            out[0, 0], out[1] = loss(eta, y), x.T @ (mu - y)
            if hessian:
                out[2:] = (x * weight(mu)[:, None]).T @ x
            return out

        got = _sum_of(rows.select("x", "y"), part, (p + 2 if hessian else 2, p), arrow=True)
        return got[0, 0], got[1], got[2:]

    def _squares(self, rows: DataFrame, p: int) -> tuple[float, np.ndarray, np.ndarray]:
        """As _sums at 0 where the loss is a quadratic: sums of products, in the JVM unless there are too many for a plan."""
        if p > JVM_COLUMNS:
            return self._sums(rows, np.zeros(p))
        z = [*(F.coalesce(F.col("x")[i], F.lit(float("nan"))) for i in range(p - 1)), F.lit(1.0), F.coalesce("y", F.lit(float("nan")))]
        pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
        got = rows.agg(*(F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i, j in pairs)).first()
        m = np.zeros((p + 1, p + 1))
        for (i, j), v in zip(pairs, got):
            m[i, j] = m[j, i] = v
        return m[-1, -1] / 2, -m[:-1, -1], m[:-1, :-1]

    def fit(self, rows: DataFrame) -> GLM:
        rows = rows.select("x", "y")
        if not (self.quadratic and self.solver == "lbfgs"):  # that reads the rows once
            rows = rows.persist()
        p = rows.select(F.size("x")).first()[0] + 1
        solvers = {"newton": self._newton, "newton-cg": self._newton, "irls": self._irls, "lbfgs": self._lbfgs, "gd": self._gd, "sgd": self._sgd, "block_sgd": self._sgd}
        if self.solver not in solvers:
            raise ValueError(f"unknown solver {self.solver}")
        try:
            self.beta = solvers[self.solver](rows, np.zeros(p))
        finally:
            rows.unpersist()
        return self

    def _newton(self, rows: DataFrame, beta: np.ndarray) -> np.ndarray:
        ridge = np.diag(np.append(np.full(len(beta) - 1, self.rates()[1]), 0))
        for _ in range(self.max_iter):
            _, g, h = self._sums(rows, beta)
            g = g + self._penalty(beta)
            beta = beta - np.linalg.solve(h + ridge, g)
            if np.abs(g).max() <= self.tol:
                break
        return beta

    def _irls(self, rows: DataFrame, beta: np.ndarray) -> np.ndarray:
        """Reweighted least squares; penalties play no part."""
        for _ in range(self.max_iter):
            _, g, h = self._sums(rows, beta)
            beta = np.linalg.solve(h, h @ beta - g)
            if np.abs(g).max() <= self.tol:
                break
        return beta

    def _gd(self, rows: DataFrame, beta: np.ndarray) -> np.ndarray:
        for _ in range(self.max_iter):
            _, g, _ = self._sums(rows, beta, hessian=False)
            g = g + self._penalty(beta)
            beta = beta - self.lr * g
            if np.abs(g).max() <= self.tol:
                break
        return beta

    def _sgd(self, rows: DataFrame, beta: np.ndarray) -> np.ndarray:
        """Steps on hash-dealt batches: an eighth of the rows for block_sgd, about 64 rows for sgd."""
        n = rows.count()
        batches = 8 if self.solver == "block_sgd" else max(1, n // 64)
        dealt = rows.withColumn("batch", F.pmod(F.xxhash64("x", "y", F.lit(self.seed)), F.lit(batches))).persist()
        for step in range(self.max_iter):
            batch = dealt.where(F.col("batch") == step % batches)
            _, g, _ = self._sums(batch, beta, hessian=False)
            g = g * batches + self._penalty(beta)
            beta = beta - self.lr * g
            if np.abs(g).max() <= self.tol:
                break
        dealt.unpersist()
        return beta

    def _objective(self, rows: DataFrame, p: int):
        """A function of beta: the penalised loss and its gradient."""
        l1, l2 = self.rates()
        value0, g0, h = self._squares(rows, p) if self.quadratic else (0.0, None, None)

        def at(beta: np.ndarray) -> tuple[float, np.ndarray]:
            if self.quadratic:
                value, g = value0 + g0 @ beta + beta @ h @ beta / 2, g0 + h @ beta
            else:
                value, g, _ = self._sums(rows, beta, hessian=False)
            return value + l1 * np.abs(beta[:-1]).sum() + l2 / 2 * (beta[:-1] ** 2).sum(), g + self._penalty(beta)

        return at

    def _lbfgs(self, rows: DataFrame, beta: np.ndarray, memory: int = 10) -> np.ndarray:
        """Two-loop recursion and a backtracking line search of Armijo's condition; where the values differ by no more
        than their rounding, of the slope's. It ends where no step along the gradient itself is of use."""
        objective = self._objective(rows, len(beta))
        value, g = objective(beta)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(self.max_iter):
            if np.abs(g).max() <= self.tol:
                break
            d, factors = g.copy(), []
            for s, y in reversed(pairs):
                a = s @ d / (s @ y)
                factors.append(a)
                d -= a * y
            d *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(g).sum())
            for (s, y), a in zip(pairs, reversed(factors)):
                d += s * (a - y @ d / (s @ y))
            step, slope = 1.0, g @ d
            while step >= 1e-10:
                to = beta - step * d
                after, g_after = objective(to)
                if after <= value - 1e-4 * step * slope or (after <= value + 1e-12 * abs(value) and abs(g_after @ d) <= 0.9 * abs(slope)):
                    break
                step *= 0.5
            else:
                if not pairs:
                    break
                pairs = []
                continue
            if (to - beta) @ (g_after - g) > 1e-12 * np.linalg.norm(to - beta) * np.linalg.norm(g_after - g):
                pairs = [*pairs[-memory + 1 :], (to - beta, g_after - g)]
            beta, value, g = to, after, g_after
        return beta

    # prediction stays in the JVM
    def eta(self, x=None):
        x = F.col("x") if x is None else x
        terms = F.zip_with(x, F.array(*map(F.lit, self.beta[:-1].tolist())), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(float(self.beta[-1])), lambda a, b: a + b)

    def link(self, eta):
        return eta

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", self.link(self.eta()))

    def deviance_sqr(self, rows: DataFrame) -> float:
        """1 - deviance / deviance of the mean."""
        centre = rows.agg(F.avg("y")).first()[0]
        beta, mean, deviance = self.beta, self.mean, self.deviance

        def part(b: pa.RecordBatch) -> np.ndarray:
            x, y = _design(b, len(beta)), b.column(1).to_numpy(zero_copy_only=False).astype(float)
            return np.array([[deviance(y, mean(x @ beta)), deviance(y, np.full(len(y), centre))]])

        own, null = _sum_of(rows.select("x", "y"), part, (1, 2), arrow=True)[0]
        return 1 - own / null


class LinearRegression(GLM):
    quadratic = True
    mean = staticmethod(lambda eta: eta)
    weight = staticmethod(np.ones_like)
    loss = staticmethod(lambda eta, y: float(((eta - y) ** 2).sum() / 2))
    deviance = staticmethod(lambda y, mu: float(((y - mu) ** 2).sum()))


class Ridge(LinearRegression):
    """Solves (X'X + alpha / 2) b = X'y."""

    def __init__(self, alpha: float = 1.0, **kw):
        super().__init__("l2", alpha, **kw)

    def rates(self):
        return 0.0, 0.5 * self.alpha


class Lasso(LinearRegression):
    """By the subgradient alpha * sign(b), without a threshold: no exact zeros."""

    def __init__(self, alpha: float = 1.0, **kw):
        super().__init__("l1", alpha, **kw)


class ElasticNet(LinearRegression):
    def __init__(self, alpha: float = 1.0, l1_ratio: float = 0.5, **kw):
        super().__init__("elasticnet", alpha, l1_ratio, **kw)


class LogisticRegression(GLM):
    """alpha is 1 / C; probabilities are in the order [1, 0]."""

    def __init__(self, penalty=None, C: float = 1.0, **kw):  # noqa: N803
        super().__init__(penalty, 1.0 / C, **kw)

    mean = staticmethod(lambda eta: 1 / (1 + np.exp(-np.clip(eta, -500, 500))))
    weight = staticmethod(lambda mu: mu * (1 - mu))
    loss = staticmethod(lambda eta, y: float((np.logaddexp(0, eta) - y * eta).sum()))
    deviance = staticmethod(lambda y, mu: float(-2 * (y * np.log(np.clip(mu, 1e-15, 1)) + (1 - y) * np.log(np.clip(1 - mu, 1e-15, 1))).sum()))

    def link(self, eta):
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        p = self.link(self.eta())
        return rows.withColumn("probability", F.array(p, 1 - p))

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", (self.link(self.eta()) > 0.5).cast("double"))


class PoissonRegression(GLM):
    """Logarithmic link; penalties play no part."""

    def rates(self):
        return 0.0, 0.0

    mean = staticmethod(lambda eta: np.exp(np.clip(eta, -50, 50)))
    weight = staticmethod(lambda mu: mu)
    loss = staticmethod(lambda eta, y: float((np.exp(np.clip(eta, -50, 50)) - y * eta).sum()))
    deviance = staticmethod(lambda y, mu: float(2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu)).sum()))

    def link(self, eta):
        return F.exp(eta)


PoissonRegressor = PoissonRegression
