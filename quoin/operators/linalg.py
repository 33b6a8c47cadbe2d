"""Tall matrices: Gram sums, QR by a tree of small factors, SVD, projections and least squares.
Columns may depend on one another: Q then has null columns, and least squares the solution of the least norm.

A tall matrix is a frame of rows (i, x array<double>). Only p x p matrices reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..darray import DArray, from_numpy
from ..session import shared_folder, spark


def stored_rows(a: DArray) -> DataFrame:
    """rows_of a, written once for several passes."""
    path = shared_folder("rows")
    rows_of(a).write.parquet(path)
    return spark().read.parquet(path)


def rows_of(a: DArray) -> DataFrame:
    """i and x (the row as an array) of a matrix."""
    cells = F.array_sort(F.collect_list(F.struct("i1", F.col("v").cast("double").alias("v"))))
    return a.df.groupBy(F.col("i0").alias("i")).agg(cells.alias("c")).select("i", F.col("c.v").alias("x"))


def cells_of(rows: DataFrame, shape) -> DArray:
    return DArray(rows.select(F.col("i").alias("i0"), F.posexplode("x").alias("k", "v")).select("i0", F.col("k").cast("bigint").alias("i1"), "v"), shape)


def _matrix(col) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in col]) if len(col) else np.zeros((0, 0))


def _sum_of(rows: DataFrame, part, shape: tuple, arrow: bool = False) -> np.ndarray:
    """The sum over partitions of part(batch), a small matrix; summed cell by cell in Spark. A batch is a pandas frame,
    or a record batch of Arrow."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows if arrow else len(b):
                m = part(b)
                total = m if total is None else total + m
        if total is not None:
            cells = {"k": np.arange(total.size), "v": total.ravel()}
            yield pa.RecordBatch.from_pydict(cells) if arrow else pd.DataFrame(cells)

    out = np.zeros(int(np.prod(shape)))
    for r in (rows.mapInArrow if arrow else rows.mapInPandas)(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out.reshape(shape)


def gram(rows: DataFrame, p: int) -> np.ndarray:
    """X^T X of rows with x."""
    return _sum_of(rows.select("x"), lambda pdf: (m := _matrix(pdf["x"])).T @ m, (p, p))


def tsqr_r(rows: DataFrame, p: int, fan_in: int = 64) -> np.ndarray:
    """R of the reduced QR, with a non-negative diagonal: a factor of each partition, and two levels of groups of
    fan_in factors, so that the driver sees one in fan_in squared partitions."""

    def reduced(r: np.ndarray) -> np.ndarray:
        return np.linalg.qr(r, mode="r")

    def local(batches):
        from pyspark import TaskContext

        r = np.zeros((0, p))
        for pdf in batches:
            if len(pdf):
                r = reduced(np.vstack([r, _matrix(pdf["x"])]))
        if len(r):
            yield pd.DataFrame({"g": TaskContext.get().partitionId(), "x": list(r)})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": pdf["g"].iloc[0], "x": list(reduced(_matrix(pdf["x"])))})

    out = rows.select("x").mapInPandas(local, "g bigint, x array<double>")
    for _ in range(2):
        out = out.select(F.floor(F.col("g") / fan_in).alias("g"), "x").groupBy("g").applyInPandas(joined, "g bigint, x array<double>")
    got = out.collect()
    r = np.zeros((p, p))
    if got:
        top = reduced(_matrix([row["x"] for row in got]))
        r[: len(top)] = top  # fewer rows than columns
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def times(rows: DataFrame, m: np.ndarray) -> DataFrame:
    """Rows times a small matrix."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"i": pdf["i"], "x": list(_matrix(pdf["x"]) @ m)})

    return rows.select("i", "x").mapInPandas(run, "i bigint, x array<double>")


def qr(a: DArray) -> tuple[DArray, DArray]:
    rows, (n, p) = stored_rows(a), a.shape
    r = tsqr_r(rows, p)
    return cells_of(times(rows, np.linalg.pinv(r, rcond=1e-13)), (n, p)), from_numpy(r)


def direct_qr(a: DArray) -> tuple[DArray, DArray]:
    """As qr, with a second pass over Q: R^-1 alone loses digits where columns are nearly dependent."""
    rows, (n, p) = stored_rows(a), a.shape
    r1 = tsqr_r(rows, p)
    first = np.linalg.pinv(r1, rcond=1e-13)
    r2 = tsqr_r(times(rows, first), p)
    return cells_of(times(rows, first @ np.linalg.pinv(r2, rcond=1e-13)), (n, p)), from_numpy(r2 @ r1)


def svd(a: DArray) -> tuple[DArray, DArray, DArray]:
    rows, (n, p) = stored_rows(a), a.shape
    u, s, vt = np.linalg.svd(tsqr_r(rows, p))
    keep = s > s[0] * 1e-13 if len(s) else s > 0
    left = vt.T * np.where(keep, 1 / np.where(keep, s, 1), 0)
    return cells_of(times(rows, left), (n, p)), from_numpy(s), from_numpy(vt)


def pca(a: DArray, center: bool = False) -> DArray:
    """Rows projected on the eigenvectors of their covariance, greatest first; of rows as they are unless center."""
    rows, (n, p) = stored_rows(a), a.shape
    means = np.array(_sum_of(rows, lambda pdf: _matrix(pdf["x"]).sum(0), (p,))) / n
    cov = (gram(rows, p) - n * np.outer(means, means)) / (n - 1)
    values, vectors = np.linalg.eigh(cov)
    vectors = vectors[:, np.argsort(-values)]
    if center:
        rows = rows.select("i", F.zip_with("x", F.array(*map(F.lit, means.tolist())), lambda x, m: x - m).alias("x"))
    return cells_of(times(rows, vectors), (n, p))


def inv(a: DArray) -> DArray:
    return from_numpy(np.linalg.inv(a.get()))


def cholesky(a: DArray) -> DArray:
    return from_numpy(np.linalg.cholesky(a.get()))


def inv_uppertri(a: DArray) -> DArray:
    m = a.get()
    out = np.zeros_like(m, float)
    for k in range(len(m) - 1, -1, -1):  # back substitution, a row at a time
        out[k] = (np.eye(len(m))[k] - m[k, k + 1 :] @ out[k + 1 :]) / m[k, k]
    return from_numpy(out)


def normal_sums(rows: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray]:
    """X^T X and X^T y of rows (x, y)."""

    def part(pdf):
        m = _matrix(pdf["x"])
        return np.hstack([m.T @ m, m.T @ pdf["y"].to_numpy(float)[:, None]])

    both = _sum_of(rows.select("x", "y"), part, (p, p + 1))
    return both[:, :-1], both[:, -1]


def lstsq(rows: DataFrame, p: int) -> np.ndarray:
    """Least squares through R: solves R^T R b = X^T y; of several solutions the one of the least norm."""
    r = tsqr_r(rows, p)
    _, xy = normal_sums(rows, p)
    inverse = np.linalg.pinv(r, rcond=1e-13)
    return inverse @ (inverse.T @ xy)


def ridge(rows: DataFrame, p: int, lamb: float) -> np.ndarray:
    xx, xy = normal_sums(rows, p)
    return np.linalg.solve(xx + lamb * np.eye(p), xy)


def polyfit(x: DArray, y: DArray, degree: int) -> np.ndarray:
    """Coefficients, highest degree first, from sums of powers."""
    both = x.combine(y, lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))).df
    powers = F.array(*[F.pow(F.col("v.x"), F.lit(float(degree - k))) for k in range(degree + 1)])
    return lstsq(both.select(powers.alias("x"), F.col("v.y").alias("y")), degree + 1)
