"""Products of arrays: joins on the contracted indices and a sum.

Sparse or tall arrays multiply in coordinates. Two large dense matrices multiply in tiles: a cell is a block
of each, joined on the contracted block, multiplied by BLAS and summed by output block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..darray import DArray, as_darray, names
from .reduce import sum_

#: Rows and columns of a tile.
TILE = 512


def einsum(subscripts: str, *operands: DArray) -> DArray:
    """Equi-joins on shared letters and one sum; letters may repeat within an operand, not in the output."""
    spec, _, out = subscripts.replace(" ", "").partition("->")
    terms = spec.split(",")
    if "->" not in subscripts:
        out = "".join(sorted(c for c in set(spec) - {","} if spec.count(c) == 1))
    size: dict[str, int] = {}
    joined = None
    for t, (term, a) in enumerate(zip(terms, operands)):
        df, seen = a.df, {}
        for k, c in enumerate(term):
            size[c] = a.shape[k]
            if c in seen:
                df = df.where(F.col(f"i{k}") == F.col(f"i{seen[c]}"))
            seen.setdefault(c, k)
        df = df.select(*[F.col(f"i{k}").alias(f"x{c}") for c, k in seen.items()], F.col("v").alias(f"v{t}"))
        later = set(out).union(*map(set, terms[t + 1 :])) if t + 1 < len(terms) else set(out)
        if joined is None:
            joined, have = df, set(seen)
            joined = joined.withColumnRenamed("v0", "v")
        else:
            both = [f"x{c}" for c in seen if c in have]
            joined = (joined.join(df, both) if both else joined.crossJoin(df)).withColumn("v", F.col("v") * F.col(f"v{t}")).drop(f"v{t}")
            have |= set(seen)
        gone = have - later
        if gone:  # sum what no later operand needs, before the next join
            have &= later
            joined = joined.groupBy(*[f"x{c}" for c in sorted(have)]).agg(F.sum("v").alias("v"))
    return DArray(joined.select(*[F.col(f"x{c}").alias(f"i{k}") for k, c in enumerate(out)], "v"), [size[c] for c in out])


def einsum_path(subscripts: str, *operands: DArray):
    return ["einsum_path", *[(0, 1)] * (len(operands) - 1)], subscripts


def tensordot(a: DArray, b: DArray, axes: int = 2) -> DArray:
    letters = iter("abcdefghijklmnopqrstuvwxyz")
    left = [next(letters) for _ in range(a.ndim)]
    shared = left[a.ndim - axes :] if axes else []
    right = shared + [next(letters) for _ in range(b.ndim - axes)]
    return einsum(f"{''.join(left)},{''.join(right)}->{''.join(left[: a.ndim - axes] + right[axes:])}", a, b)


def _tiled(a: DArray, b: DArray) -> DArray:
    """Dense matrices block by block; a task holds a column of blocks of one and a row of the other's for one cell."""

    def blocks(m: DArray, across: str, along: str):
        at = F.struct((F.col("i0") % TILE).alias("r"), (F.col("i1") % TILE).alias("c"), F.col("v").cast("double").alias("v"))
        return m.df.groupBy(F.floor(F.col("i0") / TILE).alias(across), F.floor(F.col("i1") / TILE).alias(along)).agg(F.collect_list(at).alias(f"{across}{along}"))

    pairs = blocks(a, "p", "q").join(blocks(b, "q", "s"), "q").select("p", "s", "pq", "qs")

    def dense(cells) -> np.ndarray:
        out = np.zeros((TILE, TILE))
        for c in cells:
            out[c["r"], c["c"]] = c["v"]
        return out

    def multiply(batches):
        for pdf in batches:
            for p, s, x, y in zip(pdf["p"], pdf["s"], pdf["pq"], pdf["qs"]):
                m = dense(x) @ dense(y)
                r, c = np.nonzero(m)
                yield pd.DataFrame({"i0": p * TILE + r, "i1": s * TILE + c, "v": m[r, c]})

    part = pairs.repartition("p", "s").mapInPandas(multiply, "i0 bigint, i1 bigint, v double")
    summed = part.groupBy("i0", "i1").agg(F.sum("v").alias("w"))
    from .creation import zeros

    shape = (a.shape[0], b.shape[1])
    return DArray(zeros(shape).df.join(summed, ["i0", "i1"], "left").select("i0", "i1", F.coalesce("w", "v").alias("v")), shape)


def matmul(a: DArray, b: DArray, tiled: bool = False) -> DArray:
    if tiled:
        return _tiled(a, b)
    if a.ndim == 1 and b.ndim == 1:
        return dot(a, b)
    return tensordot(a, b, 1)


def dot(a: DArray, b) -> DArray:
    if not isinstance(b, DArray) or not a.ndim or not b.ndim:
        return a * b
    return sum_(a * b) if a.ndim == b.ndim == 1 else matmul(a, b)


inner = dot


def vdot(a: DArray, b: DArray) -> DArray:
    from .shape import ravel

    return sum_(ravel(a) * ravel(b))


def outer(a: DArray, b: DArray) -> DArray:
    return einsum("i,j->ij", a, b)


def kron(a: DArray, b: DArray) -> DArray:
    both = a.df.select(*[F.col(c).alias(f"a{c}") for c in names(a.ndim)], F.col("v").alias("x")).crossJoin(b.df)
    cols = [(F.col(f"ai{k}") * n + F.col(f"i{k}")).alias(f"i{k}") for k, n in enumerate(b.shape)]
    return DArray(both.select(*cols, (F.col("x") * F.col("v")).alias("v")), [n * m for n, m in zip(a.shape, b.shape)])


def trace(a: DArray, offset: int = 0) -> DArray:
    return DArray(a.df.where(F.col("i1") - F.col("i0") == offset).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v")), ())


def cross(a: DArray, b: DArray) -> DArray:
    """Rows of three."""
    a, b = as_darray(a), as_darray(b)
    wide = lambda m, p: m.df.groupBy("i0").agg(*[F.max(F.when(F.col("i1") == k, F.col("v"))).alias(f"{p}{k}") for k in range(3)])
    rows = wide(a, "a").join(wide(b, "b"), "i0")
    c = [F.col(f"a{(k + 1) % 3}") * F.col(f"b{(k + 2) % 3}") - F.col(f"a{(k + 2) % 3}") * F.col(f"b{(k + 1) % 3}") for k in range(3)]
    cells = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), x.alias("w")) for k, x in enumerate(c)]))
    return DArray(rows.select("i0", cells.alias("s")).select("i0", F.col("s.k").alias("i1"), F.col("s.w").alias("v")), a.shape)


def polymul(a: DArray, b: DArray) -> DArray:
    """Coefficients, highest degree first."""
    n = a.size + b.size - 1
    out = einsum("i,j->ij", a, b).df.groupBy((F.col("i0") + F.col("i1")).alias("i0")).agg(F.sum("v").alias("v"))
    return DArray(out, (n,))
