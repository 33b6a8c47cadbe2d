"""Sets of elements: distinct values, unions, differences, membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..darray import DArray, as_darray, names
from .scan import value_ranks
from .shape import ravel


def _vector(df, size: int) -> DArray:
    """The distinct v of df, of at most `size` rows, in order."""
    ranks = value_ranks(df.select("v").distinct(), size)
    return DArray(ranks.select(F.col("nth").alias("i0"), "v"), (ranks.count(),))


def unique(a: DArray, return_index: bool = False, return_inverse: bool = False, return_counts: bool = False):
    a = ravel(a)
    ranks = value_ranks(a.df, a.size)
    n = ranks.count()
    out = [DArray(ranks.select(F.col("nth").alias("i0"), "v"), (n,))]
    if return_index:
        first = a.df.groupBy("v").agg(F.min("i0").alias("w"))
        out.append(DArray(ranks.select("v", "nth").join(first, "v").select(F.col("nth").alias("i0"), F.col("w").alias("v")), (n,)))
    if return_inverse:
        out.append(DArray(a.df.join(ranks.select("v", "nth"), "v").select("i0", F.col("nth").alias("v")), a.shape))
    if return_counts:
        out.append(DArray(ranks.select(F.col("nth").alias("i0"), F.col("n").alias("v")), (n,)))
    return out[0] if len(out) == 1 else tuple(out)


def _both(a, b):
    a, b = as_darray(a), as_darray(b)
    return ravel(a).df.select("v"), ravel(b).df.select("v"), a.size + b.size


def union1d(a, b) -> DArray:
    x, y, n = _both(a, b)
    return _vector(x.unionByName(y), n)


def intersect1d(a, b) -> DArray:
    x, y, n = _both(a, b)
    return _vector(x.intersect(y), n)


def setdiff1d(a, b) -> DArray:
    x, y, n = _both(a, b)
    return _vector(x.join(y, "v", "left_anti"), n)


def setxor1d(a, b) -> DArray:
    x, y, n = _both(a, b)
    return _vector(x.join(y, "v", "left_anti").unionByName(y.join(x, "v", "left_anti")), n)


def isin(a: DArray, b) -> DArray:
    _, y, _ = _both(0, b)
    hit = y.distinct().withColumn("hit", F.lit(True))
    return DArray(a.df.join(hit, "v", "left").select(*names(a.ndim), F.coalesce("hit", F.lit(False)).alias("v")), a.shape)


in1d = isin
