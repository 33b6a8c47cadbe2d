"""Arrays from shapes, ranges and formulas."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..darray import DArray, as_darray, from_numpy, from_places, names

array = asarray = from_numpy


def asarray_chkfinite(a) -> DArray:
    if not np.isfinite(np.asarray(a, float)).all():
        raise ValueError("array must not contain infs or NaNs")
    return from_numpy(a)


def full(shape, fill_value) -> DArray:
    return from_places(shape, lambda p: F.lit(fill_value))


def zeros(shape, dtype=float) -> DArray:
    return full(shape, np.dtype(dtype).type(0).item())


def ones(shape, dtype=float) -> DArray:
    return full(shape, np.dtype(dtype).type(1).item())


empty = zeros


def full_like(a: DArray, fill_value) -> DArray:
    return a.with_value(F.lit(fill_value).cast(a.dtype))


def zeros_like(a: DArray) -> DArray:
    return full_like(a, 0)


def ones_like(a: DArray) -> DArray:
    return full_like(a, 1)


empty_like = zeros_like


def arange(start, stop=None, step=1) -> DArray:
    start, stop = (0, start) if stop is None else (start, stop)
    n = max(0, math.ceil((stop - start) / step))
    return from_places(n, lambda p: F.lit(start) + p * F.lit(step))


def linspace(start, stop, num: int = 50, endpoint: bool = True) -> DArray:
    gaps = max(1, num - 1 if endpoint else num)
    return from_places(num, lambda p: F.lit(float(start)) + p * F.lit((stop - start) / gaps))


def logspace(start, stop, num: int = 50, endpoint: bool = True, base: float = 10.0) -> DArray:
    return linspace(start, stop, num, endpoint).map(lambda v: F.pow(F.lit(float(base)), v))


def geomspace(start, stop, num: int = 50, endpoint: bool = True) -> DArray:
    return linspace(math.log10(start), math.log10(stop), num, endpoint).map(lambda v: F.pow(F.lit(10.0), v))


def tri(n: int, m: int | None = None, k: int = 0) -> DArray:
    a = zeros((n, m or n))
    return a.with_value(F.when(F.col("i1") <= F.col("i0") + k, F.lit(1.0)).otherwise(F.lit(0.0)))


def eye(n: int, m: int | None = None, k: int = 0) -> DArray:
    a = zeros((n, m or n))
    return a.with_value(F.when(F.col("i1") == F.col("i0") + k, F.lit(1.0)).otherwise(F.lit(0.0)))


def identity(n: int) -> DArray:
    return eye(n)


def tril(a: DArray, k: int = 0) -> DArray:
    return a.with_value(F.when(F.col("i1") <= F.col("i0") + k, a.value).otherwise(F.lit(0).cast(a.dtype)))


def triu(a: DArray, k: int = 0) -> DArray:
    return a.with_value(F.when(F.col("i1") >= F.col("i0") + k, a.value).otherwise(F.lit(0).cast(a.dtype)))


def diagonal(a: DArray, offset: int = 0) -> DArray:
    n, m = a.shape
    size = max(0, min(n, m - offset) if offset >= 0 else min(n + offset, m))
    low = F.col("i0") if offset >= 0 else F.col("i1")
    return DArray(a.df.where(F.col("i1") - F.col("i0") == offset).select(low.alias("i0"), "v"), (size,))


def diagflat(v: DArray, k: int = 0) -> DArray:
    n = v.size + abs(k)
    out = zeros((n, n)).df
    put = v.df.select((F.col("i0") + max(0, -k)).alias("i0"), (F.col("i0") + max(0, k)).alias("i1"), F.col("v").cast("double").alias("w"))
    return DArray(out.join(put, ["i0", "i1"], "left").select("i0", "i1", F.coalesce("w", "v").alias("v")), (n, n))


def diag(a: DArray, k: int = 0) -> DArray:
    return diagflat(a, k) if a.ndim == 1 else diagonal(a, k)


def fromfunction(f, shape) -> DArray:
    """f takes the index columns."""
    a = zeros(shape)
    return a.with_value(f(*[F.col(c) for c in names(a.ndim)]))


def indices(shape) -> list[DArray]:
    return [fromfunction(lambda *c, k=k: c[k], shape) for k in range(len(shape))]


def meshgrid(x: DArray, y: DArray) -> tuple[DArray, DArray]:
    shape = (y.size, x.size)
    from .shape import reshape

    return reshape(x, (1, x.size)).broadcast_to(shape), reshape(y, (y.size, 1)).broadcast_to(shape)


def vander(x: DArray, n: int | None = None, increasing: bool = False) -> DArray:
    from .shape import reshape

    n = n or x.size
    out = reshape(x, (x.size, 1)).broadcast_to((x.size, n))
    power = F.col("i1") if increasing else F.lit(n - 1) - F.col("i1")
    return DArray(out.df, out.shape, F.pow(F.col("v").cast("double"), power.cast("double")))


def _window(n: int, f) -> DArray:
    return ones(n) if n == 1 else from_places(n, lambda p: f(p.cast("double"), n - 1))


def bartlett(n: int) -> DArray:
    return _window(n, lambda p, m: F.lit(1.0) - F.abs(p * F.lit(2.0 / m) - F.lit(1.0)))


def hanning(n: int) -> DArray:
    return _window(n, lambda p, m: F.lit(0.5) - F.lit(0.5) * F.cos(p * F.lit(2 * math.pi / m)))


def hamming(n: int) -> DArray:
    return _window(n, lambda p, m: F.lit(0.54) - F.lit(0.46) * F.cos(p * F.lit(2 * math.pi / m)))


def blackman(n: int) -> DArray:
    return _window(n, lambda p, m: F.lit(0.42) - F.lit(0.5) * F.cos(p * F.lit(2 * math.pi / m)) + F.lit(0.08) * F.cos(p * F.lit(4 * math.pi / m)))


def kaiser(n: int, beta: float) -> DArray:
    from ..functions.ufuncs import MORE

    return _window(n, lambda p, m: MORE["i0"](F.lit(float(beta)) * F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - F.pow(p * F.lit(2.0 / m) - F.lit(1.0), F.lit(2.0))))) / F.lit(float(np.i0(beta))))


def copy(a: DArray) -> DArray:
    return a


def tril_indices(n: int, k: int = 0, m: int | None = None) -> DArray:
    from .select import where

    return where(tri(n, m, k) == 1.0)


def triu_indices(n: int, k: int = 0, m: int | None = None) -> DArray:
    from .select import where

    return where(tri(n, m, k - 1) == 0.0)


def diag_indices(n: int) -> DArray:
    return from_places((n, 2), lambda p: F.floor(p / 2).cast("bigint"))


def tril_indices_from(a: DArray, k: int = 0) -> DArray:
    return tril_indices(a.shape[0], k, a.shape[1])


def triu_indices_from(a: DArray, k: int = 0) -> DArray:
    return triu_indices(a.shape[0], k, a.shape[1])


def diag_indices_from(a: DArray) -> DArray:
    return diag_indices(a.shape[0])


def fromiter(values, dtype=float) -> DArray:
    return from_numpy(np.fromiter(values, dtype))


def frombuffer(buffer, dtype=float) -> DArray:
    return from_numpy(np.frombuffer(buffer, dtype))


def ensure(a) -> DArray:
    return as_darray(a)
