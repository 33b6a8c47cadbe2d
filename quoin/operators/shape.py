"""Index arithmetic: reshaping, permuting, joining and cutting arrays."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..darray import DArray, as_darray, linear, names, unravel


def _index(a: DArray, cols, shape) -> DArray:
    return DArray(a.df.select(*[c.cast("bigint").alias(f"i{k}") for k, c in enumerate(cols)], "v"), shape)


def _cols(a: DArray) -> list:
    return [F.col(c) for c in names(a.ndim)]


def reshape(a: DArray, shape) -> DArray:
    shape = (shape,) if isinstance(shape, int) else tuple(shape)
    if -1 in shape:
        shape = tuple(a.size // max(1, -math.prod(shape)) if n == -1 else n for n in shape)
    if math.prod(shape) != a.size:
        raise ValueError(f"{a.shape} as {shape}")
    if shape == a.shape:
        return a
    return DArray(a.df.select(linear(a.shape).alias("p"), "v").select(*unravel(F.col("p"), shape), "v"), shape)


def ravel(a: DArray) -> DArray:
    return reshape(a, (a.size,))


def resize(a: DArray, shape) -> DArray:
    """Elements repeated or cut to fill the shape."""
    from .creation import arange
    from .select import take

    shape = (shape,) if isinstance(shape, int) else tuple(shape)
    return reshape(take(ravel(a), arange(math.prod(shape)).map(lambda v: v % a.size)), shape)


def transpose(a: DArray, axes=None) -> DArray:
    axes = list(axes) if axes is not None else list(range(a.ndim))[::-1]
    return _index(a, [F.col(f"i{k}") for k in axes], [a.shape[k] for k in axes])


def swapaxes(a: DArray, x: int, y: int) -> DArray:
    axes = list(range(a.ndim))
    axes[x], axes[y] = axes[y], axes[x]
    return transpose(a, axes)


def moveaxis(a: DArray, source: int, destination: int) -> DArray:
    axes = list(range(a.ndim))
    axes.insert(destination % a.ndim, axes.pop(source % a.ndim))
    return transpose(a, axes)


def rollaxis(a: DArray, axis: int, start: int = 0) -> DArray:
    axis %= a.ndim
    return moveaxis(a, axis, start - 1 if axis < start else start)


def expand_dims(a: DArray, axis: int) -> DArray:
    axis = axis % (a.ndim + 1)
    cols = _cols(a)
    return _index(a, [*cols[:axis], F.lit(0), *cols[axis:]], (*a.shape[:axis], 1, *a.shape[axis:]))


def squeeze(a: DArray, axis: int | None = None) -> DArray:
    gone = [k for k, n in enumerate(a.shape) if n == 1] if axis is None else [axis % a.ndim]
    keep = [k for k in range(a.ndim) if k not in gone]
    return _index(a, [F.col(f"i{k}") for k in keep], [a.shape[k] for k in keep])


def atleast_1d(a: DArray) -> DArray:
    return a if a.ndim else expand_dims(a, 0)


def atleast_2d(a: DArray) -> DArray:
    a = atleast_1d(a)
    return a if a.ndim > 1 else expand_dims(a, 0)


def atleast_3d(a: DArray) -> DArray:
    a = atleast_2d(a)
    return a if a.ndim > 2 else expand_dims(a, 2)


def concatenate(arrays, axis: int = 0) -> DArray:
    arrays = [as_darray(a) for a in arrays]
    axis %= arrays[0].ndim
    out, at = None, 0
    for a in arrays:
        part = a.df.withColumn(f"i{axis}", F.col(f"i{axis}") + at)
        out = part if out is None else out.unionByName(part)
        at += a.shape[axis]
    shape = list(arrays[0].shape)
    shape[axis] = at
    return DArray(out, shape)


def stack(arrays, axis: int = 0) -> DArray:
    return concatenate([expand_dims(a, axis) for a in arrays], axis)


def vstack(arrays) -> DArray:
    return concatenate([atleast_2d(a) for a in arrays], 0)


row_stack = vstack


def hstack(arrays) -> DArray:
    arrays = [atleast_1d(a) for a in arrays]
    return concatenate(arrays, 0 if arrays[0].ndim == 1 else 1)


def dstack(arrays) -> DArray:
    return concatenate([atleast_3d(a) for a in arrays], 2)


def column_stack(arrays) -> DArray:
    return concatenate([a if a.ndim == 2 else expand_dims(a, 1) for a in arrays], 1)


def append(a: DArray, values, axis: int | None = None) -> DArray:
    values = as_darray(values)
    return concatenate([ravel(a), ravel(values)]) if axis is None else concatenate([a, values], axis)


def _cuts(n: int, sections, equal: bool) -> list[int]:
    if not isinstance(sections, int):
        return [0, *sections, n]
    if equal and n % sections:
        raise ValueError("array split does not result in an equal division")
    size, more = divmod(n, sections)
    return [0, *(size * (k + 1) + min(k + 1, more) for k in range(sections))]


def array_split(a: DArray, sections, axis: int = 0, equal: bool = False) -> list[DArray]:
    cuts, col = _cuts(a.shape[axis], sections, equal), f"i{axis}"
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        shape = list(a.shape)
        shape[axis] = hi - lo
        out.append(DArray(a.df.where((F.col(col) >= lo) & (F.col(col) < hi)).withColumn(col, F.col(col) - lo), shape))
    return out


def split(a: DArray, sections, axis: int = 0) -> list[DArray]:
    return array_split(a, sections, axis, equal=True)


def vsplit(a: DArray, sections) -> list[DArray]:
    return split(a, sections, 0)


def hsplit(a: DArray, sections) -> list[DArray]:
    return split(a, sections, 1 if a.ndim > 1 else 0)


def dsplit(a: DArray, sections) -> list[DArray]:
    return split(a, sections, 2)


def _moved(a: DArray, axis: int, col) -> DArray:
    return DArray(a.df.withColumn(f"i{axis}", col.cast("bigint")), a.shape)


def flip(a: DArray, axis: int | None = None) -> DArray:
    for k in range(a.ndim) if axis is None else [axis % a.ndim]:
        a = _moved(a, k, F.lit(a.shape[k] - 1) - F.col(f"i{k}"))
    return a


def flipud(a: DArray) -> DArray:
    return flip(a, 0)


def fliplr(a: DArray) -> DArray:
    return flip(a, 1)


def roll(a: DArray, shift: int, axis: int | None = None) -> DArray:
    if axis is None:
        return reshape(roll(ravel(a), shift, 0), a.shape)
    return _moved(a, axis, F.pmod(F.col(f"i{axis}") + shift, F.lit(a.shape[axis])))


def rot90(a: DArray, k: int = 1) -> DArray:
    for _ in range(k % 4):
        a = flip(transpose(a, [1, 0, *range(2, a.ndim)]), 0)
    return a


def repeat(a: DArray, times: int, axis: int | None = None) -> DArray:
    if axis is None:
        a, axis = ravel(a), 0
    col = f"i{axis}"
    df = a.df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(col, F.col(col) * times + F.col("k")).drop("k")
    shape = list(a.shape)
    shape[axis] *= times
    return DArray(df, shape)


def tile(a: DArray, reps) -> DArray:
    reps = (reps,) if isinstance(reps, int) else tuple(reps)
    while a.ndim < len(reps):
        a = expand_dims(a, 0)
    reps = (1,) * (a.ndim - len(reps)) + reps
    df = a.df
    for k, n in enumerate(reps):
        if n > 1:
            df = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(f"i{k}", F.col(f"i{k}") + F.col("k") * a.shape[k]).drop("k")
    return DArray(df, [n * r for n, r in zip(a.shape, reps)])


def pad(a: DArray, width: int, constant=0) -> DArray:
    """A border of a constant on every side."""
    from .creation import full

    shape = [n + 2 * width for n in a.shape]
    inner = a.df.select(*[(F.col(c) + width).alias(c) for c in names(a.ndim)], F.col("v").alias("w"))
    frame = full(shape, constant).df.withColumn("v", F.col("v").cast(a.dtype))
    return DArray(frame.join(inner, names(a.ndim), "left").select(*names(a.ndim), F.coalesce("w", "v").alias("v")), shape)


def broadcast_to(a: DArray, shape) -> DArray:
    return a.broadcast_to(shape)


def shape(a: DArray) -> tuple:
    return a.shape


def size(a: DArray) -> int:
    return a.size


def ndim(a: DArray) -> int:
    return a.ndim


def require(a, *_) -> DArray:
    return as_darray(a)
