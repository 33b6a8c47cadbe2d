"""Indexing, assignment and conditional selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..darray import DArray, as_darray, linear, names, unravel
from .scan import dealt, places
from .shape import ravel


def _wrapped(v, n: int):
    """Indices on an axis of n, negative ones counted from its end; the job fails at one that is out of range."""
    v = v.cast("bigint")
    wrong = F.raise_error(F.concat(F.lit("index "), v.cast("string"), F.lit(f" on an axis of {n}"))).cast("bigint")
    return F.when((v >= -n) & (v < n), F.when(v < 0, v + n).otherwise(v)).otherwise(wrong)


def _full_key(a: DArray, item) -> list:
    item = list(item) if isinstance(item, tuple) else [item]
    if Ellipsis in [x for x in item if not isinstance(x, (DArray, np.ndarray, list))]:
        at = next(k for k, x in enumerate(item) if x is Ellipsis)
        item[at : at + 1] = [slice(None)] * (a.ndim - len([x for x in item if x is not None]) + 1)
    return item + [slice(None)] * (a.ndim - len([x for x in item if x is not None]))


def getitem(a: DArray, item) -> DArray:
    """Integers, slices (any step), an ellipsis, new axes, one index array or one mask.

    An integer out of range raises IndexError; an element of an index array that is out of range fails the job.
    """
    if isinstance(item, DArray) and item.dtype == "boolean" and item.ndim == a.ndim:
        return extract(item, a)
    df, cols, shape, k = a.df, [], [], 0
    for x in _full_key(a, item):
        if x is None:
            cols.append(F.lit(0).cast("bigint"))
            shape.append(1)
            continue
        col, n = F.col(f"i{k}"), a.shape[k]
        if isinstance(x, (int, np.integer)):
            if not -n <= x < n:
                raise IndexError(f"index {x} on an axis of {n}")
            df = df.where(col == int(x) % n)
        elif isinstance(x, slice):
            start, stop, step = x.indices(n)
            size = len(range(start, stop, step))
            if (start, step, size) != (0, 1, n):
                last = start + (size - 1) * step
                df = df.where((col >= min(start, last)) & (col <= max(start, last))) if size else df.where(F.lit(False))
                if abs(step) != 1:
                    df = df.where((col - start) % step == 0)
            cols.append(((col - start) / step).cast("bigint") if step != 1 else col - start)
            shape.append(size)
        else:
            x = as_darray(x)
            if x.dtype == "boolean":
                x = flatnonzero(x)
            pos = x.df.select(F.col("i0").alias(f"at{k}"), _wrapped(F.col("v"), n).alias(f"i{k}"))
            df = df.join(dealt(pos, min(a.size, x.size)), f"i{k}")
            cols.append(F.col(f"at{k}"))
            shape.append(x.size)
        k += 1
    return DArray(df.select(*[c.alias(f"i{j}") for j, c in enumerate(cols)], "v"), shape)


def assign(a: DArray, item, value) -> DArray:
    """A copy with a[item] = value; of positions that repeat, the last wins."""
    if isinstance(item, DArray) and item.dtype == "boolean":
        return putmask(a, item, value)
    places_ = DArray(a.df.select(*names(a.ndim), linear(a.shape).alias("v")), a.shape)
    hit = getitem(places_, item)
    if isinstance(value, DArray):
        new = hit.combine(value, lambda p, w: F.struct(p.alias("p"), w.alias("w")))
    else:
        new = hit.map(lambda p: F.struct(p.alias("p"), F.lit(value).alias("w")))
    order = F.struct(*names(new.ndim)) if new.ndim else F.lit(0)
    new = new.df.groupBy(F.col("v.p").alias("p")).agg(F.max_by(F.col("v.w"), order).alias("w"), F.lit(True).alias("hit"))
    out = a.df.withColumn("p", linear(a.shape)).join(new, "p", "left")
    return DArray(out.select(*names(a.ndim), F.when(F.col("hit"), F.col("w")).otherwise(F.col("v")).cast(a.dtype).alias("v")), a.shape)


def _kept(df, shape) -> DArray:
    """The values of df (p, v) in order of p as a vector."""
    ranked, n = places(df, "p")
    return DArray(ranked.select(F.col("at").alias("i0"), "v"), (n,))


def extract(condition: DArray, a: DArray) -> DArray:
    """The elements at which the condition holds, in row-major order."""
    both = a.combine(condition, lambda v, c: F.struct(v.alias("v"), (c.cast("double") != 0).alias("c")))
    return _kept(both.df.where("v.c").select(linear(a.shape).alias("p"), F.col("v.v").alias("v")), a.shape)


def compress(condition: DArray, a: DArray, axis: int | None = None) -> DArray:
    return extract(condition, ravel(a)) if axis is None else getitem(a, (slice(None),) * axis + (condition,))


def where(condition: DArray, x=None, y=None):
    """With x and y: x where the condition holds, else y. Without: the (n, ndim) indices where it holds."""
    if x is not None:
        pick = condition.combine(x, lambda c, v: F.struct(c.alias("c"), v.alias("x")))
        return pick.combine(y, lambda s, v: F.when(s["c"].cast("double") != 0, s["x"]).otherwise(v))
    return argwhere(condition)


def argwhere(a: DArray) -> DArray:
    hit = a.df.where(F.col("v").cast("double") != 0).select(linear(a.shape).alias("p"))
    ranked, n = places(hit, "p")
    rows = ranked.select("at", *unravel(F.col("p"), a.shape))
    cells = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"i{k}").alias("w")) for k in range(a.ndim)]))
    return DArray(rows.select("at", cells.alias("c")).select(F.col("at").alias("i0"), F.col("c.k").alias("i1"), F.col("c.w").alias("v")), (n, a.ndim))


def nonzero(a: DArray) -> list[DArray]:
    found = argwhere(a)
    return [getitem(found, (slice(None), k)) for k in range(a.ndim)]


def flatnonzero(a: DArray) -> DArray:
    flat = ravel(a)
    return _kept(flat.df.where(F.col("v").cast("double") != 0).select(F.col("i0").alias("p"), F.col("i0").alias("v")), flat.shape)


def take(a: DArray, index, axis: int | None = None) -> DArray:
    index = as_darray(index)
    return getitem(ravel(a), index) if axis is None else getitem(a, (slice(None),) * axis + (index,))


def take_along_axis(a: DArray, index: DArray, axis: int) -> DArray:
    keys = [c for k, c in enumerate(names(a.ndim)) if k != axis]
    want = index.df.select(*keys, F.col(f"i{axis}").alias("at"), _wrapped(F.col("v"), a.shape[axis]).alias(f"i{axis}"))
    out = want.join(a.df, names(a.ndim)).drop(f"i{axis}").withColumnRenamed("at", f"i{axis}")
    return DArray(out.select(*names(a.ndim), "v"), index.shape)


def put_along_axis(a: DArray, index: DArray, values, axis: int) -> DArray:
    keys = [c for k, c in enumerate(names(a.ndim)) if k != axis]
    both = index.map(lambda i: _wrapped(i, a.shape[axis])).combine(values, lambda i, w: F.struct(i.alias("i"), w.alias("w")))
    new = both.df.groupBy(*keys, F.col("v.i").alias(f"i{axis}")).agg(F.max_by(F.col("v.w"), F.col(f"i{axis}")).alias("w")) if not keys else both.df.select(*keys, F.col("v.i").alias("n"), F.col("v.w").alias("w"), F.col(f"i{axis}").alias("o")).groupBy(*keys, "n").agg(F.max_by("w", "o").alias("w")).withColumnRenamed("n", f"i{axis}")
    return DArray(a.df.join(new, names(a.ndim), "left").select(*names(a.ndim), F.coalesce("w", "v").alias("v")), a.shape)


def putmask(a: DArray, mask: DArray, value) -> DArray:
    pick = a.combine(mask, lambda v, m: F.struct(v.alias("v"), (m.cast("double") != 0).alias("m")))
    return pick.combine(value, lambda s, w: F.when(s["m"], w.cast(a.dtype)).otherwise(s["v"]))


def put(a: DArray, index, values) -> DArray:
    from .shape import reshape

    return reshape(assign(ravel(a), as_darray(index), values if not isinstance(values, (list, np.ndarray)) else as_darray(values)), a.shape)


def place(a: DArray, mask: DArray, values) -> DArray:
    """The k-th element under the mask becomes values[k mod n]."""
    values = list(values)
    hit, _ = places(ravel(mask).df.where("v").select(F.col("i0").alias("p")), "p")
    new = hit.select("p", F.element_at(F.array(*map(F.lit, values)), (F.col("at") % len(values) + 1).cast("int")).alias("w"))
    out = a.df.withColumn("p", linear(a.shape)).join(new, "p", "left")
    return DArray(out.select(*names(a.ndim), F.coalesce("w", "v").alias("v")), a.shape)


def fill_diagonal(a: DArray, value) -> DArray:
    return a.with_value(F.when(F.col("i0") == F.col("i1"), F.lit(value).cast(a.dtype)).otherwise(a.value))


def choose(index: DArray, choices) -> DArray:
    out = as_darray(choices[-1]) if not isinstance(choices[-1], (int, float)) else choices[-1]
    for k in range(len(choices) - 2, -1, -1):
        out = where(index == k, choices[k], out)
    return out


def select(conditions, choices, default=0) -> DArray:
    out = default
    for c, v in list(zip(conditions, choices))[::-1]:
        out = where(c, v, out)
    return out


def piecewise(x: DArray, conditions, functions) -> DArray:
    """Functions of columns (or constants), the last condition that holds first; one more is the default."""
    default = functions[len(conditions)] if len(functions) > len(conditions) else 0
    call = lambda f: f(x.value) if callable(f) else F.lit(f)
    out = x.with_value(call(default))
    for c, f in zip(conditions, functions):
        out = where(c, x.with_value(call(f)), out)
    return out


def delete(a: DArray, index, axis: int = 0) -> DArray:
    """Without the given positions of an axis."""
    n = a.shape[axis]
    gone = sorted({int(i) % n for i in np.atleast_1d(index)})
    col = F.col(f"i{axis}")
    before = sum((F.when(col > g, 1).otherwise(0) for g in gone), F.lit(0))
    shape = list(a.shape)
    shape[axis] = n - len(gone)
    return DArray(a.df.where(~col.isin(gone)).withColumn(f"i{axis}", (col - before).cast("bigint")), shape)


def insert(a: DArray, at: int, values) -> DArray:
    """values put into a vector before place `at`."""
    values = as_darray(values)
    head = a.df.withColumn("i0", F.when(F.col("i0") >= at, F.col("i0") + values.size).otherwise(F.col("i0")))
    return DArray(head.unionByName(values.df.withColumn("i0", F.col("i0") + at).withColumn("v", F.col("v").cast(a.dtype))), (a.size + values.size,))


def trim_zeros(a: DArray) -> DArray:
    ends = a.df.where("v <> 0").agg(F.min("i0"), F.max("i0")).first()
    return getitem(a, slice(0, 0)) if ends[0] is None else getitem(a, slice(ends[0], ends[1] + 1))


def ravel_multi_index(index: list[DArray], shape) -> DArray:
    out = index[0]
    for n, i in zip(shape[1:], index[1:]):
        out = out * n + i
    return out


def unravel_index(a: DArray, shape) -> list[DArray]:
    return [a.with_value(c) for c in unravel(a.value, shape)]


def ix_(*index):
    from .shape import reshape

    n = len(index)
    return [reshape(as_darray(x), [-1 if j == k else 1 for j in range(n)]) for k, x in enumerate(index)]


