"""DArray: an N-dimensional array as a DataFrame.

One row an element: BIGINT index columns i0..i{n-1} and a value. The value is kept as an expression over the
frame it comes from, so that arithmetic on columns of one table fuses into one projection, without a join;
arrays of different frames meet in a join on their indices. Shapes live on the driver, elements never do
unless get() asks for them.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import ufuncs as U
from .session import spark

#: Elements that get() brings to the driver at most, unless told otherwise.
GET_MOST = 50_000_000
_KINDS = {"b": "boolean", "i": "bigint", "u": "bigint", "f": "double"}


def names(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


def linear(shape: tuple, cols=None) -> Column:
    """The row-major place of an element."""
    cols = cols or [F.col(c) for c in names(len(shape))]
    out = F.lit(0).cast("bigint")
    for n, c in zip(shape, cols):
        out = out * F.lit(n) + c
    return out


def unravel(place: Column, shape: tuple) -> list[Column]:
    """Index columns of row-major places."""
    out, size = [], math.prod(shape)
    for k, n in enumerate(shape):
        size //= max(n, 1)
        q = F.floor(place / F.lit(size)) if size != 1 else place
        out.append((q % F.lit(n)).cast("bigint").alias(f"i{k}"))
    return out


class DArray:
    def __init__(self, base: DataFrame, shape: tuple, value: Column | None = None):
        self.base, self.shape = base, tuple(int(n) for n in shape)
        self.value = F.col("v") if value is None else value

    # -- frames ---------------------------------------------------------------------------------------

    @classmethod
    def columns(cls, df: DataFrame, index: str | list[str], *values, shape: tuple | None = None) -> list[DArray]:
        """Arrays over columns or expressions of one table; they share its rows. Without a shape the index is
        one column of 0..n-1 and n is counted."""
        index = [index] if isinstance(index, str) else index
        base = df.select(*[F.col(c).cast("bigint").alias(n) for c, n in zip(index, names(len(index)))], "*")
        shape = shape or (df.count(),)
        return [cls(base, shape, F.col(v) if isinstance(v, str) else v) for v in values]

    @property
    def df(self) -> DataFrame:
        """i0.., v."""
        return self.base.select(*names(self.ndim), self.value.alias("v"))

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def dtype(self) -> str:
        return dict(self.df.dtypes)["v"]

    def with_value(self, value: Column) -> DArray:
        return DArray(self.base, self.shape, value)

    def get(self, most: int = GET_MOST) -> np.ndarray:
        """The elements on the driver; arrays of over `most` elements are refused."""
        if self.size > most:
            raise ValueError(f"{self.size} elements; get() takes {most}")
        pdf = self.df.toPandas()
        out = np.zeros(self.shape, pdf["v"].to_numpy().dtype if len(pdf) else float)
        if self.ndim:
            out[tuple(pdf[c].to_numpy() for c in names(self.ndim))] = pdf["v"].to_numpy()
        elif len(pdf):
            return pdf["v"].to_numpy()[0]
        return out

    def touch(self) -> DArray:
        """Computes and keeps the elements."""
        df = self.df.persist()
        df.count()
        return DArray(df, self.shape)

    def astype(self, dtype) -> DArray:
        kind = dtype if isinstance(dtype, str) and dtype in _KINDS.values() else _KINDS[np.dtype(dtype).kind]
        v = self.value
        if kind == "bigint" and self.dtype == "double":
            v = U.trunc(v)
        return self.with_value(v.cast(kind))

    def repartition(self, n: int) -> DArray:
        """Elements in n ranges of their index."""
        return DArray(self.df.repartitionByRange(n, *names(self.ndim)), self.shape)

    # -- elementwise ----------------------------------------------------------------------------------

    def map(self, f) -> DArray:
        return self.with_value(f(self.value))

    def broadcast_to(self, shape: tuple) -> DArray:
        shape = tuple(shape)
        np.broadcast_shapes(self.shape, shape)
        lead, df = len(shape) - self.ndim, self.df
        cols, more = [], []
        for k, n in enumerate(shape):
            if k >= lead and self.shape[k - lead] == n:
                cols.append(F.col(f"i{k - lead}").alias(f"j{k}"))
            else:
                more.append((k, n))
        df = df.select(*cols, "v")
        for k, n in more:
            df = df.withColumn(f"j{k}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
        return DArray(df.select(*[F.col(f"j{k}").alias(f"i{k}") for k in range(len(shape))], "v"), shape)

    def combine(self, other, f) -> DArray:
        """f(self, other) by element, with broadcasting."""
        if not isinstance(other, DArray):
            return self.with_value(f(self.value, F.lit(other)))
        if other.base is self.base and other.shape == self.shape:
            return self.with_value(f(self.value, other.value))
        shape = np.broadcast_shapes(self.shape, other.shape)
        sides, keys = [], []
        for side, a in (("l", self), ("r", other)):
            lead = len(shape) - a.ndim
            own = {k + lead: k for k, n in enumerate(a.shape) if n == shape[k + lead]}
            keys.append(own)
            sides.append(a.df.select(*[F.col(f"i{k}").alias(f"{side}{at}") for at, k in own.items()], F.col("v").alias(f"{side}v")))
        both = [k for k in keys[0] if k in keys[1]]
        left, right = sides
        if both:
            joined = left.join(right, reduce(lambda x, y: x & y, [F.col(f"l{k}") == F.col(f"r{k}") for k in both]))
        else:  # an outer combination: one side has a single element or axes of its own
            joined = left.crossJoin(F.broadcast(right) if other.size == 1 else right)
        index = [F.col(f"l{k}" if k in keys[0] else f"r{k}").alias(f"i{k}") for k in range(len(shape))]
        return DArray(joined.select(*index, f(F.col("lv"), F.col("rv")).alias("v")), shape)

    def _arith(self, name: str, other, swap: bool = False) -> DArray:
        f = U.BINARY[name]
        return self.combine(other, (lambda a, b: f(b, a)) if swap else f)

    def __neg__(self):
        return self.map(F.negative)

    def __pos__(self):
        return self

    def __abs__(self):
        return self.map(F.abs)

    def __invert__(self):
        return self.map((lambda a: ~a) if self.dtype == "boolean" else F.bitwise_not)

    def __bool__(self) -> bool:
        if self.size != 1:
            raise ValueError("the truth of an array of more than one element")
        return bool(np.ravel(self.get())[0])

    def __matmul__(self, other):
        from .operators.contract import matmul

        return matmul(self, other)

    def __getitem__(self, item):
        from .operators.select import getitem

        return getitem(self, item)

    def assign(self, item, value) -> DArray:
        """A copy in which self[item] is value."""
        from .operators.select import assign

        return assign(self, item, value)

    @property
    def T(self) -> DArray:
        from .operators.shape import transpose

        return transpose(self)


def _dunder(name: str, op: str) -> None:
    setattr(DArray, f"__{name}__", lambda self, other: self._arith(op, other))
    if name not in ("lt", "le", "gt", "ge", "eq", "ne"):
        setattr(DArray, f"__r{name}__", lambda self, other: self._arith(op, other, True))


def _bitwise(name: str, op: str, boolean) -> None:
    def run(self, other):
        flags = self.dtype == "boolean"
        return self.combine(other, boolean if flags else U.BINARY[op])

    setattr(DArray, f"__{name}__", run)
    setattr(DArray, f"__r{name}__", run)


for _name, _op in (("add", "add"), ("sub", "subtract"), ("mul", "multiply"), ("truediv", "divide"), ("floordiv", "floor_divide"), ("mod", "mod"), ("pow", "power"), ("lshift", "left_shift"), ("rshift", "right_shift"), ("lt", "less"), ("le", "less_equal"), ("gt", "greater"), ("ge", "greater_equal"), ("eq", "equal"), ("ne", "not_equal")):
    _dunder(_name, _op)
for _name, _op, _f in (("and", "bitwise_and", lambda a, b: a & b), ("or", "bitwise_or", lambda a, b: a | b), ("xor", "bitwise_xor", lambda a, b: a != b)):
    _bitwise(_name, _op, _f)
DArray.__hash__ = object.__hash__


def from_numpy(a) -> DArray:
    """A small local array as a DArray."""
    a = np.asarray(a)
    kind = _KINDS[a.dtype.kind]
    data = {f"i{k}": x.ravel() for k, x in enumerate(np.indices(a.shape))} if a.ndim else {}
    data["v"] = a.ravel().astype({"boolean": bool, "bigint": np.int64, "double": float}[kind])
    schema = ", ".join([*(f"{n} bigint" for n in names(a.ndim)), f"v {kind}"])
    return DArray(spark().createDataFrame(pd.DataFrame(data), schema), a.shape)


def as_darray(a) -> DArray:
    return a if isinstance(a, DArray) else from_numpy(a)


def from_places(shape: tuple, value, n_parts: int | None = None) -> DArray:
    """Elements computed from their row-major place: value is a function from the place column to a column."""
    shape = (shape,) if isinstance(shape, int) else tuple(shape)
    size = math.prod(shape)
    df = spark().range(0, size, 1, n_parts) if n_parts else spark().range(size)
    return DArray(df.select(*unravel(F.col("id"), shape), value(F.col("id")).alias("v")), shape)
