"""Bits of bytes, parts of floats and pairs of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..darray import DArray
from ..functions import ufuncs as U


def packbits(a: DArray) -> DArray:
    """Eight flags of a vector as one number, the first highest."""
    bit = F.when(F.col("v").cast("double") != 0, F.call_function("shiftleft", F.lit(1), (F.lit(7) - F.col("i0") % 8).cast("int"))).otherwise(0)
    return DArray(a.df.groupBy(F.floor(F.col("i0") / 8).alias("i0")).agg(F.bit_or(bit).cast("bigint").alias("v")), (-(-a.size // 8),))


def unpackbits(a: DArray) -> DArray:
    rows = a.df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    bit = F.call_function("shiftright", F.col("v"), (F.lit(7) - F.col("k")).cast("int")).bitwiseAND(F.lit(1))
    return DArray(rows.select((F.col("i0") * 8 + F.col("k")).alias("i0"), bit.cast("bigint").alias("v")), (8 * a.size,))


def modf(a: DArray) -> tuple[DArray, DArray]:
    whole = a.map(U.trunc)
    part = a.map(lambda v: F.when(F.abs(v) == U.inf(), F.lit(0.0)).otherwise(v - U.trunc(v)))
    return part, whole


def frexp(a: DArray) -> tuple[DArray, DArray]:
    """Mantissa in [0.5, 1) and exponent of finite values."""
    power = lambda v: F.when(v == 0, F.lit(0.0)).otherwise(U.floor(F.log2(F.abs(v))) + 1)
    exact = lambda v: power(v) + F.when(F.abs(v) * F.pow(F.lit(2.0), -power(v)) >= 1, 1).when((v != 0) & (F.abs(v) * F.pow(F.lit(2.0), -power(v)) < 0.5), -1).otherwise(0)
    return a.map(lambda v: v * F.pow(F.lit(2.0), -exact(v))), a.map(lambda v: exact(v).cast("bigint"))


def divmod_(a: DArray, b) -> tuple[DArray, DArray]:
    return a // b, a % b


def around(a: DArray, decimals: int = 0) -> DArray:
    return a.map(lambda v: U.bround(v, decimals))


round_ = around


def clip(a: DArray, low=None, high=None) -> DArray:
    return a.map(lambda v: U.clip(v, None if low is None else F.lit(low), None if high is None else F.lit(high)))


def frompyfunc(f, schema: str = "double"):
    """A Python function as an elementwise Arrow-batched function."""
    import pandas as pd

    run = F.pandas_udf(lambda v: pd.Series([f(x) for x in v]), schema, F.PandasUDFType.SCALAR)
    return lambda a: a.map(run)


def map_uop(name: str, a: DArray) -> DArray:
    return a.map(U.UNARY[name] if name in U.UNARY else U.MORE[name])


def map_bop(name: str, a: DArray, b) -> DArray:
    return a._arith(name, b)
