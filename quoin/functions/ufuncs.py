"""Elementwise functions of NumPy as Spark columns.

Every expression stays in the JVM and never trips ANSI mode: division by zero, logarithms out of their
domain and comparisons with NaN give what NumPy gives. Only gcd, lcm, spacing, nextafter and i0, for
which Spark has nothing, are Arrow UDFs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def inf() -> Column:
    return F.lit(float("inf"))


def nan() -> Column:
    return F.lit(float("nan"))


def _d(a: Column) -> Column:
    return a.cast("double")


def either_nan(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b)


def signbit(a: Column) -> Column:
    return (a < 0) | (a.cast("string") == "-0.0")


def floor(a: Column) -> Column:
    return F.when(F.isnan(a) | (F.abs(a) >= F.lit(2.0**52)), _d(a)).otherwise(_d(F.floor(a)))


def ceil(a: Column) -> Column:
    return F.when(F.isnan(a) | (F.abs(a) >= F.lit(2.0**52)), _d(a)).otherwise(_d(F.ceil(a)))


def trunc(a: Column) -> Column:
    return F.when(a < 0, ceil(a)).otherwise(floor(a))


def _log(f, at: float):
    return lambda a: F.when(a == at, -inf()).when(a < at, nan()).otherwise(f(_d(a)))


log, log2, log10, log1p = _log(F.ln, 0), _log(F.log2, 0), _log(F.log10, 0), _log(F.log1p, -1)


def divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, _d(a) * F.pow(_d(b), F.lit(-1.0))).otherwise(_d(a) / F.nullif(_d(b), F.lit(0.0)))


def fmod(a: Column, b: Column) -> Column:
    return F.when(b == 0, nan()).otherwise(_d(a) % F.nullif(_d(b), F.lit(0.0)))


def mod(a: Column, b: Column) -> Column:
    r = fmod(a, b)
    return F.when((r != 0) & ~F.isnan(r) & ~F.isnan(b) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def floor_divide(a: Column, b: Column) -> Column:
    a, b = _d(a), _d(b)
    quotient = floor(divide(a - mod(a, b), b) + F.lit(0.5))
    return (F.when(b == 0, a * F.pow(b, F.lit(-1.0))).when(either_nan(a, b) | (F.abs(a) == inf()), nan())
            .when(F.abs(b) == inf(), F.when((a != 0) & ((a < 0) != (b < 0)), F.lit(-1.0)).otherwise(F.lit(0.0))).otherwise(quotient))


def power(a: Column, b: Column) -> Column:
    return F.when((a == 1) | ((a == -1) & (F.abs(b) == inf())), F.lit(1.0)).otherwise(F.pow(_d(a), _d(b)))


def equal(a: Column, b: Column) -> Column:
    return (a == b) & ~either_nan(a, b)


def minimum(a: Column, b: Column) -> Column:
    return F.when(either_nan(a, b), nan()).otherwise(F.least(a, b))


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    return (F.when(F.isnan(a) & F.isnan(b), F.lit(equal_nan)).when(either_nan(a, b), F.lit(False))
            .when((F.abs(a) == inf()) | (F.abs(b) == inf()), a == b).otherwise(F.abs(a - b) <= atol + rtol * F.abs(b)))


def xlogy(x: Column, y: Column) -> Column:
    return F.when((x == 0) & ~F.isnan(y), F.lit(0.0)).otherwise(x * log(y))


def _arrow(f, kind: str):
    def call(*cols: Column) -> Column:
        if len(cols) == 1:
            run = F.pandas_udf(lambda a: pd.Series(f(a.to_numpy())), kind, F.PandasUDFType.SCALAR)
        else:
            run = F.pandas_udf(lambda a, b: pd.Series(f(a.to_numpy(), b.to_numpy())), kind, F.PandasUDFType.SCALAR)
        return run(*cols)

    return call


def _logadd(one: float, back, base: float):
    return lambda a, b: F.when(a == b, a + F.lit(one)).otherwise(F.greatest(a, b) + back(F.lit(1.0) + F.pow(F.lit(base), -F.abs(a - b))))


UNARY = {
    "abs": F.abs, "absolute": F.abs, "fabs": lambda a: F.abs(_d(a)), "arccos": F.acos, "arccosh": F.acosh, "arcsin": F.asin, "arcsinh": F.asinh,
    "arctan": F.atan, "arctanh": F.atanh, "bitwise_not": F.bitwise_not, "invert": F.bitwise_not, "cbrt": F.cbrt, "ceil": ceil,
    "conj": lambda a: a, "conjugate": lambda a: a, "cos": F.cos, "cosh": F.cosh, "deg2rad": F.radians, "degrees": F.degrees, "exp": F.exp,
    "exp2": lambda a: F.pow(F.lit(2.0), _d(a)), "expm1": F.expm1, "floor": floor, "isfinite": lambda a: ~F.isnan(a) & (F.abs(a) < inf()),
    "isinf": lambda a: F.abs(a) == inf(), "isnan": F.isnan, "log": log, "log10": log10, "log1p": log1p, "log2": log2,
    "logical_not": lambda a: a.cast("double") == 0, "negative": F.negative, "positive": lambda a: a, "rad2deg": F.degrees, "radians": F.radians,
    "reciprocal": lambda a: F.pow(_d(a), F.lit(-1.0)), "rint": F.rint, "sign": lambda a: F.when(F.isnan(a), _d(a)).otherwise(F.signum(_d(a))), "signbit": signbit,
    "sin": F.sin, "sinh": F.sinh, "spacing": _arrow(np.spacing, "double"), "sqrt": F.sqrt, "square": lambda a: a * a, "tan": F.tan, "tanh": F.tanh, "trunc": trunc,
}

BINARY = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": divide, "true_divide": divide,
    "floor_divide": floor_divide, "mod": mod, "remainder": mod, "fmod": fmod, "power": power, "float_power": lambda a, b: power(_d(a), _d(b)),
    "arctan2": F.atan2, "hypot": F.hypot, "copysign": lambda a, b: F.abs(a) * F.when(signbit(b), F.lit(-1.0)).otherwise(F.lit(1.0)),
    "bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b), "bitwise_xor": lambda a, b: a.bitwiseXOR(b),
    "left_shift": lambda a, b: F.call_function("shiftleft", a, b.cast("int")), "right_shift": lambda a, b: F.call_function("shiftright", a, b.cast("int")),
    "equal": equal, "not_equal": lambda a, b: ~equal(a, b), "less": lambda a, b: (a < b) & ~either_nan(a, b), "less_equal": lambda a, b: (a <= b) & ~either_nan(a, b),
    "greater": lambda a, b: (a > b) & ~either_nan(a, b), "greater_equal": lambda a, b: (a >= b) & ~either_nan(a, b),
    "maximum": F.greatest, "minimum": minimum, "fmax": lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b)), "fmin": F.least,
    "logical_and": lambda a, b: (_d(a) != 0) & (_d(b) != 0), "logical_or": lambda a, b: (_d(a) != 0) | (_d(b) != 0), "logical_xor": lambda a, b: (_d(a) != 0) != (_d(b) != 0),
    "heaviside": lambda a, b: F.when(F.isnan(a), a).when(a < 0, F.lit(0.0)).when(a == 0, b).otherwise(F.lit(1.0)),
    "ldexp": lambda a, b: a * F.pow(F.lit(2.0), _d(b)), "logaddexp": _logadd(float(np.log(2)), F.ln, float(np.e)), "logaddexp2": _logadd(1.0, F.log2, 2.0),
    "gcd": _arrow(np.gcd, "long"), "lcm": _arrow(np.lcm, "long"), "nextafter": _arrow(np.nextafter, "double"), "xlogy": xlogy,
}

#: Further elementwise functions that NumPy builds on these.
MORE = {
    "fix": trunc, "sinc": lambda a: F.when(a == 0, F.lit(1.0)).otherwise(F.sin(F.lit(float(np.pi)) * a) / F.nullif(F.lit(float(np.pi)) * a, F.lit(0.0))),
    "nan_to_num": lambda a: F.when(F.isnan(a), F.lit(0.0)).when(a == inf(), F.lit(float(np.finfo(float).max))).when(a == -inf(), F.lit(float(np.finfo(float).min))).otherwise(a),
    "isneginf": lambda a: a == -inf(), "isposinf": lambda a: a == inf(), "isreal": lambda a: F.lit(True), "iscomplex": lambda a: F.lit(False),
    "real": lambda a: a, "imag": lambda a: F.lit(0.0), "angle": lambda a: F.when(a < 0, F.lit(float(np.pi))).otherwise(F.lit(0.0)), "real_if_close": lambda a: a,
    "i0": _arrow(np.i0, "double"),
}
BOOLEAN = {"isfinite", "isinf", "isnan", "logical_not", "signbit", "equal", "not_equal", "less", "less_equal", "greater", "greater_equal", "logical_and", "logical_or", "logical_xor", "isneginf", "isposinf", "isreal", "iscomplex"}


def bround(a: Column, decimals: int = 0) -> Column:
    """Half to even, as NumPy rounds: scaled, rounded and scaled back."""
    scale = F.lit(10.0**abs(decimals))
    return F.rint(a * scale) / scale if decimals >= 0 else F.rint(a / scale) * scale


def clip(a: Column, low: Column | None, high: Column | None) -> Column:
    out = a if low is None else F.greatest(a, low)
    return out if high is None else F.when(F.isnan(_d(a)), a).otherwise(F.least(out, high))
