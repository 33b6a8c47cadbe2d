"""Polynomials (coefficients, highest degree first) and other small local work.

Coefficients are few: what has no distributed meaning runs in NumPy on the driver, behind get()'s bound.
"""

from __future__ import annotations

import numpy as np

from ..darray import DArray, as_darray, from_numpy
from .contract import polymul  # noqa: F401


def _local(f):
    def run(*args):
        got = f(*[a.get(1_000_000) if isinstance(a, DArray) else a for a in args])
        return tuple(map(from_numpy, got)) if isinstance(got, tuple) else from_numpy(got)

    run.__doc__ = f"numpy.{f.__name__} of small arrays."
    return run


poly, roots, polydiv, polyder, polyint = map(_local, (np.poly, np.roots, np.polydiv, np.polyder, np.polyint))


def polyadd(a: DArray, b: DArray) -> DArray:
    n = max(a.size, b.size)
    from .shape import concatenate
    from .creation import zeros

    wide = lambda x: x if x.size == n else concatenate([zeros(n - x.size).astype(x.dtype), x])
    return wide(a) + wide(b)


def polysub(a: DArray, b: DArray) -> DArray:
    return polyadd(a, -b)


def polyval(p, x: DArray) -> DArray:
    """Horner's rule as one expression."""
    from pyspark.sql import functions as F

    coefficients = np.asarray(as_darray(p).get(1_000_000)).tolist()

    def horner(v):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * v + F.lit(c)
        return out

    return x.map(horner)


common_type = lambda *a: np.result_type(float, *[x.dtype.replace("bigint", "int64").replace("boolean", "bool") for x in a]).type
asscalar = lambda a: np.ravel(a.get(1))[0].item()
isscalar, min_scalar_type, mintypecode, promote_types, result_type = np.isscalar, np.min_scalar_type, np.mintypecode, np.promote_types, np.result_type
iscomplexobj = lambda a: False
isrealobj = lambda a: True


def obj2sctype(x, default=None):
    try:
        return np.dtype(x).type
    except TypeError:
        return default


def sctype2char(x) -> str:
    return np.dtype(x).char


def maximum_sctype(t):
    kind = np.dtype(t).kind
    return {"f": np.longdouble, "i": np.int64, "u": np.uint64, "c": np.clongdouble, "b": np.bool_}[kind]
