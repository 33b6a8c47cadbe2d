"""The array functions by their NumPy names: import quoin.api as qn; qn.sum(qn.sqrt(x)).

Elementwise functions take arrays or scalars; the rest are those of quoin.operators and quoin.sources.
"""

from __future__ import annotations

import numpy as _np

from .darray import DArray, as_darray, from_numpy  # noqa: F401
from .functions import ufuncs as _U
from .operators.bits import around, clip, frexp, frompyfunc, map_bop, map_uop, modf, packbits, round_, unpackbits  # noqa: F401
from .operators.bits import divmod_ as divmod  # noqa: A004, F401
from .operators.contract import cross, dot, einsum, einsum_path, inner, kron, matmul, outer, tensordot, trace, vdot  # noqa: F401
from .operators.creation import *  # noqa: F403
from .operators.linalg import cholesky, direct_qr, gram, inv, inv_uppertri, lstsq, pca, polyfit, qr, ridge, svd  # noqa: F401
from .operators.poly import asscalar, common_type, iscomplexobj, isrealobj, isscalar, maximum_sctype, min_scalar_type, mintypecode, obj2sctype, poly, polyadd, polyder, polydiv, polyint, polymul, polysub, polyval, promote_types, result_type, roots, sctype2char  # noqa: F401
from .operators.random import RandomState  # noqa: F401
from .operators.random import default as random
from .operators.reduce import all_ as all  # noqa: A004, F401
from .operators.reduce import allclose, alltrue, amax, amin, apply_along_axis, apply_over_axes, argmax, argmin, array_equal, array_equiv, average, bincount, corrcoef, count_nonzero, cov, histogram, histogram2d, histogram_bin_edges, histogramdd, isclose, mean, median, nanargmax, nanargmin, nanmax, nanmean, nanmedian, nanmin, nanpercentile, nanprod, nanquantile, nanstd, nansum, nanvar, norm, percentile, prod, product, ptp, quantile, sometrue, std, var  # noqa: F401
from .operators.reduce import any_ as any  # noqa: A004, F401
from .operators.reduce import max_ as max  # noqa: A004, F401
from .operators.reduce import min_ as min  # noqa: A004, F401
from .operators.reduce import sum_ as sum  # noqa: A004, F401
from .operators.scan import argpartition, argsort, convolve, correlate, cumprod, cumproduct, cumsum, diff, digitize, ediff1d, gradient, interp, lexsort, msort, nancumprod, nancumsum, partition, searchsorted, sort, sort_complex, top_k, trapz, unwrap  # noqa: F401
from .operators.select import argwhere, choose, compress, delete, extract, fill_diagonal, flatnonzero, insert, ix_, nonzero, piecewise, place, put, put_along_axis, putmask, ravel_multi_index, select, take, take_along_axis, trim_zeros, unravel_index, where  # noqa: F401
from .operators.sets import in1d, intersect1d, isin, setdiff1d, setxor1d, union1d, unique  # noqa: F401
from .operators.shape import append, array_split, atleast_1d, atleast_2d, atleast_3d, broadcast_to, column_stack, concatenate, dsplit, dstack, expand_dims, flip, fliplr, flipud, hsplit, hstack, moveaxis, ndim, pad, ravel, repeat, require, reshape, resize, roll, rollaxis, rot90, row_stack, shape, size, split, squeeze, stack, swapaxes, tile, transpose, vsplit, vstack  # noqa: F401
from .session import init  # noqa: F401
from .sources.io import bimodal_gaussian, delete as delete_stored, from_frame, from_modin, from_pandas, fromfile, loadtxt, read, read_csv, write, zarr_array  # noqa: F401

round = around  # noqa: A001
pi, e, euler_gamma, inf, nan = _np.pi, _np.e, _np.euler_gamma, _np.inf, _np.nan
NINF, PZERO, NZERO = -_np.inf, 0.0, -0.0
rand, randn, randint, random_sample, permutation, train_test_split = random.rand, random.randn, random.randint, random.random_sample, random.permutation, random.train_test_split


def _unary(f):
    return lambda a: as_darray(a).map(f)


def _binary(f):
    return lambda a, b: a.combine(b, f) if isinstance(a, DArray) else as_darray(a).combine(b, f)


for _name, _f in (_U.UNARY | _U.MORE).items():
    globals()[_name] = _unary(_f)
for _name, _f in _U.BINARY.items():
    globals()[_name] = _binary(_f)
