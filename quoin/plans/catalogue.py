"""One query an operator over the driver's tables, and DuckDB SQL for the same rows.

Vectors are columns of orders by o_orderkey and of events by event_id; matrices are embeddings, a row a
vector. Floats are rounded alike on both sides, and a rounded negative zero is zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..darray import DArray, as_darray
from ..functions import ufuncs as U
from ..models import glm, preprocess
from ..operators import bits, contract, creation, linalg, poly, random, reduce, scan, select, sets, shape
from ..session import shared_folder
from ..sources import io
from ..streaming import windows

#: Expressions over orders: Spark SQL and DuckDB read them alike.
INPUT = {
    "x": "((o_totalprice - 150000) / 4.9999e4)",
    "u": "(((o_orderkey % 2001) - 1000) / 1.001e3)",
    "g": "(1 + o_totalprice / 1.0007e3)",
    "n": "(o_orderkey - 7000)",
    "m": "(o_custkey + 1)",
    "w": "(CASE WHEN o_orderkey % 2 = 0 THEN 1.5e0 + (o_orderkey % 7) / 8.1e0 ELSE -1.5e0 - (o_orderkey % 5) / 8.1e0 END)",
    "k": "(o_orderkey % 5 - 2)",
    "l": "(o_custkey % 5 - 2)",
}
_WHOLE = ("n", "m", "k", "l")


def _typed(key: str) -> str:
    return f"CAST({INPUT[key]} AS {'BIGINT' if key in _WHOLE else 'DOUBLE'})"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str, *keys: str) -> list[DArray]:
    return DArray.columns(_read(spark, sf_dir, "orders"), "o_orderkey", *[F.expr(_typed(k)) for k in keys])


def events(spark: SparkSession, sf_dir: str, with_nan: bool = False) -> DArray:
    v = "CASE WHEN event_id % 10 = 0 THEN double('NaN') ELSE value END" if with_nan else "value"
    return DArray.columns(_read(spark, sf_dir, "events"), "event_id", F.expr(v))[0]


def matrix(spark: SparkSession, sf_dir: str, columns: int = 64) -> DArray:
    df = _read(spark, sf_dir, "embeddings")
    cells = df.select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("k", "x")).where(F.col("k") < columns)
    return DArray(cells.select("i0", F.col("k").cast("bigint").alias("i1"), F.col("x").cast("double").alias("v")), (df.count(), columns))


def shown(a, digits: int = 6) -> DataFrame:
    """The elements, floats rounded."""
    df = a.df if isinstance(a, DArray) else a
    cols = []
    for c, t in df.dtypes:
        r = F.round(F.col(c), digits)
        cols.append(F.when(r == 0, F.lit(0.0)).otherwise(r).alias(c) if t == "double" else F.col(c))
    return df.select(*cols)


def sql_round(e: str, digits: int = 6) -> str:
    return f"CASE WHEN round({e}, {digits}) = 0 THEN 0.0 ELSE round({e}, {digits}) END::DOUBLE"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, f, sql: str | None = None, digits: int = 6) -> None:
    QUERIES[name] = lambda spark, sf_dir: shown(f(spark, sf_dir), digits)
    if sql:
        ORACLES[name] = sql


# -- elementwise ---------------------------------------------------------------------------------------
#: input, and the function of it in DuckDB's SQL.
_UNARY = {
    "abs": ("x", "abs(a)"), "absolute": ("n", "abs(a)"), "fabs": ("x", "abs(a)"), "arccos": ("u", "acos(a)"), "arccosh": ("g", "acosh(a)"), "arcsin": ("u", "asin(a)"), "arcsinh": ("x", "asinh(a)"),
    "arctan": ("x", "atan(a)"), "arctanh": ("u", "atanh(a)"), "bitwise_not": ("n", "~a"), "invert": ("n", "~a"), "cbrt": ("x", "cbrt(a)"), "ceil": ("x", "ceil(a)"), "conj": ("x", "a"), "conjugate": ("x", "a"),
    "cos": ("x", "cos(a)"), "cosh": ("x", "cosh(a)"), "deg2rad": ("x", "radians(a)"), "degrees": ("x", "degrees(a)"), "exp": ("x", "exp(a)"), "exp2": ("x", "pow(2.0, a)"), "expm1": ("x", "exp(a) - 1"),
    "floor": ("x", "floor(a)"), "isfinite": ("x", "isfinite(a)"), "isinf": ("x", "isinf(a)"), "isnan": ("x", "isnan(a)"), "log": ("g", "ln(a)"), "log10": ("g", "log10(a)"), "log1p": ("g", "ln(1 + a)"), "log2": ("g", "log2(a)"),
    "logical_not": ("k", "a = 0"), "negative": ("x", "-a"), "positive": ("x", "a"), "rad2deg": ("x", "degrees(a)"), "radians": ("x", "radians(a)"), "reciprocal": ("g", "1 / a"), "rint": ("x", "round_even(a, 0)"),
    "sign": ("x", "sign(a)::DOUBLE"), "signbit": ("x", "a < 0"), "sin": ("x", "sin(a)"), "sinh": ("x", "sinh(a)"), "spacing": ("g", "pow(2.0, floor(log2(a)))"), "sqrt": ("g", "sqrt(a)"), "square": ("x", "a * a"), "tan": ("u", "tan(a)"), "tanh": ("x", "tanh(a)"), "trunc": ("x", "trunc(a)"),
    "fix": ("x", "trunc(a)"), "sinc": ("g", "sin(pi() * a) / (pi() * a)"), "nan_to_num": ("x", "a"), "isneginf": ("x", "isinf(a) AND a < 0"), "isposinf": ("x", "isinf(a) AND a > 0"), "isreal": ("x", "true"), "iscomplex": ("x", "false"),
    "real": ("x", "a"), "imag": ("x", "0.0::DOUBLE"), "angle": ("x", "CASE WHEN a < 0 THEN pi() ELSE 0.0 END"), "real_if_close": ("x", "a"), "i0": ("u", "1 + " + " + ".join(f"pow(a / 2, {2 * k}) / pow(factorial({k})::DOUBLE, 2)" for k in range(1, 15))),
}
_BINARY = {
    "add": ("x", "g", "a + b"), "subtract": ("x", "g", "a - b"), "multiply": ("x", "g", "a * b"), "divide": ("x", "w", "a / b"), "true_divide": ("x", "w", "a / b"), "floor_divide": ("x", "w", "floor(a / b)"),
    "mod": ("x", "w", "a - b * floor(a / b)"), "remainder": ("x", "w", "a - b * floor(a / b)"), "fmod": ("x", "w", "a - b * trunc(a / b)"), "power": ("g", "u", "pow(a, b)"), "float_power": ("g", "u", "pow(a, b)"),
    "arctan2": ("x", "w", "atan2(a, b)"), "hypot": ("x", "g", "sqrt(a * a + b * b)"), "copysign": ("x", "w", "abs(a) * sign(b)"), "bitwise_and": ("n", "m", "a & b"), "bitwise_or": ("n", "m", "a | b"), "bitwise_xor": ("n", "m", "xor(a, b)"),
    "left_shift": ("m", "k", None), "right_shift": ("m", "k", None), "equal": ("k", "l", "a = b"), "not_equal": ("k", "l", "a <> b"), "less": ("x", "u", "a < b"), "less_equal": ("k", "l", "a <= b"), "greater": ("x", "u", "a > b"), "greater_equal": ("k", "l", "a >= b"),
    "maximum": ("x", "u", "greatest(a, b)"), "minimum": ("x", "u", "least(a, b)"), "fmax": ("x", "u", "greatest(a, b)"), "fmin": ("x", "u", "least(a, b)"), "logical_and": ("k", "l", "a <> 0 AND b <> 0"), "logical_or": ("k", "l", "a <> 0 OR b <> 0"), "logical_xor": ("k", "l", "(a <> 0) <> (b <> 0)"),
    "heaviside": ("x", "u", "CASE WHEN a < 0 THEN 0.0 WHEN a = 0 THEN b ELSE 1.0 END"), "ldexp": ("x", "k", "a * pow(2.0, b)"), "logaddexp": ("x", "u", "ln(exp(a) + exp(b))"), "logaddexp2": ("x", "u", "log2(pow(2.0, a) + pow(2.0, b))"),
    "gcd": ("m", "n", "gcd(a, b)"), "lcm": ("m", "n", "lcm(a, b)"), "nextafter": ("x", "g", "sign(b - a) * pow(2.0, floor(log2(abs(a))))"), "xlogy": ("k", "g", "CASE WHEN a = 0 THEN 0.0 ELSE a * ln(b) END"),
}
_SAME_TYPE = {"bitwise_not", "invert", "absolute", "bitwise_and", "bitwise_or", "bitwise_xor", "left_shift", "right_shift", "gcd", "lcm"}


def _elementwise(name: str, keys: tuple, sql: str | None) -> None:
    def f(spark, sf_dir):
        arrays = orders(spark, sf_dir, *keys)
        if name == "spacing":  # in units of the spacing of 1
            return bits.map_uop(name, arrays[0]) * 2.0**52
        if name == "nextafter":
            return (bits.map_bop(name, *arrays) - arrays[0]) * 2.0**52
        return bits.map_uop(name, arrays[0]) if len(arrays) == 1 else bits.map_bop(name, *arrays)

    if sql:
        value = sql if name in U.BOOLEAN else f"({sql})::BIGINT" if name in _SAME_TYPE else sql_round(f"({sql})")
        sql = f"SELECT i0, {value} AS v FROM (SELECT o_orderkey AS i0, {', '.join(f'{_typed(k)} AS {c}' for k, c in zip(keys, 'ab'))} FROM orders)"
    add(f"ufunc_{'unary' if len(keys) == 1 else 'binary'}_{name}", f, sql)


for _n, (_k, _s) in _UNARY.items():
    _elementwise(_n, (_k,), _s)
for _n, (_k, _l, _s) in _BINARY.items():
    if _n.endswith("_shift"):
        op = "<<" if _n == "left_shift" else ">>"
        add(f"ufunc_binary_{_n}", lambda s, d, n=_n: (lambda m, k: bits.map_bop(n, m, k + 2))(*orders(s, d, "m", "k")), f"SELECT o_orderkey AS i0, ({_typed('m')} {op} ({_typed('k')} + 2))::BIGINT AS v FROM orders")
    else:
        _elementwise(_n, (_k, _l), _s)

_V = f"(SELECT o_orderkey AS i0, {_typed('x')} AS a, {_typed('u')} AS b, {_typed('n')} AS n, {_typed('k')} AS k FROM orders)"
_E = "(SELECT event_id AS i0, value AS v FROM events)"
_M = "(SELECT vec_id AS i0, generate_subscripts(embedding, 1) - 1 AS i1, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_x = lambda f: lambda s, d: f(orders(s, d, "x")[0])
_k = lambda f: lambda s, d: f(orders(s, d, "k")[0])
_e = lambda f: lambda s, d: f(events(s, d))
_nan = lambda f: lambda s, d: f(events(s, d, True))
_m = lambda f, c=64: lambda s, d: f(matrix(s, d, c))

for _n, _f, _s in (("clip", lambda a: bits.clip(a, -1.0, 1.0), "least(greatest(a, -1.0), 1.0)"), ("around", lambda a: bits.around(a, 2), "round_even(a, 2)"), ("modf", lambda a: bits.modf(a)[0], "a - trunc(a)"), ("divmod", lambda a: bits.divmod_(a, 0.7)[1], "a - 0.7 * floor(a / 0.7)"), ("polyval", lambda a: poly.polyval([2.0, -1.0, 0.5], a), "2.0 * a * a - a + 0.5"), ("piecewise", lambda a: select.piecewise(a, [a < 0.0], [lambda v: -v, lambda v: v * 2]), "CASE WHEN a < 0 THEN -a ELSE 2 * a END"), ("full_like", lambda a: creation.full_like(a, 2.5), "2.5"), ("zeros_like", creation.zeros_like, "0.0"), ("ones_like", creation.ones_like, "1.0"), ("frompyfunc", lambda a: bits.frompyfunc(lambda v: v + 1)(a), "a + 1"), ("isclose", lambda a: reduce.isclose(a, a + 1e-9), None)):
    add(_n, _x(_f), _s and f"SELECT i0, {sql_round(_s)} AS v FROM {_V}")
ORACLES["isclose"] = f"SELECT i0, true AS v FROM {_V}"
add("frexp", _x(lambda a: bits.frexp(a)[1]), f"SELECT i0, (floor(log2(abs(a))) + 1)::BIGINT AS v FROM {_V} WHERE a <> 0 UNION ALL SELECT i0, 0 FROM {_V} WHERE a = 0")
add("astype", _x(lambda a: a.astype("bigint")), f"SELECT i0, trunc(a)::BIGINT AS v FROM {_V}")

# -- reductions ----------------------------------------------------------------------------------------
_RED = {"sum": (reduce.sum_, "sum(v)"), "amax": (reduce.max_, "max(v)"), "amin": (reduce.min_, "min(v)"), "mean": (reduce.mean, "avg(v)"), "var": (reduce.var, "var_pop(v)"), "std": (reduce.std, "stddev_pop(v)"), "median": (reduce.median, "median(v)"), "ptp": (reduce.ptp, "max(v) - min(v)"), "percentile": (lambda a, axis=None: reduce.percentile(a, 30, axis), "quantile_cont(v, 0.3)"), "quantile": (lambda a, axis=None: reduce.quantile(a, 0.9, axis), "quantile_cont(v, 0.9)")}
for _n, (_f, _s) in _RED.items():
    add(f"reduce_{_n}_all", _m(_f), f"SELECT {sql_round(_s)} AS v FROM {_M}")
    add(f"reduce_{_n}_axis0", _m(lambda a, f=_f: f(a, axis=0)), f"SELECT i1 AS i0, {sql_round(_s)} AS v FROM {_M} GROUP BY i1")
    add(f"reduce_{_n}_axis1", _m(lambda a, f=_f: f(a, axis=1)), f"SELECT i0, {sql_round(_s)} AS v FROM {_M} GROUP BY i0")
for _n, _f, _s in (("all", reduce.all_, "bool_and(k <> 0)"), ("alltrue", reduce.alltrue, "bool_and(k <> 0)"), ("any", reduce.any_, "bool_or(k <> 0)"), ("sometrue", reduce.sometrue, "bool_or(k <> 0)"), ("count_nonzero", reduce.count_nonzero, "count(*) FILTER (k <> 0)"), ("argmax", reduce.argmax, "arg_max(i0, (k, -i0))"), ("argmin", reduce.argmin, "arg_min(i0, (k, i0))")):
    add(_n, _k(_f), f"SELECT {_s} AS v FROM {_V}")
add("prod", _x(lambda a: reduce.prod(a * 1e-5 + 1.0)), f"SELECT {sql_round('product(a * 1e-5 + 1.0)')} AS v FROM {_V}")
_NANV = "(SELECT event_id AS i0, value AS v FROM events WHERE event_id % 10 <> 0)"
for _n, _f, _s in (("nansum", reduce.nansum, "sum(v)"), ("nanmax", reduce.nanmax, "max(v)"), ("nanmin", reduce.nanmin, "min(v)"), ("nanmean", reduce.nanmean, "avg(v)"), ("nanvar", reduce.nanvar, "var_pop(v)"), ("nanstd", reduce.nanstd, "stddev_pop(v)"), ("nanmedian", reduce.nanmedian, "median(v)"), ("nanpercentile", lambda a: reduce.nanpercentile(a, 75), "quantile_cont(v, 0.75)"), ("nanquantile", lambda a: reduce.nanquantile(a, 0.1), "quantile_cont(v, 0.1)")):
    add(f"nan_{_n}", _nan(_f), f"SELECT {sql_round(_s, 4)} AS v FROM {_NANV}", 4)
add("nanprod", _nan(lambda a: reduce.nanprod(a * 1e-7 + 1.0)), f"SELECT {sql_round('product(v * 1e-7 + 1.0)')} AS v FROM {_NANV}")
add("nanargmax", _nan(reduce.nanargmax), f"SELECT arg_max(i0, (v, -i0)) AS v FROM {_NANV}")
add("nanargmin", _nan(reduce.nanargmin), f"SELECT arg_min(i0, (v, i0)) AS v FROM {_NANV}")
add("average", lambda s, d: reduce.average(orders(s, d, "x")[0], weights=orders(s, d, "g")[0]), f"SELECT {sql_round(f'sum({_typed("x")} * {_typed("g")}) / sum({_typed("g")})')} AS v FROM orders")
add("cov", _m(lambda a: reduce.cov(a, rowvar=False)), f"SELECT a.i1 AS i0, b.i1, {sql_round('covar_samp(a.v, b.v)')} AS v FROM {_M} a JOIN {_M} b ON a.i0 = b.i0 GROUP BY ALL")
add("corrcoef", _m(lambda a: reduce.corrcoef(a, rowvar=False)), f"SELECT a.i1 AS i0, b.i1, {sql_round('corr(a.v, b.v)')} AS v FROM {_M} a JOIN {_M} b ON a.i0 = b.i0 GROUP BY ALL")
add("norm", _x(reduce.norm), f"SELECT {sql_round('sqrt(sum(a * a))')} AS v FROM {_V}")
add("norm_l1", _x(lambda a: reduce.norm(a, 1)), f"SELECT {sql_round('sum(abs(a))', 4)} AS v FROM {_V}", 4)
for _n, _f in (("allclose", lambda a, b: reduce.allclose(a, b)), ("array_equal", reduce.array_equal), ("array_equiv", reduce.array_equiv)):
    add(_n, lambda s, d, f=_f: f(orders(s, d, "x")[0], orders(s, d, "x")[0]), "SELECT true AS v")
add("apply_along_axis", _m(lambda a: reduce.apply_along_axis(np.max, 1, a)), f"SELECT i0, {sql_round('max(v)')} AS v FROM {_M} GROUP BY i0")
add("apply_over_axes", _m(lambda a: reduce.apply_over_axes(reduce.sum_, a, [0, 1])), f"SELECT 0::BIGINT AS i0, 0::BIGINT AS i1, {sql_round('sum(v)')} AS v FROM {_M}")
add("bincount", _k(lambda a: reduce.bincount(a + 2)), f"SELECT k + 2 AS i0, count(*) AS v FROM {_V} GROUP BY k")
add("histogram", _e(lambda a: reduce.histogram(a, 10)[0]), f"WITH r AS (SELECT min(v) AS lo, max(v) AS hi FROM {_E}) SELECT g.i0, (SELECT count(*) FROM {_E}, r WHERE least(floor((v - lo) / ((hi - lo) / 10)), 9) = g.i0) AS v FROM range(10) g(i0)")
add("histogram_bin_edges", _e(lambda a: as_darray(reduce.histogram_bin_edges(a, 10))), f"WITH r AS (SELECT min(v) AS lo, max(v) AS hi FROM {_E}) SELECT g.i0, {sql_round('lo + (hi - lo) * g.i0 / 10')} AS v FROM range(11) g(i0), r")
_bins = lambda c, n: f"least(floor(({c} - min({c}) OVER ()) / ((max({c}) OVER () - min({c}) OVER ()) / {n})), {n - 1})::BIGINT"
add("histogram2d", lambda s, d: reduce.histogram2d(*orders(s, d, "x", "u"), bins=4)[0], f"WITH c AS (SELECT {_bins('a', 4)} AS p, {_bins('b', 4)} AS q FROM {_V}) SELECT x.p AS i0, y.q AS i1, count(c.p) AS v FROM range(4) x(p) CROSS JOIN range(4) y(q) LEFT JOIN c ON c.p = x.p AND c.q = y.q GROUP BY ALL")
add("histogramdd", lambda s, d: reduce.histogramdd(orders(s, d, "x", "u", "g"), bins=3)[0], f"WITH o AS (SELECT {_typed('x')} AS a, {_typed('u')} AS b, {_typed('g')} AS g FROM orders), c AS (SELECT {_bins('a', 3)} AS p, {_bins('b', 3)} AS q, {_bins('g', 3)} AS r FROM o) SELECT x.p AS i0, y.q AS i1, z.r AS i2, count(c.p) AS v FROM range(3) x(p) CROSS JOIN range(3) y(q) CROSS JOIN range(3) z(r) LEFT JOIN c ON c.p = x.p AND c.q = y.q AND c.r = z.r GROUP BY ALL")

# -- order ---------------------------------------------------------------------------------------------
_ORDERED = f"(SELECT row_number() OVER (ORDER BY v, i0) - 1 AS r, i0, v FROM {_E})"
add("sort", _e(scan.sort), f"SELECT r AS i0, {sql_round('v')} AS v FROM {_ORDERED}")
add("msort", _e(scan.msort), ORACLES["sort"])
add("partition", _e(scan.partition), ORACLES["sort"])
add("sort_complex", _e(scan.sort_complex), ORACLES["sort"])
add("argsort", _e(scan.argsort), f"SELECT r AS i0, i0 AS v FROM {_ORDERED}")
add("argpartition", _e(scan.argpartition), ORACLES["argsort"])
add("lexsort", lambda s, d: scan.lexsort(orders(s, d, "l", "k")), f"SELECT row_number() OVER (ORDER BY {_typed('k')}, {_typed('l')}, o_orderkey) - 1 AS i0, o_orderkey AS v FROM orders")
add("top_k", _e(lambda a: scan.top_k(a, 10)[1]), f"SELECT row_number() OVER (ORDER BY v DESC, i0) - 1 AS i0, i0 AS v FROM {_E} ORDER BY 1 LIMIT 10")
add("top_k_smallest", _e(lambda a: scan.top_k(a, 10, largest=False)[0]), f"SELECT row_number() OVER (ORDER BY v, i0) - 1 AS i0, {sql_round('v')} AS v FROM {_E} ORDER BY 1 LIMIT 10")
add("cumsum", _e(scan.cumsum), f"SELECT i0, {sql_round('sum(v) OVER (ORDER BY i0)', 4)} AS v FROM {_E}", 4)
add("nancumsum", _nan(scan.nancumsum), f"SELECT i0, {sql_round('sum(w) OVER (ORDER BY i0)', 4)} AS v FROM (SELECT event_id AS i0, CASE WHEN event_id % 10 = 0 THEN 0 ELSE value END AS w FROM events)", 4)
add("cumprod", _x(lambda a: scan.cumprod(a * 1e-5 + 1.0)), f"SELECT i0, {sql_round('product(a * 1e-5 + 1.0) OVER (ORDER BY i0)')} AS v FROM {_V}")
add("cumproduct", _x(lambda a: scan.cumproduct(a * 1e-5 + 1.0)), ORACLES["cumprod"])
add("nancumprod", _nan(lambda a: scan.nancumprod(a * 1e-7 + 1.0)), f"SELECT i0, {sql_round('product(w) OVER (ORDER BY i0)')} AS v FROM (SELECT event_id AS i0, CASE WHEN event_id % 10 = 0 THEN 1 ELSE value * 1e-7 + 1.0 END AS w FROM events)")
_DIFF = f"SELECT i0, {sql_round('w - v')} AS v FROM (SELECT i0, v, lead(v) OVER (ORDER BY i0) AS w FROM {_E}) WHERE w IS NOT NULL"
add("diff", _e(scan.diff), _DIFF)
add("ediff1d", _e(scan.ediff1d), _DIFF)
add("gradient", _e(scan.gradient), f"SELECT i0, {sql_round('CASE WHEN p IS NULL THEN q - v WHEN q IS NULL THEN v - p ELSE (q - p) / 2 END')} AS v FROM (SELECT i0, v, lag(v) OVER (ORDER BY i0) AS p, lead(v) OVER (ORDER BY i0) AS q FROM {_E})")
add("trapz", _e(scan.trapz), f"SELECT {sql_round('sum((v + w) / 2)', 4)} AS v FROM (SELECT v, lead(v) OVER (ORDER BY i0) AS w FROM {_E})", 4)
_FOLD = "d - 2 * pi() * floor((d + pi()) / (2 * pi()))"
add("unwrap", _x(lambda a: scan.unwrap(a * 4.0)), f"SELECT i0, {sql_round(f'v + coalesce(sum(CASE WHEN abs(d) < pi() THEN 0 ELSE (CASE WHEN {_FOLD} = -pi() AND d > 0 THEN pi() ELSE {_FOLD} END) - d END) OVER (ORDER BY i0), 0)')} AS v FROM (SELECT i0, a * 4 AS v, a * 4 - lag(a * 4) OVER (ORDER BY i0) AS d FROM {_V})")
add("searchsorted", lambda s, d: scan.searchsorted(scan.sort(events(s, d)), orders(s, d, "g")[0]), f"WITH p AS MATERIALIZED (SELECT value AS v, row_number() OVER (ORDER BY value) AS r FROM events), q AS (SELECT o_orderkey AS i0, {_typed('g')} AS v FROM orders) SELECT i0, coalesce((SELECT count(*) FROM p WHERE p.v < q.v), 0)::BIGINT AS v FROM q")
_BINS = [-1.5, -0.5, 0.0, 0.75, 1.5]
add("digitize", _x(lambda a: scan.digitize(a, as_darray(_BINS))), f"SELECT i0, ({' + '.join(f'(a >= {b})::BIGINT' for b in _BINS)})::BIGINT AS v FROM {_V}")
add("interp", _x(lambda a: scan.interp(a, as_darray([-1.0, 0.0, 2.0]), as_darray([5.0, 1.0, 3.0]))), f"SELECT i0, {sql_round('CASE WHEN a <= -1 THEN 5.0 WHEN a < 0 THEN 5.0 - 4.0 * (a + 1) WHEN a < 2 THEN 1.0 + a ELSE 3.0 END')} AS v FROM {_V}")
_CONV = "coalesce(v, 0) * 0.5 + coalesce(lag(v) OVER (ORDER BY i0), 0) * 0.25 + coalesce(lag(v, 2) OVER (ORDER BY i0), 0) * 0.125"
add("convolve", _e(lambda a: scan.convolve(a, [0.5, 0.25, 0.125], "valid")), f"SELECT i0 - 2 AS i0, {sql_round('c')} AS v FROM (SELECT i0, {_CONV} AS c FROM {_E}) WHERE i0 >= 2")
add("correlate", _e(lambda a: scan.correlate(a, [0.125, 0.25, 0.5])), ORACLES["convolve"])

# -- sets ----------------------------------------------------------------------------------------------
_SUPP = lambda f: lambda s, d: f(DArray.columns(_read(s, d, "orders"), "o_orderkey", F.expr("o_custkey"))[0], DArray.columns(_read(s, d, "supplier").withColumn("k", F.col("s_suppkey") * 3), "s_suppkey", F.expr("k"))[0])
_RANKED = "SELECT row_number() OVER (ORDER BY v) - 1 AS i0, v FROM ({}) t"
_A, _B = "SELECT o_custkey AS v FROM orders", "SELECT s_suppkey * 3 AS v FROM supplier"
add("unique", _SUPP(lambda a, b: sets.unique(a)), _RANKED.format(f"SELECT DISTINCT v FROM ({_A})"))
add("unique_counts", _SUPP(lambda a, b: sets.unique(a, return_counts=True)[1]), f"SELECT row_number() OVER (ORDER BY v) - 1 AS i0, n AS v FROM (SELECT v, count(*) AS n FROM ({_A}) GROUP BY v)")
add("unique_inverse", _SUPP(lambda a, b: sets.unique(a, return_inverse=True)[1]), "SELECT o_orderkey AS i0, dense_rank() OVER (ORDER BY o_custkey) - 1 AS v FROM orders")
add("union1d", _SUPP(sets.union1d), _RANKED.format(f"{_A} UNION {_B}"))
add("intersect1d", _SUPP(sets.intersect1d), _RANKED.format(f"{_A} INTERSECT {_B}"))
add("setdiff1d", _SUPP(sets.setdiff1d), _RANKED.format(f"{_A} EXCEPT {_B}"))
add("setxor1d", _SUPP(sets.setxor1d), _RANKED.format(f"(({_A}) EXCEPT ({_B})) UNION (({_B}) EXCEPT ({_A}))"))
add("isin", _SUPP(sets.isin), f"SELECT o_orderkey AS i0, o_custkey IN ({_B}) AS v FROM orders")
add("in1d", _SUPP(sets.in1d), ORACLES["isin"])

# -- selection and assignment --------------------------------------------------------------------------
_sel = lambda sql, src=_V: f"SELECT {sql} FROM {src}"
_RA = sql_round("a")
_KEEP = f"SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, {_RA} AS v FROM {_V} WHERE a > 1"
add("slice", _x(lambda a: a[10:500]), _sel(f"i0 - 10 AS i0, {_RA} AS v", f"{_V} WHERE i0 >= 10 AND i0 < 500"))
add("slice_step", _x(lambda a: a[400:10:-3]), _sel(f"(400 - i0) // 3 AS i0, {_RA} AS v", f"{_V} WHERE i0 <= 400 AND i0 > 10 AND (400 - i0) % 3 = 0"))
add("getitem_row", _m(lambda a: a[7]), f"SELECT i1 AS i0, {sql_round('v')} AS v FROM {_M} WHERE i0 = 7")
add("getitem_ellipsis", _m(lambda a: a[..., 3]), f"SELECT i0, {sql_round('v')} AS v FROM {_M} WHERE i1 = 3")
add("take", _x(lambda a: select.take(a, [5, 3, 5, 99])), f"SELECT p.pos AS i0, {_RA} AS v FROM (VALUES (0::BIGINT, 5), (1, 3), (2, 5), (3, 99)) p(pos, k) JOIN {_V} ON i0 = p.k")
for _n, _f in (("mask", lambda a: a[a > 1.0]), ("extract", lambda a: select.extract(a > 1.0, a)), ("compress", lambda a: select.compress(a > 1.0, a))):
    add(_n, _x(_f), _KEEP)
add("where_select", lambda s, d: (lambda a, b: select.where(a > b, a, b))(*orders(s, d, "x", "u")), f"SELECT i0, {sql_round('greatest(a, b)')} AS v FROM {_V}")
_IDX = f"SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, 0::BIGINT AS i1, i0 AS v FROM {_V} WHERE k <> 0"
add("where_indices", _k(lambda a: select.where(a)), _IDX)
add("argwhere", _k(select.argwhere), _IDX)
_FLAT = f"SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, i0 AS v FROM {_V} WHERE k <> 0"
add("nonzero", _k(lambda a: select.nonzero(a)[0]), _FLAT)
add("flatnonzero", _k(select.flatnonzero), _FLAT)
add("assign_slice", _x(lambda a: a.assign(slice(5, 20), 9.0)), _sel(f"i0, {sql_round('CASE WHEN i0 >= 5 AND i0 < 20 THEN 9.0 ELSE a END')} AS v"))
add("assign_mask", _x(lambda a: a.assign(a < 0.0, 0.0)), _sel(f"i0, {sql_round('greatest(a, 0)')} AS v"))
add("assign_index", _x(lambda a: a.assign(as_darray([3, 8, 3]), as_darray([1.0, 2.0, 4.0]))), _sel(f"i0, {sql_round('CASE WHEN i0 = 3 THEN 4.0 WHEN i0 = 8 THEN 2.0 ELSE a END')} AS v"))
add("put", _x(lambda a: select.put(a, [2, 4], [7.0, 8.0])), _sel(f"i0, {sql_round('CASE WHEN i0 = 2 THEN 7.0 WHEN i0 = 4 THEN 8.0 ELSE a END')} AS v"))
add("putmask", _x(lambda a: select.putmask(a, a > 1.0, 1.0)), _sel(f"i0, {sql_round('least(a, 1.0)')} AS v"))
add("place", _x(lambda a: select.place(a, a > 1.0, [1.0, 2.0])), f"SELECT i0, {sql_round('CASE WHEN a > 1 THEN 1.0 + (r - 1) % 2 ELSE a END')} AS v FROM (SELECT *, count(*) FILTER (a > 1) OVER (ORDER BY i0) AS r FROM {_V})")
add("choose", lambda s, d: (lambda k, x, u: select.choose((k + 2) % 2, [x, u]))(*orders(s, d, "k", "x", "u")), _sel(f"i0, {sql_round('CASE WHEN (k + 2) % 2 = 0 THEN a ELSE b END')} AS v"))
add("select", _x(lambda a: select.select([a < -1.0, a > 1.0], [a * 0.0 - 1.0, a * 0.0 + 1.0], 0.0)), _sel(f"i0, {sql_round('CASE WHEN a < -1 THEN -1.0 WHEN a > 1 THEN 1.0 ELSE 0.0 END')} AS v"))
add("delete", _x(lambda a: select.delete(a, [1, 3])), _sel(f"i0 - (i0 > 1)::INT - (i0 > 3)::INT AS i0, {_RA} AS v", f"{_V} WHERE i0 NOT IN (1, 3)"))
add("insert", _x(lambda a: select.insert(a, 2, [7.0])), _sel(f"i0 + (i0 >= 2)::INT AS i0, {_RA} AS v") + " UNION ALL SELECT 2, 7.0")
add("trim_zeros", _k(lambda a: select.trim_zeros((a + 2) * (a - 2))), f"SELECT i0 - (SELECT min(i0) FROM {_V} WHERE k NOT IN (-2, 2)) AS i0, (k + 2) * (k - 2) AS v FROM {_V} WHERE i0 BETWEEN (SELECT min(i0) FROM {_V} WHERE k NOT IN (-2, 2)) AND (SELECT max(i0) FROM {_V} WHERE k NOT IN (-2, 2))")
add("fill_diagonal", _m(lambda a: select.fill_diagonal(a, 1.0)), f"SELECT i0, i1, {sql_round('CASE WHEN i0 = i1 THEN 1.0 ELSE v END')} AS v FROM {_M}")
add("diagonal", _m(creation.diagonal), f"SELECT i0, {sql_round('v')} AS v FROM {_M} WHERE i0 = i1")
add("diag", _m(creation.diag), ORACLES["diagonal"])
add("take_along_axis", _m(lambda a: select.take_along_axis(a, shape.expand_dims(reduce.argmax(a, 1), 1), 1)), f"SELECT i0, 0::BIGINT AS i1, {sql_round('max(v)')} AS v FROM {_M} GROUP BY i0")
add("put_along_axis", _m(lambda a: select.put_along_axis(a, shape.expand_dims(reduce.argmax(a, 1), 1), 0.0, 1)), f"SELECT i0, i1, {sql_round('CASE WHEN r = 1 THEN 0.0 ELSE v END')} AS v FROM (SELECT *, row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1) AS r FROM {_M})")
add("ravel_multi_index", lambda s, d: (lambda a: select.ravel_multi_index([a % 3.0, a % 4.0], (3, 4)).astype("bigint"))(creation.arange(24)), "SELECT i0, ((i0 % 3) * 4 + i0 % 4)::BIGINT AS v FROM range(24) t(i0)")
add("unravel_index", lambda s, d: select.unravel_index(creation.arange(24), (4, 6))[1], "SELECT i0, i0 % 6 AS v FROM range(24) t(i0)")

# -- shapes --------------------------------------------------------------------------------------------
_RV = sql_round("v")
_MS = {
    "transpose": (shape.transpose, "i1 AS i0, i0 AS i1"), "swapaxes": (lambda a: shape.swapaxes(a, 0, 1), "i1 AS i0, i0 AS i1"), "moveaxis": (lambda a: shape.moveaxis(a, 0, 1), "i1 AS i0, i0 AS i1"), "rollaxis": (lambda a: shape.rollaxis(a, 1), "i1 AS i0, i0 AS i1"),
    "reshape": (lambda a: shape.reshape(a, (-1, 16)), "(i0 * 64 + i1) // 16 AS i0, (i0 * 64 + i1) % 16 AS i1"), "ravel": (shape.ravel, "i0 * 64 + i1 AS i0"), "expand_dims": (lambda a: shape.expand_dims(a, 1), "i0, 0::BIGINT AS i1, i1 AS i2"), "squeeze": (lambda a: shape.squeeze(shape.expand_dims(a, 0)), "i0, i1"),
    "atleast_1d": (shape.atleast_1d, "i0, i1"), "atleast_2d": (shape.atleast_2d, "i0, i1"), "atleast_3d": (shape.atleast_3d, "i0, i1, 0::BIGINT AS i2"), "fliplr": (shape.fliplr, "i0, 63 - i1 AS i1"), "flipud": (shape.flipud, "(SELECT max(vec_id) FROM embeddings) - i0 AS i0, i1"), "flip": (lambda a: shape.flip(a, 1), "i0, 63 - i1 AS i1"),
    "rot90": (shape.rot90, "63 - i1 AS i0, i0 AS i1"), "roll": (lambda a: shape.roll(a, 5, 1), "i0, (i1 + 5) % 64 AS i1"), "copy": (creation.copy, "i0, i1"), "block_repartition": (lambda a: a.repartition(3), "i0, i1"),
}
for _n, (_f, _s) in _MS.items():
    add(_n, _m(_f), f"SELECT {_s}, {_RV} AS v FROM {_M}")
_N = "(SELECT count(*) FROM orders)"
_CAT = f"SELECT i0, {_RA} AS v FROM {_V} UNION ALL SELECT i0 + {_N}, {sql_round('b')} FROM {_V}"
for _n, _f in (("concatenate", lambda a, b: shape.concatenate([a, b])), ("hstack", lambda a, b: shape.hstack([a, b])), ("append", shape.append)):
    add(_n, lambda s, d, f=_f: f(*orders(s, d, "x", "u")), _CAT)
_ROWS = f"SELECT 0::BIGINT AS i0, i0 AS i1, {_RA} AS v FROM {_V} UNION ALL SELECT 1, i0, {sql_round('b')} FROM {_V}"
for _n, _f in (("vstack", shape.vstack), ("row_stack", shape.row_stack), ("stack", shape.stack)):
    add(_n, lambda s, d, f=_f: f(orders(s, d, "x", "u")), _ROWS)
add("column_stack", lambda s, d: shape.column_stack(orders(s, d, "x", "u")), f"SELECT i0, 0::BIGINT AS i1, {_RA} AS v FROM {_V} UNION ALL SELECT i0, 1, {sql_round('b')} FROM {_V}")
add("dstack", lambda s, d: shape.dstack(orders(s, d, "x", "u")), f"SELECT 0::BIGINT AS i0, i0 AS i1, 0::BIGINT AS i2, {_RA} AS v FROM {_V} UNION ALL SELECT 0, i0, 1, {sql_round('b')} FROM {_V}")
for _n, _f in (("split", lambda a: shape.split(a, 4, 1)[1]), ("hsplit", lambda a: shape.hsplit(a, 4)[1]), ("array_split", lambda a: shape.array_split(a, 4, 1)[1])):
    add(_n, _m(_f), f"SELECT i0, i1 - 16 AS i1, {_RV} AS v FROM {_M} WHERE i1 >= 16 AND i1 < 32")
add("vsplit", _m(lambda a: shape.vsplit(a, [10, 20])[1]), f"SELECT i0 - 10 AS i0, i1, {_RV} AS v FROM {_M} WHERE i0 >= 10 AND i0 < 20")
add("dsplit", _m(lambda a: shape.dsplit(shape.expand_dims(a, 0), 4)[1]), f"SELECT 0::BIGINT AS i0, i0 AS i1, i1 - 16 AS i2, {_RV} AS v FROM {_M} WHERE i1 >= 16 AND i1 < 32")
add("repeat", _x(lambda a: shape.repeat(a, 3)), f"SELECT i0 * 3 + j AS i0, {_RA} AS v FROM {_V}, range(3) r(j)")
add("tile", _x(lambda a: shape.tile(a, 2)), f"SELECT i0 + j * {_N} AS i0, {_RA} AS v FROM {_V}, range(2) r(j)")
add("resize", _x(lambda a: shape.resize(a, (2, a.size))), f"SELECT j AS i0, i0 AS i1, {_RA} AS v FROM {_V}, range(2) r(j)")
add("pad", _x(lambda a: shape.pad(a, 2)), f"SELECT i0 + 2 AS i0, {_RA} AS v FROM {_V} UNION ALL SELECT unnest([0, 1, {_N} + 2, {_N} + 3]), 0.0")
add("broadcast_to", _x(lambda a: shape.broadcast_to(a, (3, a.size))), f"SELECT j AS i0, i0 AS i1, {_RA} AS v FROM {_V}, range(3) r(j)")
add("shape", _m(lambda a: as_darray(list(shape.shape(a)))), "SELECT 0::BIGINT AS i0, count(*) AS v FROM embeddings UNION ALL SELECT 1, 64")
add("size", _m(lambda a: as_darray(shape.size(a))), f"SELECT count(*) AS v FROM {_M}")
add("ndim", _m(lambda a: as_darray(shape.ndim(a))), "SELECT 2::BIGINT AS v")

# -- creation ------------------------------------------------------------------------------------------
_R = lambda n, e: f"SELECT i0, {e} AS v FROM range({n}) t(i0)"
_R2 = lambda n, m, e: f"SELECT a.i0, b.i1, {e} AS v FROM range({n}) a(i0), range({m}) b(i1)"
for _n, _f, _s in (
    ("arange", lambda: creation.arange(3, 103), _R(100, "i0 + 3")), ("linspace", lambda: creation.linspace(0, 1, 101), _R(101, sql_round("i0 / 100.0"))), ("logspace", lambda: creation.logspace(0, 3, 31), _R(31, sql_round("pow(10.0, i0 / 10.0)"))), ("geomspace", lambda: creation.geomspace(1, 1000, 31), _R(31, sql_round("pow(10.0, i0 / 10.0)"))),
    ("zeros", lambda: creation.zeros((3, 4)), _R2(3, 4, "0.0::DOUBLE")), ("ones", lambda: creation.ones((3, 4)), _R2(3, 4, "1.0::DOUBLE")), ("empty", lambda: creation.empty((3, 4)), _R2(3, 4, "0.0::DOUBLE")), ("full", lambda: creation.full((3, 4), 2.5), _R2(3, 4, "2.5::DOUBLE")),
    ("eye", lambda: creation.eye(5, 6, 1), _R2(5, 6, "(CASE WHEN i1 = i0 + 1 THEN 1.0 ELSE 0.0 END)::DOUBLE")), ("identity", lambda: creation.identity(5), _R2(5, 5, "(CASE WHEN i1 = i0 THEN 1.0 ELSE 0.0 END)::DOUBLE")), ("tri", lambda: creation.tri(5), _R2(5, 5, "(CASE WHEN i1 <= i0 THEN 1.0 ELSE 0.0 END)::DOUBLE")),
    ("diagflat", lambda: creation.diagflat(creation.arange(1, 5)), _R2(4, 4, "(CASE WHEN i1 = i0 THEN i0 + 1 ELSE 0 END)::DOUBLE")), ("fromfunction", lambda: creation.fromfunction(lambda i, j: i * 2 + j, (4, 5)), _R2(4, 5, "i0 * 2 + i1")), ("indices", lambda: creation.indices((4, 5))[1], _R2(4, 5, "i1")), ("meshgrid", lambda: creation.meshgrid(creation.arange(5), creation.arange(4))[1], _R2(4, 5, "i0")),
    ("vander", lambda: creation.vander(creation.arange(1, 6), 4), _R2(5, 4, "pow(i0 + 1, 3 - i1)::DOUBLE")), ("bartlett", lambda: creation.bartlett(12), _R(12, sql_round("1 - abs(i0 * 2.0 / 11 - 1)"))), ("hanning", lambda: creation.hanning(12), _R(12, sql_round("0.5 - 0.5 * cos(2 * pi() * i0 / 11)"))), ("hamming", lambda: creation.hamming(12), _R(12, sql_round("0.54 - 0.46 * cos(2 * pi() * i0 / 11)"))),
    ("blackman", lambda: creation.blackman(12), _R(12, sql_round("0.42 - 0.5 * cos(2 * pi() * i0 / 11) + 0.08 * cos(4 * pi() * i0 / 11)"))), ("kaiser", lambda: creation.kaiser(12, 5.0), "WITH w AS (SELECT i0, 5 * sqrt(1 - pow(i0 * 2.0 / 11 - 1, 2)) AS z FROM range(12) t(i0)) SELECT i0, round(sum(pow(z / 2, 2 * k) / pow(factorial(k::INT)::DOUBLE, 2)) / (SELECT sum(pow(2.5, 2 * j) / pow(factorial(j::INT)::DOUBLE, 2)) FROM range(28) u(j)), 6) AS v FROM w, range(28) s(k) GROUP BY i0"), ("array", lambda: creation.array([1.0, 2.0]), _R(2, "(i0 + 1)::DOUBLE")), ("asarray", lambda: creation.asarray([1.0, 2.0]), _R(2, "(i0 + 1)::DOUBLE")), ("asarray_chkfinite", lambda: creation.asarray_chkfinite([1.0, 2.0]), _R(2, "(i0 + 1)::DOUBLE")),
    ("fromiter", lambda: creation.fromiter(iter([1.0, 2.0])), _R(2, "(i0 + 1)::DOUBLE")), ("frombuffer", lambda: creation.frombuffer(np.array([1.0, 2.0]).tobytes()), _R(2, "(i0 + 1)::DOUBLE")), ("diag_indices", lambda: creation.diag_indices(4), _R2(4, 2, "i0")),
    ("tril_indices", lambda: creation.tril_indices(3), "SELECT r AS i0, c AS i1, CASE c WHEN 0 THEN i ELSE j END AS v FROM (SELECT row_number() OVER (ORDER BY i, j) - 1 AS r, i, j FROM range(3) a(i), range(3) b(j) WHERE j <= i), range(2) t(c)"), ("triu_indices", lambda: creation.triu_indices(3), "SELECT r AS i0, c AS i1, CASE c WHEN 0 THEN i ELSE j END AS v FROM (SELECT row_number() OVER (ORDER BY i, j) - 1 AS r, i, j FROM range(3) a(i), range(3) b(j) WHERE j >= i), range(2) t(c)"),
    ("packbits", lambda: bits.packbits(creation.arange(20).map(lambda v: v % 3)), "SELECT i0 // 8 AS i0, bit_or(CASE WHEN i0 % 3 <> 0 THEN 1 << (7 - i0 % 8) ELSE 0 END)::BIGINT AS v FROM range(20) t(i0) GROUP BY 1"), ("unpackbits", lambda: bits.unpackbits(creation.arange(5)), "SELECT i0 * 8 + k AS i0, ((i0 >> (7 - k)) & 1)::BIGINT AS v FROM range(5) t(i0), range(8) u(k)"),
    ("polyadd", lambda: poly.polyadd(creation.arange(1, 4), creation.arange(1, 3)), _R(3, "CASE i0 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END::BIGINT")), ("polysub", lambda: poly.polysub(creation.arange(1, 4), creation.arange(1, 3)), _R(3, "1::BIGINT")), ("polymul", lambda: poly.polymul(creation.arange(1, 4), creation.arange(1, 3)), _R(4, "CASE i0 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 7 ELSE 6 END::BIGINT")),
    ("polyder", lambda: poly.polyder(as_darray([3.0, 2.0, 1.0])), _R(2, "CASE i0 WHEN 0 THEN 6.0 ELSE 2.0 END::DOUBLE")), ("polyint", lambda: poly.polyint(as_darray([3.0, 2.0])), _R(3, "CASE i0 WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 ELSE 0.0 END::DOUBLE")), ("poly", lambda: poly.poly(as_darray([1.0, 2.0])), _R(3, "CASE i0 WHEN 0 THEN 1.0 WHEN 1 THEN -3.0 ELSE 2.0 END::DOUBLE")), ("roots", lambda: scan.sort(poly.roots(as_darray([1.0, -3.0, 2.0]))), _R(2, "(i0 + 1)::DOUBLE")), ("polydiv", lambda: poly.polydiv(as_darray([1.0, -3.0, 2.0]), as_darray([1.0, -1.0]))[0], _R(2, "CASE i0 WHEN 0 THEN 1.0 ELSE -2.0 END::DOUBLE")),
):
    add(_n, lambda s, d, f=_f: f(), _s)
add("tril", _m(creation.tril), f"SELECT i0, i1, {sql_round('CASE WHEN i1 <= i0 THEN v ELSE 0 END')} AS v FROM {_M}")
add("triu", _m(creation.triu), f"SELECT i0, i1, {sql_round('CASE WHEN i1 >= i0 THEN v ELSE 0 END')} AS v FROM {_M}")

# -- contraction and linear algebra --------------------------------------------------------------------
add("dot", lambda s, d: contract.dot(*orders(s, d, "x", "u")), f"SELECT {sql_round('sum(a * b)')} AS v FROM {_V}")
add("inner", lambda s, d: contract.inner(*orders(s, d, "x", "u")), ORACLES["dot"])
add("vdot", lambda s, d: contract.vdot(*orders(s, d, "x", "u")), ORACLES["dot"])
add("outer", lambda s, d: contract.outer(creation.arange(1, 301), creation.arange(1, 201)), "SELECT i AS i0, j AS i1, ((i + 1) * (j + 1))::BIGINT AS v FROM range(300) a(i), range(200) b(j)")
_GRAM = f"SELECT a.i1 AS i0, b.i1, {sql_round('sum(a.v * b.v)')} AS v FROM {_M} a JOIN {_M} b ON a.i0 = b.i0 GROUP BY ALL"
add("matmul_gram", _m(lambda a: a.T @ a), _GRAM)
add("tensordot", _m(lambda a: contract.tensordot(a.T, a, 1)), _GRAM)
add("matmul_tiled", _m(lambda a: contract.matmul(a.T, a, tiled=True)), _GRAM)
add("einsum", _m(lambda a: contract.einsum("ij,ik->jk", a, a)), _GRAM)
add("einsum_mttkrp", lambda s, d: contract.einsum("ijk,jf,kf->if", creation.fromfunction(lambda i, j, k: i + j * k, (10, 11, 12)), creation.fromfunction(lambda j, f: j - f, (11, 3)), creation.fromfunction(lambda k, f: k * f + 1, (12, 3))), "SELECT i AS i0, f AS i1, sum((i + j * k) * (j - f) * (k * f + 1))::BIGINT AS v FROM range(10) a(i), range(11) b(j), range(12) c(k), range(3) e(f) GROUP BY ALL")
add("trace", _m(contract.trace), f"SELECT {sql_round('sum(v)')} AS v FROM {_M} WHERE i0 = i1")
add("kron", lambda s, d: contract.kron(creation.arange(1, 4), creation.arange(1, 3)), "SELECT i * 2 + j AS i0, ((i + 1) * (j + 1))::BIGINT AS v FROM range(3) a(i), range(2) b(j)")
add("cross", _m(lambda a: contract.cross(a, shape.roll(a, 1, 1)), 3), f"SELECT i0, k AS i1, {sql_round('CASE k WHEN 0 THEN y * y - z * x WHEN 1 THEN z * z - x * y ELSE x * x - y * z END')} AS v FROM (SELECT vec_id AS i0, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), range(3) t(k)")


def _design(spark, sf_dir) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(F.array(F.lit(1.0), F.col("l_quantity")).alias("x"), F.col("l_extendedprice").alias("y"))


def _coefficients(b: np.ndarray) -> DArray:
    return as_darray(np.asarray(b, float))


_FIT = "(SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)"
_LINE = f"SELECT i0, {sql_round('CASE i0 WHEN 0 THEN a ELSE b END', 3)} AS v FROM {_FIT}, range(2) t(i0)"
add("lstsq", lambda s, d: _coefficients(linalg.lstsq(_design(s, d), 2)), _LINE, 3)
add("linear_regression", lambda s, d: _coefficients(linalg.ridge(_design(s, d), 2, 0.0)), _LINE, 3)
add("ridge", lambda s, d: _coefficients(linalg.ridge(_design(s, d), 2, 10.0)), f"SELECT i0, {sql_round('CASE i0 WHEN 0 THEN (sy * (sxx + 10) - sx * sxy) / ((n + 10) * (sxx + 10) - sx * sx) ELSE ((n + 10) * sxy - sx * sy) / ((n + 10) * (sxx + 10) - sx * sx) END', 3)} AS v FROM (SELECT count(*)::DOUBLE AS n, sum(l_quantity) AS sx, sum(l_quantity * l_quantity) AS sxx, sum(l_extendedprice) AS sy, sum(l_quantity * l_extendedprice) AS sxy FROM lineitem), range(2) t(i0)", 3)
add("polyfit", lambda s, d: (lambda x, u: _coefficients(linalg.polyfit(u, x, 1)))(*orders(s, d, "x", "u")), f"SELECT i0, {sql_round('CASE i0 WHEN 0 THEN b ELSE a END')} AS v FROM (SELECT regr_slope(a, b) AS b, regr_intercept(a, b) AS a FROM {_V}), range(2) t(i0)")
add("gram", _m(lambda a: as_darray(linalg.gram(linalg.rows_of(a), 64))), _GRAM)
add("qr_r", _m(lambda a: linalg.qr(a)[1]))
add("qr_gram", _m(lambda a: (lambda r: r.T @ r)(linalg.qr(a)[1])), _GRAM)
add("direct_tsqr_product", _m(lambda a: (lambda q, r: q @ r)(*linalg.direct_qr(a))), f"SELECT i0, i1, {_RV} AS v FROM {_M}")
add("svd_s", _m(lambda a: linalg.svd(a)[1]))
add("svd_norm", _m(lambda a: (lambda s: reduce.sum_(s * s))(linalg.svd(a)[1])), f"SELECT {sql_round('sum(v * v)')} AS v FROM {_M}")
add("pca", _m(lambda a: abs(linalg.pca(a))))
_SPD = lambda: as_darray(np.array([[4.0, 2.0], [2.0, 5.0]]))
add("inv", lambda s, d: linalg.inv(_SPD()), "SELECT i0, i1, CASE WHEN i0 <> i1 THEN -0.125 WHEN i0 = 0 THEN 0.3125 ELSE 0.25 END::DOUBLE AS v FROM range(2) a(i0), range(2) b(i1)")
add("cholesky", lambda s, d: linalg.cholesky(_SPD()), "SELECT i0, i1, CASE WHEN i0 = i1 THEN 2.0 WHEN i0 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM range(2) a(i0), range(2) b(i1)")
add("inv_uppertri", lambda s, d: linalg.inv_uppertri(as_darray(np.array([[2.0, 1.0], [0.0, 4.0]]))), "SELECT i0, i1, CASE WHEN i0 = 1 AND i1 = 0 THEN 0.0 WHEN i0 = 0 AND i1 = 0 THEN 0.5 WHEN i0 = 0 THEN -0.125 ELSE 0.25 END::DOUBLE AS v FROM range(2) a(i0), range(2) b(i1)")

# -- random --------------------------------------------------------------------------------------------
_ARGS = {"beta": (2, 3), "binomial": (10, 0.3), "chisquare": (3,), "f": (4, 7), "gamma": (2, 1.5), "geometric": (0.3,), "hypergeometric": (20, 30, 10), "integers": (0, 100), "logseries": (0.6,), "negative_binomial": (5, 0.4), "noncentral_chisquare": (3, 1.5), "noncentral_f": (4, 7, 1.5), "pareto": (3,), "power": (2,), "standard_t": (5,), "triangular": (0, 1, 3), "vonmises": (0, 2), "wald": (1, 2), "weibull": (2,), "zipf": (3,)}
#: Means of the distributions for these arguments; of the Cauchy distribution the median.
_MEANS = {"random": 0.5, "uniform": 0.5, "normal": 0, "beta": 0.4, "binomial": 3, "chisquare": 3, "exponential": 1, "f": 1.4, "gamma": 3, "geometric": 10 / 3, "gumbel": np.euler_gamma, "hypergeometric": 4, "integers": 49.5, "laplace": 0, "logistic": 0, "lognormal": np.exp(0.5), "logseries": -1.5 / np.log(0.4), "negative_binomial": 7.5, "noncentral_chisquare": 4.5, "noncentral_f": 1.925, "pareto": 0.5, "poisson": 1, "power": 2 / 3, "rayleigh": np.sqrt(np.pi / 2), "standard_cauchy": 0, "standard_normal": 0, "standard_t": 0, "triangular": 4 / 3, "vonmises": 0, "wald": 1, "weibull": np.sqrt(np.pi) / 2, "zipf": 1.3684327776}


def _drawn(spark, sf_dir, name: str) -> DataFrame:
    """Elements of a draw, whether their mean is that of the distribution, and whether the seed gives them again."""
    n = 200_000
    a, b = (random.RandomState(11).draw(name, n, *_ARGS.get(name, ())) for _ in range(2))
    both = a.combine(b.repartition(3), lambda x, y: F.struct(x.cast("double").alias("x"), (x == y).alias("same"))).df
    v = F.col("v.x")
    far = F.abs(F.percentile(v, 0.5)) / (np.pi / 2) if name == "standard_cauchy" else F.abs(F.avg(v) - float(_MEANS[name])) / F.stddev_pop(v)
    return both.agg(F.count("*").alias("n"), (far < 6 / n**0.5).alias("mean_fits"), F.bool_and("v.same").alias("same_again"))


for _n in random.DISTRIBUTIONS:
    add(f"random_{_n}", lambda s, d, n=_n: _drawn(s, d, n), "SELECT 200000::BIGINT AS n, true AS mean_fits, true AS same_again")
add("permutation", lambda s, d: scan.sort(random.RandomState(3).permutation(500)), "SELECT i0, i0 AS v FROM range(500) t(i0)")
add("train_test_split", lambda s, d: scan.sort(shape.concatenate([part.map(lambda v, k=k: v + k * 1000) for k, part in enumerate(random.RandomState(3).train_test_split(orders(s, d, "n")[0] * 0 + 1, test_size=0.3))])), f"SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, CASE WHEN i0 < {_N} - ceil({_N} * 0.3) THEN 1 ELSE 1001 END::BIGINT AS v FROM {_V}")


for _n, _f, _s in (
    ("diag_indices_from", lambda: creation.diag_indices_from(creation.zeros((4, 4))), ORACLES["diag_indices"]), ("tril_indices_from", lambda: creation.tril_indices_from(creation.zeros((3, 3))), ORACLES["tril_indices"]), ("triu_indices_from", lambda: creation.triu_indices_from(creation.zeros((3, 3))), ORACLES["triu_indices"]),
    ("ix_", lambda: select.ix_([1, 2], [3, 4, 5])[1], "SELECT 0::BIGINT AS i0, i1, i1 + 3 AS v FROM range(3) t(i1)"), ("require", lambda: shape.require([1.0, 2.0]), ORACLES["array"]), ("asscalar", lambda: as_darray(poly.asscalar(as_darray([7.0]))), "SELECT 7.0::DOUBLE AS v"), ("isscalar", lambda: as_darray(poly.isscalar(3)), "SELECT true AS v"),
    ("iscomplexobj", lambda: as_darray(poly.iscomplexobj(as_darray([1.0]))), "SELECT false AS v"), ("isrealobj", lambda: as_darray(poly.isrealobj(as_darray([1.0]))), "SELECT true AS v"), ("round_", lambda: bits.round_(creation.linspace(0, 3, 13)), _R(13, "round_even(i0 / 4.0, 0)::DOUBLE")),
    ("common_type", lambda: as_darray(np.dtype(poly.common_type(as_darray([1]))).itemsize), "SELECT 8::BIGINT AS v"), ("result_type", lambda: as_darray(poly.result_type("int32", "float64").itemsize), "SELECT 8::BIGINT AS v"), ("promote_types", lambda: as_darray(poly.promote_types("int32", "int64").itemsize), "SELECT 8::BIGINT AS v"),
    ("min_scalar_type", lambda: as_darray(poly.min_scalar_type(300).itemsize), "SELECT 2::BIGINT AS v"), ("mintypecode", lambda: as_darray(ord(poly.mintypecode(["f", "d"]))), "SELECT 100::BIGINT AS v"), ("obj2sctype", lambda: as_darray(np.dtype(poly.obj2sctype("f8")).itemsize), "SELECT 8::BIGINT AS v"), ("sctype2char", lambda: as_darray(ord(poly.sctype2char("f8"))), "SELECT 100::BIGINT AS v"),
    ("maximum_sctype", lambda: as_darray(np.dtype(poly.maximum_sctype("int16")).itemsize), "SELECT 8::BIGINT AS v"), ("einsum_path", lambda: as_darray(len(contract.einsum_path("ij,jk->ik", 0, 0)[0])), "SELECT 2::BIGINT AS v"),
):
    add(_n, lambda s, d, f=_f: f(), _s)


# -- models --------------------------------------------------------------------------------------------
def _rows(spark, sf_dir, y: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("x"), F.expr(y).cast("double").alias("y"))


_FAMILIES = {"linear": (glm.LinearRegression, "l_extendedprice / 1e5"), "ridge": (glm.Ridge, "l_extendedprice / 1e5"), "lasso": (glm.Lasso, "l_extendedprice / 1e5"), "elasticnet": (glm.ElasticNet, "l_extendedprice / 1e5"), "logistic": (glm.LogisticRegression, "l_extendedprice > 4e4"), "poisson": (glm.PoissonRegression, "l_linenumber")}


def _glm(family: str, solver: str):
    def run(spark, sf_dir):
        model, y = _FAMILIES[family]
        most = {"gd": 10, "sgd": 20, "block_sgd": 16}.get(solver, 100)
        return _coefficients(model(solver=solver, max_iter=most, tol=1e-7, lr=1e-5).fit(_rows(spark, sf_dir, y)).beta)

    return run


def _solved(h: dict, g: dict, k: int) -> str:
    """The k-th of three unknowns of h x = g by Cramer's rule."""
    det = lambda m: " + ".join(f"({m[0][i]}) * (({m[1][(i + 1) % 3]}) * ({m[2][(i + 2) % 3]}) - ({m[1][(i + 2) % 3]}) * ({m[2][(i + 1) % 3]}))" for i in range(3))
    rows = [[h[min(i, j), max(i, j)] for j in range(3)] for i in range(3)]
    return f"({det([[g[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)])}) / ({det(rows)})"


def _glm_sql(family: str, solver: str, steps: int) -> str:
    """Steps of Newton's method, or of gradient descent, one CTE each; three coefficients, the last an intercept."""
    y = _FAMILIES[family][1]
    mean, weight = {"logistic": ("1 / (1 + exp(-e))", "m * (1 - m)"), "poisson": ("exp(e)", "m")}.get(family, ("e", "1"))
    l1, l2 = {"ridge": (0, 0.5), "lasso": (1, 0), "elasticnet": (0.5, 0.25)}.get(family, (0, 0))
    x = ("x0", "x1", "1")
    out = [f"r AS (SELECT l_quantity / 50 AS x0, l_discount * 10 AS x1, ({y})::DOUBLE AS y FROM lineitem)", "b0 AS (SELECT 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2)"]
    for k in range(1, steps + 1):
        sums = [f"sum(({weight}) * {x[i]} * {x[j]}) + {l2 if i == j < 2 else 0} AS h{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum({x[i]} * (m - y)) + {f'first({l2} * c{i} + {l1} * sign(c{i}))' if i < 2 else 0} AS g{i}" for i in range(3)]
        out.append(f"s{k} AS (SELECT {', '.join(sums)}, first(c0) AS c0, first(c1) AS c1, first(c2) AS c2 FROM (SELECT *, {mean} AS m FROM (SELECT *, c0 * x0 + c1 * x1 + c2 AS e FROM r, b{k - 1})))")
        h, g = {(i, j): f"h{i}{j}" for i in range(3) for j in range(i, 3)}, [f"g{i}" for i in range(3)]
        step = (lambda i: f"1e-5 * g{i}") if solver == "gd" else lambda i: _solved(h, g, i)  # noqa: B023
        out.append(f"b{k} AS MATERIALIZED (SELECT {', '.join(f'c{i} - ({step(i)}) AS c{i}' for i in range(3))} FROM s{k})")
    return f"WITH {', '.join(out)} SELECT i0, {sql_round('CASE i0 WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END', 4)} AS v FROM b{steps}, range(3) t(i0)"


for _n, _solvers in (("linear", ("newton", "gd", "block_sgd")), ("ridge", ("newton",)), ("lasso", ("lbfgs",)), ("elasticnet", ("lbfgs",)), ("logistic", ("newton", "newton-cg", "irls", "lbfgs", "gd", "sgd", "block_sgd")), ("poisson", ("newton", "lbfgs"))):
    for _s in _solvers:
        add(f"glm_{_n}_{_s.replace('-', '_')}", _glm(_n, _s), None if "sgd" in _s else _glm_sql(_n, _s, 10 if _s == "gd" else 4 if _n in ("linear", "ridge", "lasso", "elasticnet") else 14), digits=4)


def _one_line(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    slope, start = glm.LinearRegression(tol=1e-3).fit(rows).beta
    return _coefficients([start, slope])


add("glm_linear_one_feature", _one_line, _LINE, 3)
add("standard_scaler", lambda s, d: preprocess.StandardScaler().fit_transform(_read(s, d, "orders").select(F.col("o_orderkey").alias("i0"), F.array("o_totalprice").alias("x"))).select("i0", F.col("x")[0].alias("v")), f"SELECT o_orderkey AS i0, {sql_round('(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders)')} AS v FROM orders")
add("robust_scaler", lambda s, d: preprocess.RobustScaler().fit_transform(_read(s, d, "orders").select(F.col("o_orderkey").alias("i0"), F.array("o_totalprice").alias("x"))).select("i0", F.col("x")[0].alias("v")), f"SELECT o_orderkey AS i0, {sql_round('(o_totalprice - (SELECT median(o_totalprice) FROM orders)) / (SELECT quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) FROM orders)')} AS v FROM orders")

# -- sources -------------------------------------------------------------------------------------------
_TABLE = f"SELECT c_custkey AS i0, 0::BIGINT AS i1, {sql_round('c_acctbal')} AS v FROM customer UNION ALL SELECT c_custkey, 1, c_nationkey::DOUBLE FROM customer"


def _customers(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))


def _round_trip(spark, sf_dir):
    path = shared_folder("kept")
    io.write(path, io.from_frame(_customers(spark, sf_dir), index="c_custkey"))
    return io.read(path)


def _through_text(header: bool):
    def run(spark, sf_dir):
        path = shared_folder("text")
        rows = _customers(spark, sf_dir)
        rows.orderBy("c_custkey").coalesce(1).drop("c_custkey").write.option("header", header).csv(path)
        a = io.read_csv(path, has_header=True) if header else io.loadtxt(path, ",")
        first = rows.agg(F.min("c_custkey")).first()[0]
        return DArray(a.df.withColumn("i0", F.col("i0") + first), a.shape)

    return run


add("write_read", _round_trip, _TABLE)
add("read_csv", _through_text(True), _TABLE)
add("loadtxt", _through_text(False), _TABLE)
add("from_frame", lambda s, d: io.from_frame(_customers(s, d), index="c_custkey"), _TABLE)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day of the events as a stream: each trigger adds a file of results, and the last one holds all."""
    events = _read(spark, sf_dir, "events")
    out, at = shared_folder("stream"), shared_folder("stream-state")
    found = windows.window_reductions(windows.read_stream(spark, f"{sf_dir}/events.parque[t]", events.schema), "ts", "value", "1 day", "3650 days", ["event_type"])
    keep = lambda df, k: df.write.mode("overwrite").parquet(out)
    found.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).withColumn("start", F.date_format("start", "yyyy-MM-dd")).select("start", "event_type", "n", "sum", "min", "max")


add("stream_windows", _stream, f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(value) AS n, {', '.join(f'{sql_round(e, 4)} AS {c}' for e, c in (('sum(value)', 'sum'), ('min(value)', 'min'), ('max(value)', 'max')))} FROM events GROUP BY ALL", 4)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked revenue of lineitem: a mask, a product and five reductions of one scan."""
    li = _read(spark, sf_dir, "lineitem")
    v = F.col("l_extendedprice") * F.col("l_discount")
    aggs = [F.sum(v).alias("total"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), reduce.min_agg(v).alias("least"), F.max(v).alias("greatest")]
    out = li.where(U.BINARY["greater"](F.col("l_discount"), F.lit(0.05))).agg(*aggs)
    return out.select(*[F.round(c, 2).alias(c) for c in out.columns])


QUERIES["masked_revenue"] = flagship
ORACLES["masked_revenue"] = "SELECT round(sum(v), 2) AS total, round(avg(v), 2) AS mean, round(var_pop(v), 2) AS var, round(min(v), 2) AS least, round(max(v), 2) AS greatest FROM (SELECT l_extendedprice * l_discount AS v FROM lineitem WHERE l_discount > 0.05)"
