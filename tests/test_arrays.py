"""Arrays against NumPy on the same data, over several partition counts."""

import numpy as np
import pytest

import quoin.api as qn
from quoin.functions import ufuncs as U
from quoin.operators import scan

GRID = np.array([0.0, -0.0, 1.0, -1.0, 0.5, -0.5, 1.5, 2.5, -2.5, 3.7, -3.7, 1e-9, np.inf, -np.inf, np.nan])
INTS = np.array([-7, -3, -1, 1, 2, 5, 12])
M = np.array([[5, -2, 4, 8], [3, 6, 1, 7]])
N = np.array([[-1, 4, np.nan, 5], [3, 2, np.nan, 6.0]])


def same(got, want, **kw):
    got = got.get() if hasattr(got, "get") else got
    np.testing.assert_allclose(np.asarray(got, float), np.asarray(want, float), rtol=1e-9, atol=1e-12, **kw)


@pytest.mark.parametrize("name", sorted(U.UNARY))
def test_unary(spark, name):
    integer = name in ("bitwise_not", "invert")
    a = INTS if integer else np.array([1.0, 1.5, np.e, 30.0]) if name == "arccosh" else GRID
    f = getattr(np, name, None) or getattr(np, {"bitwise_not": "invert"}[name])
    with np.errstate(all="ignore"):
        want = f(a)
    same(getattr(qn, name)(qn.array(a)), want)


@pytest.mark.parametrize("name", sorted(set(U.BINARY) - {"xlogy", "ldexp", "arctan2"}))
def test_binary(spark, name):
    if name.endswith("_shift"):
        a, b = np.array([7000, 8000, 9000]), np.array([1, 2, 3])
    elif name in ("gcd", "lcm") or name.startswith("bitwise"):
        a, b = (x.ravel() for x in np.meshgrid(INTS, INTS))
    else:
        a, b = (x.ravel() for x in np.meshgrid(GRID, GRID))
        if name in ("power", "float_power"):
            keep = ~(np.isinf(a) & (a < 0))
            a, b = a[keep], b[keep]
    with np.errstate(all="ignore"):
        want = getattr(np, name)(a, b)
    same(getattr(qn, name)(qn.array(a), qn.array(b)), want)


@pytest.mark.parametrize("parts", [1, 3, 8])
@pytest.mark.parametrize("axis", [None, 0, 1, -1])
@pytest.mark.parametrize("name", ["sum", "max", "min", "mean", "var", "std", "prod", "all", "any", "argmax", "argmin", "ptp", "median"])
def test_reductions(spark, name, axis, parts):
    a = qn.array(M).repartition(parts)
    same(getattr(qn, name)(a, axis=axis), getattr(np, name)(M, axis=axis))


@pytest.mark.parametrize("axis", [None, 0, 1])
@pytest.mark.parametrize("name", ["nansum", "nanmax", "nanmin", "nanmean", "nanvar", "nanstd", "nanprod", "nanmedian", "sum", "max", "min", "mean", "median"])
def test_nan(spark, name, axis):
    with np.errstate(all="ignore"):
        want = getattr(np, name)(N, axis=axis)
    same(getattr(qn, name)(qn.array(N), axis=axis), want)


def test_keepdims_and_tuples(spark):
    same(qn.sum(qn.array(M), axis=1, keepdims=True), M.sum(1, keepdims=True))
    same(qn.sum(qn.array(M), axis=(0, 1)), M.sum())
    same(qn.average(qn.array(M), axis=1, weights=qn.array(M)), np.average(M, axis=1, weights=M))
    same(qn.cov(qn.array(M)), np.cov(M))
    same(qn.corrcoef(qn.array(M)), np.corrcoef(M))
    with pytest.raises(ZeroDivisionError):
        qn.average(qn.array([1.0, 2.0]), weights=qn.array([0.0, 0.0]))


def test_indexing(spark):
    a = np.arange(24).reshape(2, 3, 4)
    q = qn.array(a)
    for key in (1, (slice(None), 2), (0, slice(1, None), 3), (Ellipsis, 1), (slice(None), slice(None, None, -1)), (slice(None), slice(None), slice(3, 0, -2)), (None, 1), (slice(None), [2, 0, 2])):
        same(q[key], a[key])
    same(q[qn.array(a % 5 == 0)], a[a % 5 == 0])
    b = a.copy()
    b[1, 1:] = -1
    same(q.assign((1, slice(1, None)), -1), b)
    with pytest.raises(IndexError):
        q[5]


def test_where(spark):
    same(qn.where(qn.array(M) > 3), np.argwhere(M > 3))
    same(qn.where(qn.array(M) > 3, qn.array(M), 0), np.where(M > 3, M, 0))
    for got, want in zip(qn.nonzero(qn.array(M > 3)), np.nonzero(M > 3)):
        same(got, want)


def test_broadcasting(spark):
    row, col = np.array([1.0, 2.0, 3.0, 4.0]), np.array([[10.0], [20.0]])
    same(qn.array(M) + qn.array(row), M + row)
    same(qn.array(M) * qn.array(col), M * col)
    same(qn.array(col) - qn.array(row), col - row)
    same(2 ** qn.array(row), 2**row)
    same(7 // qn.array(row), 7 // row)


@pytest.mark.parametrize("size", [8, 437])
def test_order(spark, size, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK", 50)
    a = np.random.default_rng(size).integers(0, 40, size)
    q = qn.array(a)
    same(qn.sort(q), np.sort(a))
    same(qn.argsort(q), np.argsort(a, kind="stable"))
    same(qn.cumsum(q), np.cumsum(a))
    same(qn.diff(q, 2), np.diff(a, 2))
    same(qn.unique(q, return_counts=True)[1], np.unique(a, return_counts=True)[1])
    same(qn.unique(q, return_inverse=True)[1], np.unique(a, return_inverse=True)[1])
    same(qn.unique(q, return_index=True)[1], np.unique(a, return_index=True)[1])
    values, _ = qn.top_k(q, 5)
    same(values, np.sort(a)[::-1][:5])
    same(qn.searchsorted(qn.sort(q), qn.array([3, 17, 99]), "right"), np.searchsorted(np.sort(a), [3, 17, 99], "right"))
    same(qn.gradient(q * 1.0), np.gradient(a * 1.0))
    same(qn.cumsum(qn.array(M), axis=1), np.cumsum(M, axis=1))
    same(qn.interp(qn.array([0.5, 2.5, 9.0]), qn.array([0.0, 1.0, 5.0]), qn.array([2.0, 4.0, 0.0])), np.interp([0.5, 2.5, 9.0], [0, 1, 5], [2, 4, 0]))
    phases = np.array([0.0, 3.0, 6.5, 9.9, 0.1, -3.2, 3.1])
    same(qn.unwrap(qn.array(phases)), np.unwrap(phases))
    for mode in ("full", "same", "valid"):
        same(qn.convolve(q * 1.0, [1.0, 2.0, 3.0], mode), np.convolve(a * 1.0, [1, 2, 3], mode))


def test_sort_puts_nan_last(spark):
    a = np.array([3.0, np.nan, -np.inf, 1.0, np.nan, 2.0])
    same(qn.sort(qn.array(a)), np.sort(a))
    assert qn.argmax(qn.array(a)).get() == np.argmax(a)


def test_shapes(spark):
    a, q = M, qn.array(M)
    for got, want in ((qn.reshape(q, (4, -1)), a.reshape(4, -1)), (q.T, a.T), (qn.rot90(q), np.rot90(a)), (qn.roll(q, 3), np.roll(a, 3)), (qn.tile(q, (2, 2)), np.tile(a, (2, 2))), (qn.repeat(q, 2, 1), np.repeat(a, 2, 1)), (qn.pad(q, 1), np.pad(a, 1)),
                      (qn.flip(q), np.flip(a)), (qn.concatenate([q, q], 1), np.concatenate([a, a], 1)), (qn.dstack([q, q]), np.dstack([a, a])), (qn.column_stack([q, q]), np.column_stack([a, a])), (qn.atleast_3d(q), np.atleast_3d(a)), (qn.moveaxis(q, 0, 1), np.moveaxis(a, 0, 1)), (qn.resize(q, (3, 5)), np.resize(a, (3, 5)))):
        assert got.shape == want.shape
        same(got, want)
    for got, want in zip(qn.array_split(q, 3, 1), np.array_split(a, 3, 1)):
        same(got, want)
    with pytest.raises(ValueError):
        qn.split(q, 3, 1)


def test_contraction(spark):
    r = np.random.default_rng(0)
    x, b, c = r.random((4, 5, 6)), r.random((5, 3)), r.random((6, 3))
    same(qn.einsum("ijk,jf,kf->if", qn.array(x), qn.array(b), qn.array(c)), np.einsum("ijk,jf,kf->if", x, b, c))
    same(qn.einsum("ii", qn.array(x[:, :4, 0])), np.einsum("ii", x[:, :4, 0]))
    same(qn.tensordot(qn.array(x), qn.array(r.random((5, 6, 2))), 2).get().shape, (4, 2))
    same(qn.array(b).T @ qn.array(b), b.T @ b)
    same(qn.matmul(qn.array(b).T, qn.array(b), tiled=True), b.T @ b)
    same(qn.cross(qn.array(b), qn.array(c[:5])), np.cross(b, c[:5]))
    same(qn.kron(qn.array([1, 2]), qn.array([3, 4, 5])), np.kron([1, 2], [3, 4, 5]))


def test_linear_algebra(spark):
    x = np.random.default_rng(1).random((60, 5))
    q = qn.array(x).repartition(3)
    for f in (qn.qr, qn.direct_qr):
        left, r = f(q)
        same(left @ r, x)
        np.testing.assert_allclose((left.T @ left).get(), np.eye(5), atol=1e-9)
    u, s, vt = qn.svd(q)
    same(s, np.linalg.svd(x, compute_uv=False))
    np.testing.assert_allclose((u.get() * s.get()) @ vt.get(), x, atol=1e-9)
    tri = np.triu(np.arange(1.0, 26).reshape(5, 5))
    np.testing.assert_allclose(qn.inv_uppertri(qn.array(tri)).get() @ tri, np.eye(5), atol=1e-9)


def test_random_is_the_same_for_a_seed(spark):
    one, two = (qn.RandomState(5).normal(3, 2, shape=(500,)).get() for _ in range(2))
    assert (one == two).all() and abs(one.mean() - 3) < 0.5
    assert sorted(qn.RandomState(1).permutation(50).get()) == list(range(50))
    train, test = qn.RandomState(1).train_test_split(qn.arange(40), test_size=0.25)
    assert (train.size, test.size) == (30, 10) and set(train.get()) | set(test.get()) == set(range(40))


def test_empty_and_scalar(spark):
    assert qn.sum(qn.array(np.zeros(0))).get() == 0
    with pytest.raises(ValueError):
        qn.max(qn.array(np.zeros(0)))
    with pytest.raises(ValueError):
        bool(qn.array([1, 2]))
    assert bool(qn.array([1]))


def test_polynomials_and_bits(spark):
    a, b = np.array([1.0, -3.0, 2.0]), np.array([1.0, -1.0])
    same(qn.polyadd(qn.array(a), qn.array(b)), np.polyadd(a, b))
    same(qn.polymul(qn.array(a), qn.array(b)), np.polymul(a, b))
    same(qn.polyval(a, qn.array(b)), np.polyval(a, b))
    same(qn.packbits(qn.array(np.arange(19) % 3)), np.packbits(np.arange(19) % 3 > 0))
    values = np.array([0.0, 1.0, 0.75, -6.0, 1e-300, 3e100])
    for got, want in zip(qn.frexp(qn.array(values)), np.frexp(values)):
        same(got, want)


def test_index_out_of_range(spark):
    a = qn.arange(10)
    assert qn.take(a, [3, -1]).get().tolist() == [3, 9]
    with pytest.raises(Exception, match="index 12 on an axis of 10"):
        qn.take(a, [3, 12]).get()
    with pytest.raises(IndexError):
        a[12]


def test_many_ranges(spark, monkeypatch):
    """Sorts, searches and quantiles over several ranges, and prefix sums over several levels of chunks, equal NumPy's."""
    from quoin.operators import reduce, scan

    monkeypatch.setattr(scan, "RANGE", 300)
    monkeypatch.setattr(scan, "CHUNK", 8)
    monkeypatch.setattr(reduce, "GATHER", 100)
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=1500), 1)
    x[:400] = 0.5
    a = qn.array(x)
    np.testing.assert_array_equal(qn.sort(a).get(), np.sort(x))
    np.testing.assert_array_equal(qn.argsort(a).get(), np.argsort(x, kind="stable"))
    np.testing.assert_array_equal(qn.lexsort([a, qn.array(x[::-1].copy())]).get(), np.lexsort([x, x[::-1]]))
    np.testing.assert_allclose(qn.cumsum(a).get(), np.cumsum(x), atol=1e-9)
    np.testing.assert_allclose(qn.cumprod(a * 0.01 + 1.0).get(), np.cumprod(x * 0.01 + 1.0))
    q = r.normal(size=50)
    np.testing.assert_array_equal(qn.searchsorted(qn.sort(a), qn.array(q)).get(), np.searchsorted(np.sort(x), q))
    for p in (0, 0.3, 0.77, 1):
        np.testing.assert_allclose(qn.quantile(a, p).get(), np.quantile(x, p))
        np.testing.assert_allclose(qn.nanquantile(qn.array(np.append(x, np.nan)), p).get(), np.quantile(x, p))
    assert np.isnan(qn.median(qn.array(np.append(x, np.nan))).get())
    np.testing.assert_array_equal(qn.flatnonzero(a > 0.7).get(), np.flatnonzero(x > 0.7))


def test_dependent_columns(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 3))
    x = np.hstack([x, x[:, :1] * 2])
    q, rr = qn.qr(qn.array(x))
    np.testing.assert_allclose((q @ rr).get(), x, atol=1e-8)
    u, s, vt = qn.svd(qn.array(x))
    np.testing.assert_allclose(s.get(), np.linalg.svd(x, compute_uv=False), atol=1e-8)
    y = r.normal(size=60)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(5)
    np.testing.assert_allclose(qn.lstsq(rows, 4), np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-8)


def test_histogram_counts_edges_as_its_sql(spark, tmp_path):
    """Values on and beside edges that floats do not hold, and infinities."""
    import duckdb

    from quoin.plans.catalogue import ORACLES, QUERIES

    for k, values in enumerate(([i / 10 for i in range(11)], [0.01 + 0.07 * i for i in range(301)], [1.0, 2.0, np.inf], [-np.inf, 1.0, 2.0], [1.0, 2.0, np.nan, None])):
        path = str(tmp_path / f"sf{k}")
        spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
        db = duckdb.connect()
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
        assert sorted(map(tuple, QUERIES["histogram"](spark, path).collect())) == sorted(db.execute(ORACLES["histogram"]).fetchall()), k


def test_large_draws_are_not_broadcast(spark):
    a = qn.RandomState(3).random_sample(1 << 21)
    assert int(str(a.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 8 << 21
    plan = scan.order_places(a)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan.split("Physical Plan")[-1].replace("BroadcastHashJoin [part", "")
    rng = [np.random.Generator(np.random.PCG64(np.random.SeedSequence([3, 0])).jumped(k)) for k in range(2)]
    want = np.concatenate([rng[0].random(1 << 16), rng[1].random(4464)])
    np.testing.assert_array_equal(qn.RandomState(3).random_sample(70_000).get(), want)
