"""Queries of the catalogue against their SQL in DuckDB, one of each kind; all have unique names and SQL of a query."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from quoin.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier orders lineitem events embeddings".split()
KINDS = ["ufunc_unary_log", "ufunc_unary_rint", "ufunc_binary_floor_divide", "ufunc_binary_mod", "reduce_median_axis0", "nan_nanstd", "histogram", "argsort", "lexsort", "cumsum", "searchsorted", "interp", "setxor1d", "mask", "assign_index", "place", "put_along_axis", "reshape", "pad", "tril_indices", "einsum_mttkrp", "matmul_tiled", "ridge", "histogram2d", "histogramdd", "unwrap", "kaiser", "ufunc_unary_i0", "ufunc_unary_spacing", "ufunc_binary_nextafter", "random_zipf", "random_standard_cauchy", "random_noncentral_f", "train_test_split", "stream_windows", "resize", "glm_linear_newton", "glm_ridge_newton", "glm_lasso_lbfgs", "glm_elasticnet_lbfgs", "glm_logistic_irls", "glm_logistic_gd", "glm_logistic_lbfgs", "glm_poisson_newton", "glm_linear_one_feature", "write_read", "loadtxt", "masked_revenue"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    return sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", KINDS)
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(QUERIES) > 400


@pytest.mark.parametrize("name", ["cov", "corrcoef", "qr_gram", "direct_tsqr_product", "svd_norm"])
def test_all_components(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    keys = [c for c in want.columns if c != "v"]
    got, want = (x.sort_values(keys)[keys + ["v"]] if keys else x for x in (got, want))
    assert (got[keys].to_numpy() == want[keys].to_numpy()).all() and np.allclose(got["v"], want["v"], atol=2e-6)


def test_all_components_numpy(spark, db):
    a = np.stack(db.execute("SELECT embedding FROM embeddings ORDER BY vec_id").df()["embedding"]).astype(float)
    r = np.linalg.qr(a, mode="r")
    want = {"qr_r": r * np.sign(np.diag(r))[:, None], "svd_s": np.linalg.svd(a, compute_uv=False)}
    for name, w in want.items():
        got = QUERIES[name](spark, SF).toPandas()
        keys = [c for c in got.columns if c != "v"]
        dense = np.zeros(w.shape)
        dense[tuple(got[k].to_numpy() for k in keys)] = got["v"]
        assert np.allclose(dense, w, atol=1e-5), name
    got = QUERIES["pca"](spark, SF).toPandas().sort_values(["i0", "i1"])["v"].to_numpy()
    vectors = np.linalg.eigh(np.cov(a, rowvar=False))[1][:, ::-1]
    assert got.shape == (a.size,) and np.allclose(got, np.abs(a @ vectors).ravel(), atol=1e-5)


@pytest.mark.parametrize("name", ["prod", "nanprod", "cumprod", "cumproduct", "nancumprod", "trim_zeros", "outer"])
def test_whole_columns(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
