import numpy as np
import pytest
from pyspark.sql import functions as F

import quoin.api as qn
from quoin.models.glm import ElasticNet, Lasso, LinearRegression, LogisticRegression, PoissonRegression, Ridge
from quoin.models.preprocess import Estimator, RobustScaler, StandardScaler, call, register


def rows(spark, x, y):
    return spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "x array<double>, y double")


def test_poisson_is_exact(spark):
    x = np.arange(5)[:, None]
    m = PoissonRegression(tol=1e-8).fit(rows(spark, x, np.exp(0.2 * x[:, 0] - 0.1)))
    np.testing.assert_allclose(m.beta, [0.2, -0.1], rtol=1e-4)


def test_linear(spark):
    r = np.random.default_rng(0)
    x, beta = r.normal(size=(200, 3)), np.array([1.0, -2.0, 0.5])
    data = rows(spark, x, x @ beta + 3)
    np.testing.assert_allclose(LinearRegression().fit(data).beta, [*beta, 3], atol=1e-8)
    z = np.hstack([x, np.ones((200, 1))])
    want = np.linalg.solve(z.T @ z + 5 * np.diag([1, 1, 1, 0]), z.T @ (x @ beta + 3))
    np.testing.assert_allclose(Ridge(alpha=10.0).fit(data).beta, want, atol=1e-8)
    for m in (Lasso(alpha=0.1, solver="lbfgs"), ElasticNet(alpha=0.1, solver="lbfgs")):
        assert m.fit(data).deviance_sqr(data) > 0.99


@pytest.mark.parametrize("model", [Lasso(alpha=0.5, solver="lbfgs", tol=1e-7), ElasticNet(alpha=0.5, solver="lbfgs", tol=1e-7), LogisticRegression(solver="lbfgs", tol=1e-9)])
def test_lbfgs_takes_few_passes(spark, model, monkeypatch):
    """One where the loss is a quadratic, also when the gradient stays above tol by its rounding; else some a step."""
    from quoin.models import glm

    calls, sums = [], glm._sum_of
    monkeypatch.setattr(glm, "_sum_of", lambda *a, **k: calls.append(1) or sums(*a, **k))
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 2))
    y = x @ [2.0, -1.0] + 3 + r.normal(size=4000)
    y = (y > 3).astype(float) if isinstance(model, LogisticRegression) else y * 1e3
    m = model.fit(rows(spark, x, y))
    z = np.hstack([x, np.ones((4000, 1))])
    l1, l2 = m.rates()
    slope = z.T @ (m.mean(z @ m.beta) - y) + np.append(l1 * np.sign(m.beta[:2]) + l2 * m.beta[:2], 0)
    assert np.abs(slope).max() < 1e-4 and len(calls) <= (1 if model.quadratic else 40)


@pytest.mark.parametrize("columns", [2, 14])
def test_lasso_sums_its_rows_in_the_jvm(spark, columns, monkeypatch):
    """Up to a dozen columns no row goes to Python; more of them, and null cells, come to the same as before."""
    from quoin.models import glm

    calls, sums = [], glm._sum_of
    monkeypatch.setattr(glm, "_sum_of", lambda *a, **k: calls.append(1) or sums(*a, **k))
    r = np.random.default_rng(3)
    x = r.normal(size=(500, columns))
    data = rows(spark, x, x @ np.arange(1.0, columns + 1) + 3)
    m = Lasso(alpha=0.5, solver="lbfgs", tol=1e-7).fit(data)
    assert len(calls) == (columns > 12)
    for a, b in zip(m._squares(data, columns + 1), m._sums(data, np.zeros(columns + 1))):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
    holed = data.union(spark.createDataFrame([([1.0] * columns, None)], data.schema))
    assert np.isnan(m._squares(holed, columns + 1)[0]) and np.isnan(m._sums(holed, np.zeros(columns + 1))[0])


@pytest.mark.parametrize("solver", ["newton", "irls", "lbfgs", "gd", "block_sgd", "sgd"])
def test_logistic(spark, solver):
    r = np.random.default_rng(1)
    x = np.vstack([r.normal(0, 1, (150, 2)), r.normal(2.5, 1, (50, 2))])
    y = np.repeat([0, 1], [150, 50])
    m = LogisticRegression(solver=solver, max_iter=25 if "g" in solver else 50, lr=0.01, tol=1e-6).fit(rows(spark, x, y))
    got = m.predict(rows(spark, x, y))
    assert got.where("prediction = y").count() > 170
    p = m.predict_proba(rows(spark, x, y)).select(F.col("probability")[0] + F.col("probability")[1]).first()[0]
    assert abs(p - 1) < 1e-9


def test_scalers_functions_and_estimators(spark):
    x = np.array([[1.0, 5.0], [2.0, 5.0], [4.0, 5.0]])
    got = np.array([r["x"] for r in StandardScaler().fit_transform(rows(spark, x, [0, 0, 1])).collect()])
    np.testing.assert_allclose(sorted(got[:, 0]), sorted((x[:, 0] - x[:, 0].mean()) / x[:, 0].std()))
    assert RobustScaler().fit(rows(spark, x, [0, 0, 1])).middle == [2.0, 5.0]
    register("twice", lambda v: v * 2.0)
    assert spark.range(3).select(call("twice", F.col("id")).alias("v")).agg(F.sum("v")).first()[0] == 6
    tree = Estimator("DecisionTreeClassifier", maxDepth=2).fit(rows(spark, x, [0, 0, 1]))
    assert [r["prediction"] for r in tree.predict(rows(spark, x, [0, 0, 1])).collect()] == [0, 0, 1]
    with pytest.raises(ImportError):
        Estimator("KNeighborsClassifier").fit(rows(spark, x, [0, 0, 1]))


def test_round_trip(spark, tmp_path):
    a = np.random.default_rng(3).random((7, 5))
    qn.write(str(tmp_path / "Kept"), qn.array(a))
    np.testing.assert_array_equal(qn.read(str(tmp_path / "Kept")).get(), a)
    assert qn.delete_stored(str(tmp_path / "Kept")) and not qn.delete_stored(str(tmp_path / "Kept"))


def test_text(spark, tmp_path):
    a = np.random.default_rng(3).random((33, 3))
    np.savetxt(tmp_path / "t.txt", a, delimiter=",", header="a comment")
    np.testing.assert_allclose(qn.loadtxt(str(tmp_path / "t.txt"), ",").get(), a)
    np.testing.assert_allclose(qn.loadtxt(str(tmp_path / "t.txt"), ",", skiprows=3, usecols=[2, 0], max_rows=4).get(), a[2:6][:, [2, 0]])
    (tmp_path / "c.csv").write_text("h1,h2,h3\n123,4,5\n1.2,3.4,5.6\n")
    np.testing.assert_allclose(qn.read_csv(str(tmp_path / "c.csv"), has_header=True).get(), [[123, 4, 5], [1.2, 3.4, 5.6]])
    a.tofile(tmp_path / "b.bin")
    np.testing.assert_array_equal(qn.fromfile(str(tmp_path / "b.bin")).get(), a.ravel())


def test_files_are_in_order(spark, tmp_path):
    """By name, not by size."""
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.csv").write_text("0,0\n1,1\n2,2\n")
    (tmp_path / "f" / "b.csv").write_text("".join(f"{i},{i}\n" for i in range(3, 3000)))
    (tmp_path / "f" / "c.csv").write_text("3000,3000\n")
    got = qn.read_csv(str(tmp_path / "f"), dtype=int)
    assert got.dtype == "bigint" and (got.get()[:, 0] == np.arange(3001)).all()
    text = qn.loadtxt(str(tmp_path / "f"), ",", unpack=True, converters={1: lambda c: c.cast("double") * 2})
    assert text.shape == (2, 3001) and (text.get() == np.arange(3001) * [[1], [2]]).all()
    assert qn.loadtxt(str(tmp_path / "f" / "c.csv"), ",").shape == (2,) and qn.loadtxt(str(tmp_path / "f" / "c.csv"), ",", ndmin=2).shape == (1, 2)


def test_frames(spark):
    import pandas as pd

    pdf = pd.DataFrame({"a": [1, 2], "b": [3.5, 4.5]})
    np.testing.assert_array_equal(qn.from_pandas(pdf).get(), pdf.to_numpy())
    with pytest.raises(TypeError):
        qn.from_pandas(pdf.assign(c=["x", "y"]))
    with pytest.raises(ImportError):
        qn.zarr_array("nowhere", "x")
    x, y = qn.bimodal_gaussian(200, 2)
    assert x.shape == (200, 2) and qn.sum(y).get() == 180
