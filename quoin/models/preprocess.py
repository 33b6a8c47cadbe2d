"""Scalers, functions and estimators by name."""

from __future__ import annotations

import importlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class StandardScaler:
    """Columns of x to mean 0 and deviation 1; constant columns to 0."""

    _middle = staticmethod(F.avg)

    @staticmethod
    def _spread(v):
        return F.stddev_pop(v)

    def fit(self, rows: DataFrame) -> StandardScaler:
        stats = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(self._middle("v").alias("m"), self._spread("v").alias("s")).orderBy("k").collect()
        self.middle, self.spread = [r["m"] for r in stats], [r["s"] or 1.0 for r in stats]
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        scale = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(self.middle, self.spread)])
        return rows.withColumn("x", F.zip_with("x", scale, lambda v, c: (v - c["m"]) / c["s"]))

    def fit_transform(self, rows: DataFrame) -> DataFrame:
        return self.fit(rows).transform(rows)


class RobustScaler(StandardScaler):
    """By the median and the distance of the quartiles."""

    _middle = staticmethod(F.median)

    @staticmethod
    def _spread(v):
        return F.percentile(v, 0.75) - F.percentile(v, 0.25)


_registry: dict = {}


def register(name: str, f, schema: str = "double") -> None:
    """A function of a pandas Series, called by name on columns."""
    _registry[name] = F.pandas_udf(f, schema, F.PandasUDFType.SCALAR)


def call(name: str, *columns):
    return _registry[name](*columns)


#: Estimators with a distributed counterpart in pyspark.ml: module and class.
DISTRIBUTED = {
    "MLPClassifier": ("classification", "MultilayerPerceptronClassifier"), "SVC": ("classification", "LinearSVC"), "DecisionTreeClassifier": ("classification", "DecisionTreeClassifier"), "DecisionTreeRegressor": ("regression", "DecisionTreeRegressor"),
    "RandomForestClassifier": ("classification", "RandomForestClassifier"), "RandomForestRegressor": ("regression", "RandomForestRegressor"), "GradientBoostingClassifier": ("classification", "GBTClassifier"), "GradientBoostingRegressor": ("regression", "GBTRegressor"),
    "GaussianNB": ("classification", "NaiveBayes"), "BernoulliNB": ("classification", "NaiveBayes"), "LogisticRegression": ("classification", "LogisticRegression"), "LinearRegression": ("regression", "LinearRegression"), "XGBClassifier": ("classification", "GBTClassifier"), "XGBRegressor": ("regression", "GBTRegressor"),
}
_KIND = {"GaussianNB": {"modelType": "gaussian"}, "BernoulliNB": {"modelType": "bernoulli"}}


class Estimator:
    """An estimator by its common name, fitted on rows (x, y): distributed where pyspark.ml has it, else by the
    scikit-learn class of that name on one task, where that package is installed."""

    def __init__(self, name: str, **settings):
        self.name, self.settings = name, settings

    def fit(self, rows: DataFrame) -> Estimator:
        if self.name in DISTRIBUTED:
            from pyspark.ml.functions import array_to_vector

            module, cls = DISTRIBUTED[self.name]
            make = getattr(importlib.import_module(f"pyspark.ml.{module}"), cls)
            data = rows.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))
            self.model = make(**(_KIND.get(self.name, {}) | self.settings)).fit(data)
        else:
            found = _sklearn_class(self.name)
            pdf = rows.select("x", "y").toPandas()
            self.model = found(**self.settings).fit(pdf["x"].tolist(), pdf["y"])
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.name in DISTRIBUTED:
            from pyspark.ml.functions import array_to_vector

            out = self.model.transform(rows.withColumn("features", array_to_vector("x")))
            return out.select(*rows.columns, "prediction")
        model = rows.sparkSession.sparkContext.broadcast(self.model)
        run = F.pandas_udf(lambda x: pd.Series(model.value.predict(x.tolist()), dtype=float), "double", F.PandasUDFType.SCALAR)
        return rows.withColumn("prediction", run("x"))


def _sklearn_class(name: str):
    for module in ("neighbors", "svm", "gaussian_process", "ensemble", "neural_network", "discriminant_analysis", "linear_model", "naive_bayes", "tree"):
        try:
            found = importlib.import_module(f"sklearn.{module}")
        except ImportError as e:
            raise ImportError(f"{name} needs scikit-learn") from e
        if hasattr(found, name):
            return getattr(found, name)
    raise ValueError(f"unknown estimator {name}")
