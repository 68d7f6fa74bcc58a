"""Regressors that the prior regressions may use: anything with train(rows) and predict(rows)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Regressor(Protocol):
    def train(self, rows: DataFrame, features: str, y: str, weight: str | None = None) -> Any: ...

    def predict(self, model: Any, rows: DataFrame, features: str, out: str) -> DataFrame: ...


def _prepared(rows: DataFrame, features: str, y: str | None = None, weight: str | None = None) -> DataFrame:
    out = rows.withColumn("__x", array_to_vector(features))
    if weight:
        # Features, response and weight are filtered together.
        out = out.where(F.col(weight) != 0)
    return out


class _Ml:
    def _fit(self, estimator, rows: DataFrame, features: str, y: str, weight: str | None):
        estimator = estimator.setFeaturesCol("__x").setLabelCol(y)
        return (estimator.setWeightCol(weight) if weight else estimator).fit(_prepared(rows, features, y, weight))

    def predict(self, model: Any, rows: DataFrame, features: str, out: str) -> DataFrame:
        return model.transform(_prepared(rows, features)).withColumnRenamed("prediction", out).drop("__x")


@dataclass
class ElasticNet(_Ml):
    mixing: float = 0.5
    penalties: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0)
    folds: int = 3

    def train(self, rows: DataFrame, features: str, y: str, weight: str | None = None) -> Any:
        from pyspark.ml.evaluation import RegressionEvaluator
        from pyspark.ml.regression import LinearRegression
        from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

        lr = LinearRegression(elasticNetParam=self.mixing, featuresCol="__x", labelCol=y)
        lr = lr.setWeightCol(weight) if weight else lr
        grid = ParamGridBuilder().addGrid(lr.regParam, list(self.penalties)).build()
        cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=y), numFolds=self.folds, seed=0)
        return cv.fit(_prepared(rows, features, y, weight)).bestModel


@dataclass
class Forest(_Ml):
    trees: int = 100

    def train(self, rows: DataFrame, features: str, y: str, weight: str | None = None) -> Any:
        from pyspark.ml.regression import RandomForestRegressor

        return self._fit(RandomForestRegressor(numTrees=self.trees, seed=0), rows, features, y, weight)


@dataclass
class Ridge:
    """Normal equations from Gram sums."""

    penalty: float = 0.0

    def train(self, rows: DataFrame, features: str, y: str, weight: str | None = None) -> Any:
        from .factor import regression

        return regression(rows, features, y, weight=weight, ridge=self.penalty)[0]

    def predict(self, model: Any, rows: DataFrame, features: str, out: str) -> DataFrame:
        from .factor import prior_column

        return rows.withColumn(out, prior_column(F.col(features), model))


def best_ridge(rows: DataFrame, features: str, y: str, penalties: list[float], seed: int = 0, splits: int = 1, rounds: int = 0) -> tuple[float, list[tuple[float, float]]]:
    """The penalty with the least squared error on held-out quarters (by hashes of the row), averaged over several splits; each further round tries the middles between the best one so far and its neighbours."""
    from .factor import prior_column, regression

    marked = []
    for k in range(splits):
        own = rows.withColumn("__t", F.pmod(F.xxhash64(F.lit(seed + k), features, y), F.lit(4)) > 0)
        marked.append((own.where("__t"), own.where("not __t")))

    def error(p: float) -> float:
        found = []
        for train, test in marked:
            b, _ = regression(train, features, y, ridge=p)
            found.append(test.agg(F.avg((F.col(y) - prior_column(F.col(features), b)) ** 2)).first()[0])
        return float(np.mean(found))

    out = {p: error(p) for p in penalties}
    for _ in range(rounds):
        tried = sorted(out)
        at = tried.index(min(out, key=out.get))
        # On a logarithmic scale where that is possible.
        between = [(a * b) ** 0.5 if a > 0 else b / 10 for a, b in zip(tried[max(at - 1, 0) : at + 1], tried[max(at - 1, 0) + 1 : at + 2]) if a < b]
        out |= {p: error(p) for p in between if p not in out}
    return min(out, key=out.get), [(p, out[p]) for p in sorted(out)]
