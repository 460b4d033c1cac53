"""Prediction methods: Spark ML tree ensembles, and a baseline."""

from __future__ import annotations

import abc
import dataclasses
import itertools
from typing import Any

from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.learning.matrix import FeatureMatrix, fills_of, filled, spread, summarise, vectors
from featloom.plans.storage import materialise, release
from featloom.problem import Problem

# Prediction methods by name; `offer` adds one.
PREDICTION_METHODS: dict[str, "PredictionMethod"] = {}

SEED = 42

# Rows from which on equal ones are counted before trees are fitted to them.
WEIGHED_ROWS = 1 << 20


class Fitted(abc.ABC):
    """A fitted predictor."""

    @abc.abstractmethod
    def score(self, frame: DataFrame) -> DataFrame:
        """Add a ``prediction`` to rows with ``features``."""


class PredictionMethod(abc.ABC):
    """Creates predictors for a kind of problem."""

    def __str__(self) -> str:
        return type(self).__name__

    @abc.abstractmethod
    def fit(self, matrix: FeatureMatrix) -> Fitted:
        """Fit a predictor to all rows of the matrix."""


@dataclasses.dataclass(frozen=True)
class FittedTrees(Fitted):
    """A fitted tree ensemble, and the stand-ins for missing features it was fitted with."""

    model: Any
    fills: list[float]

    def score(self, frame: DataFrame) -> DataFrame:
        ready = vectors(filled(frame, self.fills))
        scored = self.model.transform(ready)
        return scored.drop("vector", "rawPrediction", "probability")

    @property
    def importances(self) -> list[float]:
        """Importance of each feature: the mean over the classes of a one-vs-rest model."""
        models = getattr(self.model, "models", [self.model])
        arrays = [m.featureImportances.toArray() for m in models]
        return [float(sum(values)) / len(arrays) for values in zip(*arrays)]


class BoostedTrees(PredictionMethod):
    """Gradient-boosted trees; with more than two classes, one ensemble per class."""

    def fit(self, matrix: FeatureMatrix) -> FittedTrees:
        options = {"featuresCol": "vector", "seed": SEED, "maxIter": 20, "maxDepth": 5}
        if matrix.problem is Problem.regression:
            return _fit_trees(GBTRegressor(**options), matrix, bagged=False)
        boosted = GBTClassifier(**options)
        if len(matrix.classes or ()) > 2:
            boosted = OneVsRest(classifier=boosted, featuresCol="vector")
        return _fit_trees(boosted, matrix, bagged=False)


class RandomForest(PredictionMethod):
    """Random forest."""

    def fit(self, matrix: FeatureMatrix) -> FittedTrees:
        options = {"featuresCol": "vector", "seed": SEED, "numTrees": 20, "maxDepth": 5}
        forest = RandomForestRegressor if matrix.problem is Problem.regression else RandomForestClassifier
        return _fit_trees(forest(**options), matrix, bagged=True)


def _fit_trees(estimator: Any, matrix: FeatureMatrix, *, bagged: bool) -> FittedTrees:
    summaries = summarise(matrix)
    fills = fills_of(summaries)
    rows = filled(matrix.frame, fills)
    counted = None
    if max((s.present for s in summaries), default=0) > WEIGHED_ROWS:
        counted = _counted(rows.select("features", "label"))
    if counted is None:
        return FittedTrees(estimator.fit(vectors(rows)), fills)
    ready = spread(_pieces(counted) if bagged else counted.withColumnRenamed("n", "weight"))
    fitted = FittedTrees(estimator.setWeightCol("weight").fit(vectors(ready)), fills)
    release(counted)
    return fitted


def _counted(rows: DataFrame) -> DataFrame | None:
    """Different rows with their number ``n``, written down, or None if few rows are equal.

    Trees see a row as often as it occurs, so a weight takes the place of equal rows, and what is
    cached and scanned per level of the trees follows the different ones.
    """
    found = rows.agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("features", "label")).alias("different"),
    ).first()
    if found["different"] * 4 > found["n"]:
        return None
    counted = rows.groupBy("features", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return materialise(counted, "counted-rows")


def _pieces(counted: DataFrame) -> DataFrame:
    """Rows for bootstrap samples, which draw rows whatever their weight: a heavy row becomes several,
    so that none weighs more than a share of ``1 / WEIGHED_ROWS`` of all."""
    total = counted.agg(F.sum("n")).first()[0]
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") * WEIGHED_ROWS / total)).cast("int")
    rows = counted.withColumn("weight", F.col("n") / pieces).withColumn("piece", F.explode(F.sequence(F.lit(1), pieces)))
    return rows.drop("piece", "n")


@dataclasses.dataclass(frozen=True)
class FittedConstant(Fitted):
    """Always predicts the same value."""

    value: float

    def score(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("prediction", F.lit(self.value))


class Baseline(PredictionMethod):
    """The most frequent class (the smallest, if several are), or the mean of the target."""

    def fit(self, matrix: FeatureMatrix) -> FittedConstant:
        return FittedConstant(float(baseline(matrix.frame, "label", matrix.problem).first()[0]))


def offer(method: PredictionMethod) -> None:
    """Make a method available under its name."""
    PREDICTION_METHODS[str(method)] = method


for _method in (BoostedTrees(), RandomForest(), Baseline()):
    offer(_method)


def baseline(frame: DataFrame, target: str, problem: Problem) -> DataFrame:
    """The baseline prediction for a target, as one row."""
    if problem is Problem.regression:
        return frame.agg(F.avg(target).alias("prediction"))
    counted = frame.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("prediction")).count()
    return counted.orderBy(F.desc("count"), "prediction").limit(1).select("prediction")


def method_names() -> list[str]:
    """Names of all registered methods, in order of registration."""
    return list(itertools.chain(PREDICTION_METHODS))
