"""Training, evaluating, explaining and applying a prediction model."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.functions import literal, quote
from featloom.learning.matrix import FeatureMatrix, array_of, class_values, feature_matrix, present
from featloom.learning.predictors import Baseline, FittedTrees, PredictionMethod
from featloom.learning.selectors import Correlation, FeatureImportance, Selector, ShapelyImpact
from featloom.learning.trees import explain
from featloom.operators import Aggregate, Combine, Extract, Filter, Identity, Keep, Transform, drop_related
from featloom.plans.ordering import ordered_split
from featloom.plans.storage import materialise
from featloom.problem import Problem
from featloom.reports import chart_data, comparison, importance_grid, prediction_impact
from featloom.schema import Attribute, Column, Dataset, Table

# Share of the rows, in order of the known columns, that train a model; the others test it.
TRAIN_SHARE = 0.8

_LABEL, _TRAIN = "target of training", "is training row"


@dataclasses.dataclass(frozen=True)
class Round:
    """One round of training: how to generate candidates, and how to select among them.

    :param generate: Transform of the source tables into new candidate tables.
    :param combine: Transform of the features selected so far into new candidate tables.
    """

    selectors: list[Selector]
    generate: Transform | None = None
    combine: Transform | None = None


def default_rounds(known: Sequence[Column], predictor: PredictionMethod) -> list[Round]:
    """Aggregates, then aggregates of filtered rows, then combinations of what was selected.

    Fixed values: how many features each round keeps, and its limits of correlation.
    """
    aggregate = Aggregate(is_pivotable=known, max_pivots=1)
    return [
        Round(
            generate=Identity().then(Identity(), aggregate),
            selectors=[
                FeatureImportance(predictor=predictor, n=200),
                Correlation(max=0.8),
                ShapelyImpact(predictor=predictor, n=100),
            ],
        ),
        Round(
            generate=Filter().then(aggregate),
            selectors=[
                FeatureImportance(predictor=predictor, n=150),
                Correlation(max=0.7),
                ShapelyImpact(predictor=predictor, n=100),
            ],
        ),
        Round(
            combine=Combine(),
            selectors=[
                FeatureImportance(predictor=predictor, n=100),
                ShapelyImpact(predictor=predictor, n=35),
            ],
        ),
    ]


@dataclasses.dataclass(frozen=True, kw_only=True)
class Prediction:
    """Predicted rows: the known columns, the features, and the target."""

    model: "Model"
    known: DataFrame
    frame: DataFrame

    @property
    def y(self) -> DataFrame:
        """Known columns and predicted target only."""
        return self.frame.drop(*self.model.names)

    @functools.cached_property
    def explanation(self) -> DataFrame:
        """Impact of each feature on each prediction, in long form."""
        return self.model.explain(self.frame)

    @property
    def impact(self) -> DataFrame:
        """Mean signed impact of each feature, strongest first."""
        return prediction_impact(self.explanation)


@dataclasses.dataclass(frozen=True, kw_only=True)
class Model:
    """A prediction model over selected features of a dataset.

    :param dataset: The tables that the selected features are extracted from.
    :param known: Names and types of the known columns.
    :param names: Selected features, in the order in which the predictor sees them.
    :param numeric: The selected features that are numbers; the others are booleans.
    :param classes: Sorted classes of a classification target.
    :param test: Test rows with label, features, prediction and baseline prediction.
    """

    dataset: Dataset
    known: T.StructType
    target: Column
    problem: Problem
    fitted: FittedTrees
    names: list[str]
    numeric: set[str]
    classes: list[Any] | None
    test: DataFrame

    @staticmethod
    def train(
        dataset: Dataset,
        *,
        known_columns: Sequence[Column],
        prediction_method: PredictionMethod,
        problem: Problem,
        target_column: Column,
        training_data: Table,
        order_by: Sequence[str] | None = None,
        rounds: Sequence[Round] | None = None,
    ) -> "Model":
        """Train a model that predicts a target from what is known, and from the dataset.

        :param dataset: Tables to generate features from.
        :param known_columns: Columns that are known when predicting.
        :param training_data: Table with the known columns and the target.
        :param order_by: Order that decides which rows test the model: the last ones.  By
            default the order of the known columns.
        :param rounds: Rounds of generation and selection, instead of the default three.
        """
        names = [c.name for c in known_columns]
        labelled, classes = _labelled(training_data, names, target_column, problem, order_by or names)
        # columns that go back to the target would give it away
        sources = drop_related(dataset, target_column, table=training_data)

        selected = Dataset([])
        trained: _Trained | None = None
        for plan in rounds or default_rounds(known_columns, prediction_method):
            candidates = list(selected)
            if plan.generate is not None:
                candidates += sources.apply(plan.generate).tables
            if plan.combine is not None:
                candidates += selected.apply(plan.combine).tables
            trained = _train_round(Dataset(candidates), labelled, names, problem, classes, plan.selectors)
            selected = trained.dataset
        if trained is None:
            raise ValueError("training needs at least one round")

        fitted = prediction_method.fit(trained.matrix.where("is_train"))
        constant = Baseline().fit(trained.matrix.where("is_train"))
        held_out = trained.matrix.frame.where("NOT is_train")
        scored = constant.score(
            fitted.score(held_out).withColumnRenamed("prediction", "predicted"),
        ).withColumnRenamed("prediction", "baseline")
        return Model(
            dataset=selected,
            known=T.StructType([f for f in labelled.schema if f.name in names]),
            target=target_column,
            problem=problem,
            fitted=fitted,
            names=trained.matrix.names,
            numeric=trained.numeric,
            classes=classes,
            test=materialise(scored, "test"),
        )

    def features(self, known: DataFrame) -> DataFrame:
        """Known rows with their selected features.  Lazy."""
        if set(known.columns) != set(self.known.names):
            raise ValueError(f"known columns must be {self.known.names}")
        wide = self.dataset.features(known, keep_known=True)
        return wide.select(*(F.col(quote(n)) for n in [*self.known.names, *self.names]))

    def score(self, features: DataFrame) -> DataFrame:
        """Add the predicted target to given feature rows, without extracting anything."""
        ready = features.withColumn("features", F.expr(array_of([quote(n) for n in self.names])))
        scored = self.fitted.score(ready).drop("features")
        return scored.withColumn("prediction", self._value("prediction")).withColumnRenamed(
            "prediction", self.target.name,
        )

    def predict(self, known: DataFrame) -> Prediction:
        """Predict the target of known rows.  Lazy."""
        return Prediction(model=self, known=known, frame=self.score(self.features(known)))

    def explain(self, features: DataFrame) -> DataFrame:
        """Impact of each feature on given feature rows, with the known columns they have."""
        keys = [n for n in self.known.names if n in features.columns]
        ready = features.withColumn("features", F.expr(array_of([quote(n) for n in self.names])))
        return explain(ready, self.fitted, self.names, keys=[quote(k) for k in keys], classes=self._labels)

    @functools.cached_property
    def explanation(self) -> DataFrame:
        """Impact of each feature on each test row."""
        return explain(self.test, self.fitted, self.names, classes=self._labels)

    @property
    def importance(self) -> DataFrame:
        """Features by mean absolute impact, relative to the largest."""
        return importance_grid(self.explanation)

    @property
    def evaluation(self) -> DataFrame:
        """Metrics on the test rows, next to those of the baseline."""
        return comparison(self.test, self.problem, actual="label", model="predicted", baseline="baseline")

    def charts(self, feature: str) -> dict[str, DataFrame]:
        """Data of the charts that relate one feature to the target, over the test rows."""
        position = self.names.index(feature)
        numeric = feature in self.numeric
        rows = self.test.select(
            F.get(F.col("features"), position).alias(feature),
            self._value("label").alias(self.target.name),
        )
        if not numeric:
            flag = f"CASE WHEN {present(quote(feature))} THEN CAST({quote(feature)} AS BOOLEAN) END"
            rows = rows.withColumn(feature, F.expr(flag))
        return chart_data(rows, feature, self.target.name, self.problem, numeric=numeric)

    @property
    def _labels(self) -> list[Any] | None:
        return self.classes

    def _value(self, column: str):
        """The target value that a label stands for."""
        if self.classes is None:
            return F.col(column)
        cases = " ".join(f"WHEN {i}D THEN {literal(v)}" for i, v in enumerate(self.classes))
        return F.expr(f"CASE {quote(column)} {cases} END")


@dataclasses.dataclass(frozen=True)
class _Trained:
    dataset: Dataset
    matrix: FeatureMatrix
    numeric: set[str]


def _labelled(
    training_data: Table,
    names: list[str],
    target: Column,
    problem: Problem,
    order_by: Sequence[str],
) -> tuple[DataFrame, list[Any] | None]:
    """Known columns and target in one frame, with the split decided once and for all."""
    columns = dict.fromkeys([*names, *order_by])
    rows = training_data.data.select(
        *(F.col(quote(n)) for n in columns),
        F.col(quote(target.name)).alias(_LABEL),
    ).where(F.col(quote(_LABEL)).isNotNull())
    order = [F.col(quote(n)) for n in order_by]
    split = materialise(ordered_split(rows, order, TRAIN_SHARE, _TRAIN), "labelled")
    classes = class_values(split, _LABEL) if problem is Problem.classification else None
    return split.select(*(F.col(quote(n)) for n in [*names, _LABEL, _TRAIN])), classes


def _train_round(
    candidates: Dataset,
    labelled: DataFrame,
    known: list[str],
    problem: Problem,
    classes: list[Any] | None,
    selectors: list[Selector],
) -> _Trained:
    """Extract all candidates for the labelled rows once, and narrow them down."""
    extracted = candidates.apply(Extract(known=labelled))
    columns = [c for t in extracted for c in t.columns]
    if not columns:
        raise ValueError("no features: no table has a primary key that the known columns cover")
    wide = extracted.tables[0].frame.withColumnRenamed(_TRAIN, "is_train")
    matrix = feature_matrix(
        wide,
        {c.name: t.expr(c) for t in extracted for c in t.columns},
        _LABEL,
        problem,
        extra=["is_train"],
        classes=classes,
        pairs={name: pair for t in extracted for name, pair in t.pairs.items()},
    )
    # every selector and fit reads these rows again; the joins behind them run once, and leave them
    # to so few tasks by their bytes that fitting would not use all cores
    cores = matrix.frame.sparkSession.sparkContext.defaultParallelism
    matrix = dataclasses.replace(matrix, frame=materialise(matrix.frame.repartition(cores), "matrix"))

    for selector in selectors:
        chosen = selector.chosen(matrix.where("is_train"))
        if not chosen:
            raise ValueError(f"{type(selector).__name__} keeps none of {matrix.width} features")
        if len(chosen) < matrix.width:
            matrix = matrix.take(chosen)

    survivors = {c.name: c for c in columns if c.name in set(matrix.names)}
    ancestors = [pair for c in survivors.values() for pair in c.derived_from]
    dataset = candidates.apply(Keep(columns=ancestors))
    numeric = {n for n, c in survivors.items() if c.has(Attribute.numeric)}
    return _Trained(dataset, matrix, numeric)
