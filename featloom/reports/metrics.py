"""Quality of predictions, and importance of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.functions import literal, quote
from featloom.operators.extract import Extract
from featloom.problem import Problem

# Metrics in report order, and the sign of their improvement.
CLASSIFICATION = ("Accuracy", "F1", "Precision", "Recall")
REGRESSION = ("RMSE", "R2")


def classification_metrics(frame: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and macro-averaged F1, precision and recall, as one row.

    Classes are those that occur on either side; a class without predictions (or without
    actual rows) scores 0.  Rows are counted per (actual, predicted) pair before anything
    else, so only the confusion matrix is shuffled.
    """
    cells = frame.groupBy(
        F.col(quote(actual)).alias("actual"),
        F.col(quote(predicted)).alias("predicted"),
    ).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.selectExpr(
        "inline(array("
        "named_struct('class', actual, 'hits', if(actual = predicted, n, 0), 'actual', n, 'predicted', 0L),"
        "named_struct('class', predicted, 'hits', 0L, 'actual', 0L, 'predicted', n)))",
    )
    classes = sides.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("hits", "actual", "predicted")))
    return classes.selectExpr(
        "CAST(sum(hits) AS DOUBLE) / sum(actual) AS Accuracy",
        "avg(2D * hits / (actual + predicted)) AS F1",
        "avg(coalesce(CAST(hits AS DOUBLE) / nullif(predicted, 0), 0)) AS Precision",
        "avg(coalesce(CAST(hits AS DOUBLE) / nullif(actual, 0), 0)) AS Recall",
    )


def regression_metrics(frame: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Root mean squared error and coefficient of determination, as one row."""
    y, p = (f"CAST({quote(c)} AS DOUBLE)" for c in (actual, predicted))
    sums = frame.selectExpr(f"avg(pow({y} - {p}, 2)) AS error", f"var_pop({y}) AS spread")
    return sums.selectExpr(
        "sqrt(error) AS RMSE",
        "CASE WHEN spread > 0 THEN 1 - error / spread WHEN error = 0 THEN 1D ELSE 0D END AS R2",
    )


def comparison(frame: DataFrame, problem: Problem, *, actual: str, model: str, baseline: str) -> DataFrame:
    """Metrics of a model next to those of a baseline, with the improvement in percent."""
    if problem is Problem.classification:
        measure, names = classification_metrics, CLASSIFICATION
    else:
        measure, names = regression_metrics, REGRESSION

    sides = measure(frame, actual, model).select(F.lit("Model").alias("side"), *names).unionByName(
        measure(frame, actual, baseline).select(F.lit("Baseline").alias("side"), *names),
    )
    long = sides.selectExpr(
        "side",
        "inline(array("
        + ", ".join(
            f"named_struct('position', {i}, 'Metric', {literal(n)}, 'value', {quote(n)})"
            for i, n in enumerate(names)
        )
        + "))",
    )
    change = "try_divide(Model - Baseline, Baseline) * 100"
    return (
        long.groupBy("position", "Metric")
        .agg(
            F.expr("max(value) FILTER (WHERE side = 'Model')").alias("Model"),
            F.expr("max(value) FILTER (WHERE side = 'Baseline')").alias("Baseline"),
        )
        .withColumn(
            "Improvement",
            F.expr(f"CASE Metric WHEN 'RMSE' THEN -({change}) WHEN 'R2' THEN abs({change}) ELSE {change} END"),
        )
        .orderBy("position")
        .drop("position")
    )


def headline_metric(problem: Problem) -> str:
    """The metric by which models are compared first."""
    return "F1" if problem is Problem.classification else "RMSE"


def importance_grid(impacts: DataFrame, *, feature: str = "feature", value: str = "impact") -> DataFrame:
    """Mean absolute impact per feature relative to the largest, most important first."""
    means = impacts.groupBy(F.col(quote(feature)).alias("Id")).agg(F.avg(F.abs(quote(value))).alias("mean"))
    largest = means.agg(F.max("mean")).scalar()
    return (
        means.withColumn("Importance", F.try_divide(F.col("mean"), largest))
        .select("Id", _part("Id", 1).alias("Feature"), "Importance", _part("Id", 2).alias("Source"))
        .orderBy(F.desc("Importance"), "Id")
    )


def prediction_impact(impacts: DataFrame, *, feature: str = "feature", value: str = "impact") -> DataFrame:
    """Mean signed impact per feature, strongest first."""
    return (
        impacts.groupBy(F.col(quote(feature)).alias("Id"))
        .agg(F.avg(quote(value)).alias("Impact"))
        .select(_part("Id", 1).alias("Feature"), _part("Id", 2).alias("Source"), "Impact")
        .orderBy(F.abs("Impact").desc(), "Feature", "Source")
    )


def _part(column: str, index: int):
    """Feature (1) or source table (2) of a generated feature name."""
    return F.element_at(F.split(column, Extract.SEPARATOR, 2), index)
