"""Metrics, cohort statistics and chart data, all as DataFrames."""

from featloom.reports.charts import (
    best_fit,
    box_plot,
    chart_data,
    contingency,
    contingency_shares,
    equal_count_buckets,
    hierarchy,
)
from featloom.reports.cohorts import cohort_classes, cohort_predicate, cohort_values, without_missing
from featloom.reports.metrics import (
    classification_metrics,
    comparison,
    headline_metric,
    importance_grid,
    prediction_impact,
    regression_metrics,
)

__all__ = [
    "best_fit",
    "box_plot",
    "chart_data",
    "classification_metrics",
    "cohort_classes",
    "cohort_predicate",
    "cohort_values",
    "comparison",
    "contingency",
    "contingency_shares",
    "equal_count_buckets",
    "headline_metric",
    "hierarchy",
    "importance_grid",
    "prediction_impact",
    "regression_metrics",
    "without_missing",
]
