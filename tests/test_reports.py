from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from conftest import rows
from featloom import Problem
from featloom.reports import (
    best_fit,
    box_plot,
    chart_data,
    classification_metrics,
    cohort_classes,
    cohort_predicate,
    cohort_values,
    comparison,
    contingency,
    equal_count_buckets,
    hierarchy,
    importance_grid,
    prediction_impact,
    regression_metrics,
    without_missing,
)


def test_macro_metrics_with_one_sided_classes(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("never predicted", "a"), ("a", "only predicted")]
    frame = spark.createDataFrame(pairs, "y string, p string")
    accuracy, f1, precision, recall = classification_metrics(frame, "y", "p").first()
    # a: 1 hit, 3 actual, 2 predicted; b: 1, 1, 2; the others: no hit
    assert accuracy == pytest.approx(2 / 5)
    assert precision == pytest.approx((1 / 2 + 1 / 2) / 4)
    assert recall == pytest.approx((1 / 3 + 1) / 4)
    assert f1 == pytest.approx((2 / 5 + 2 / 3) / 4)


def test_metrics_of_a_single_class(spark):
    frame = spark.createDataFrame([(1, 1), (1, 1)], "y int, p int")
    assert tuple(classification_metrics(frame, "y", "p").first()) == (1.0, 1.0, 1.0, 1.0)
    assert tuple(regression_metrics(frame, "y", "p").first()) == (0.0, 1.0)


def test_comparison_with_a_zero_baseline(spark):
    frame = spark.createDataFrame([(1.0, 1.5, 2.0), (3.0, 2.5, 2.0)], "y double, m double, b double")
    found = {r["Metric"]: r for r in comparison(frame, Problem.regression, actual="y", model="m", baseline="b").collect()}
    assert list(found) == ["RMSE", "R2"]
    assert found["RMSE"]["Improvement"] == pytest.approx(50.0)
    assert found["R2"]["Baseline"] == 0.0 and found["R2"]["Improvement"] is None


COHORT = [(1.0, "a", "x"), (2.0, "a", "y"), (3.0, "b", "x"), (None, "b", "x"), (float("nan"), "a", "x")]


def test_cohort_rules(spark):
    frame = spark.createDataFrame(COHORT, "v double, y string, kind string")
    assert frame.where(cohort_predicate({"v": (">=", 2)})).count() == 2
    assert frame.where(cohort_predicate({"v": ("<", 3.0), "kind": ["x"]})).count() == 1
    assert frame.where(cohort_predicate({})).count() == 5
    assert frame.where(cohort_predicate({"kind": []})).count() == 0
    assert without_missing(frame, "v", "y").count() == 3


def test_cohort_classes(spark):
    frame = spark.createDataFrame(COHORT, "v double, y string, kind string")
    found = {r["class"]: r for r in cohort_classes(frame, cohort_predicate({"kind": ["x"]}), "y").collect()}
    assert (found["a"]["prevalence"], found["a"]["recall"]) == pytest.approx((50.0, 200 / 3))
    assert (found["b"]["prevalence"], found["b"]["recall"]) == pytest.approx((50.0, 100.0))
    assert (found["a"]["group_size"], found["a"]["group_percentage"]) == pytest.approx((4, 80.0))
    nobody = cohort_classes(frame, cohort_predicate({"kind": []}), "y").first()
    assert (nobody["prevalence"], nobody["group_size"]) == (0.0, 0)


@pytest.mark.parametrize("row_limit", [1000, 1])
def test_cohort_values(spark, row_limit):
    frame = spark.createDataFrame([(i, float(i)) for i in range(1, 8)], "k int, y double")
    found = cohort_values(frame, "k > 4", "y", row_limit=row_limit).first()
    assert (found["selected_mean"], found["rest_mean"], found["selected_median"], found["rest_median"]) == (6, 2.5, 6, 2.5)
    assert found["mean_difference"] == pytest.approx(140.0) and found["group_size"] == 3
    everyone = cohort_values(frame, "true", "y", row_limit=row_limit).first()
    assert everyone["rest_mean"] is None and everyone["mean_difference"] is None and everyone["group_percentage"] == 100


@pytest.mark.parametrize(("n", "sizes"), [(12, [3, 3, 3, 3, 0]), (3, [1, 1, 1, 0, 0]), (11, [3, 3, 3, 2, 0]), (10, [2] * 5)])
def test_buckets_have_equal_counts(spark, n, sizes):
    frame = spark.range(n).selectExpr("CAST(id AS DOUBLE) AS x", "id % 2 AS y")
    found = equal_count_buckets(frame, "x", "y").toPandas()
    assert len(found) == 5 * min(2, n)
    assert found.groupby("bucket")["count"].sum().tolist() == sizes
    assert set(found[found.bucket == 4].label) == ({"nan - nan"} if sizes[4] == 0 else {"8.00 - 9.00"})


def test_buckets_divide_heavy_values(spark):
    frame = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS x", "CAST(id % 2 AS STRING) AS y")
    pdf = frame.toPandas().sort_values(["x", "y"]).reset_index(drop=True)
    pdf["bucket"] = pdf.index // 200
    expected = pdf.groupby(["bucket", "y"]).size().to_dict()
    found = equal_count_buckets(frame, "x", "y").collect()
    assert {(r["bucket"], r["class"]): r["count"] for r in found if r["count"]} == expected


@pytest.mark.parametrize("row_limit", [1000, 5])
def test_box_plot(spark, row_limit):
    values = [("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 5.0), ("b", None)]
    found = {r["x"]: r for r in box_plot(spark.createDataFrame(values, "x string, y double"), "x", "y", row_limit=row_limit).collect()}
    ys = [1, 2, 3, 4, 100, 5]
    q1, q3 = np.quantile(ys, [0.25, 0.75])
    assert (found["a"]["q1"], found["a"]["median"], found["a"]["q3"]) == (2.0, 3.0, 4.0)
    assert found["a"]["axis_high"] == pytest.approx(q3 + 1.5 * (q3 - q1)) and found["a"]["axis_low"] == 1.0
    assert (found["b"]["count"], found["b"]["maximum"]) == (1, 5.0)


def test_contingency_and_hierarchy(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), (None, 1)], "x string, y int")
    assert rows(contingency(frame, "x", "y")) == [("a", pytest.approx(100 / 3), pytest.approx(200 / 3)), ("b", 100.0, 0.0)]
    found = {(r["path"], r["parent"], r["label"]): (r["count"], r["percent_of_parent"]) for r in hierarchy(frame, "x", "y").collect()}
    assert found[("y / x", None, "1")] == (2, 50.0)
    assert found[("y / x", "1", "a")] == (1, 50.0)
    assert found[("x / y", "a", "2")] == (2, pytest.approx(200 / 3))
    assert len(found) == 2 + 3 + 2 + 3


def test_best_fit(spark):
    frame = spark.createDataFrame([("1", 3.0), ("2", 5.0), ("x", 9.0), ("4", 9.0)], "x string, y double")
    assert tuple(best_fit(frame, "x", "y").first()) == pytest.approx((2.0, 1.0, 1.0, 4.0, 3.0, 9.0))
    flat = best_fit(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first()
    assert flat["slope"] is None


def test_impacts(spark):
    impacts = spark.createDataFrame(
        [("a :: t", 1.0), ("a :: t", -3.0), ("b :: u :: v", 1.0), ("b :: u :: v", 0.0)], "feature string, impact double",
    )
    assert [tuple(r) for r in importance_grid(impacts).collect()] == [
        ("a :: t", "a", 1.0, "t"), ("b :: u :: v", "b", 0.25, "u :: v"),
    ]
    assert [tuple(r) for r in prediction_impact(impacts).collect()] == [("a", "t", -1.0), ("b", "u :: v", 0.5)]


@pytest.mark.parametrize(
    ("problem", "numeric", "names"),
    [
        (Problem.classification, True, ["histogram", "box plot"]),
        (Problem.classification, False, ["shares of target", "shares of feature", "hierarchy"]),
        (Problem.regression, True, ["points", "best fit"]),
        (Problem.regression, False, ["box plot"]),
    ],
)
def test_chart_choice(spark, problem, numeric, names):
    frame = spark.createDataFrame(pd.DataFrame({"f": [1.0, 2.0, 3.0], "t": [1, 0, 1]}))
    charts = chart_data(frame, "f", "t", problem, numeric=numeric)
    assert list(charts) == names
    assert all(c.count() > 0 for c in charts.values())
