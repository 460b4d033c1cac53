"""Metrics, cohort statistics and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom.plans.ordering import ordered_split
from featloom.problem import Problem
from featloom.reports import (
    best_fit,
    box_plot,
    classification_metrics,
    cohort_classes,
    cohort_predicate,
    cohort_values,
    comparison,
    contingency,
    equal_count_buckets,
    hierarchy,
    regression_metrics,
    without_missing,
)
from workload.registry import dq, query, r4, read

_GUESS = "CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END"


def _macro_sql(source: str, actual: str, predicted: str) -> str:
    """Macro-averaged metrics over the classes that occur on either side."""
    return (
        f"WITH rows AS (SELECT {actual} AS a, {predicted} AS p FROM {source}), "
        "classes AS (SELECT a AS c FROM rows UNION SELECT p FROM rows), "
        "counts AS (SELECT c, (SELECT count(*) FROM rows WHERE a = c AND p = c) AS hits, "
        "(SELECT count(*) FROM rows WHERE a = c) AS actual, (SELECT count(*) FROM rows WHERE p = c) AS predicted "
        "FROM classes) "
        f"SELECT {r4('sum(hits) * 1.0 / sum(actual)')} AS accuracy, "
        f"{r4('avg(2.0 * hits / (actual + predicted))')} AS f1, "
        f"{r4('avg(coalesce(hits * 1.0 / nullif(predicted, 0), 0))')} AS precision_score, "
        f"{r4('avg(coalesce(hits * 1.0 / nullif(actual, 0), 0))')} AS recall_score FROM counts"
    )


@query(_macro_sql("lineitem", "l_returnflag", _GUESS))
def metrics_class(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_returnflag", f"{_GUESS} AS guess")
    return classification_metrics(rows, "l_returnflag", "guess").selectExpr(
        f"{r4('Accuracy')} AS accuracy",
        f"{r4('F1')} AS f1",
        f"{r4('Precision')} AS precision_score",
        f"{r4('Recall')} AS recall_score",
    )


_PRICE_GUESS = "l_quantity * 1500"
_RMSE = "sqrt(avg((l_extendedprice - {p}) * (l_extendedprice - {p})))"
_R2 = "1 - avg((l_extendedprice - {p}) * (l_extendedprice - {p})) / var_pop(l_extendedprice)"


@query(
    f"SELECT {r4(_RMSE.format(p=_PRICE_GUESS))} AS rmse, {r4(_R2.format(p=_PRICE_GUESS))} AS r2 FROM lineitem",
)
def metrics_reg(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_extendedprice", f"{_PRICE_GUESS} AS guess")
    return regression_metrics(rows, "l_extendedprice", "guess").selectExpr(f"{r4('RMSE')} AS rmse", f"{r4('R2')} AS r2")


@query(
    "WITH m AS (SELECT "
    f"{_RMSE.format(p='(l_quantity * 1500)')} AS rmse, {_R2.format(p='(l_quantity * 1500)')} AS r2, "
    f"{_RMSE.format(p='(l_quantity * 1000)')} AS rmse0, {_R2.format(p='(l_quantity * 1000)')} AS r20 FROM lineitem) "
    f"SELECT 'RMSE' AS metric, {r4('rmse')} AS model, {r4('rmse0')} AS baseline, "
    f"{r4('-(rmse - rmse0) / rmse0 * 100')} AS improvement FROM m UNION ALL "
    f"SELECT 'R2', {r4('r2')}, {r4('r20')}, {r4('abs((r2 - r20) / r20 * 100)')} FROM m",
)
def comparison_reg(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").selectExpr(
        "l_extendedprice", "l_quantity * 1500 AS model", "l_quantity * 1000 AS base",
    )
    compared = comparison(rows, Problem.regression, actual="l_extendedprice", model="model", baseline="base")
    return compared.selectExpr(
        "Metric AS metric",
        f"{r4('Model')} AS model",
        f"{r4('Baseline')} AS baseline",
        f"{r4('Improvement')} AS improvement",
    )


@query(
    "WITH model AS (" + _macro_sql("lineitem", "l_returnflag", _GUESS).replace("round(", "(").replace(" + 1.234567e-7, 4)", ")")
    + "), base AS (" + _macro_sql("lineitem", "l_returnflag", "'N'").replace("round(", "(").replace(" + 1.234567e-7, 4)", ")")
    + ") "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS metric, {r4('model.' + c)} AS model, {r4('base.' + c)} AS baseline, "
        f"{r4(f'(model.{c} - base.{c}) / base.{c} * 100')} AS improvement FROM model, base"
        for name, c in (
            ("Accuracy", "accuracy"), ("F1", "f1"), ("Precision", "precision_score"), ("Recall", "recall_score"),
        )
    ),
)
def comparison_class(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_returnflag", f"{_GUESS} AS model", "'N' AS base")
    compared = comparison(rows, Problem.classification, actual="l_returnflag", model="model", baseline="base")
    return compared.selectExpr(
        "Metric AS metric",
        f"{r4('Model')} AS model",
        f"{r4('Baseline')} AS baseline",
        f"{r4('Improvement')} AS improvement",
    )


_RULES = {"l_quantity": (">=", 25), "l_discount": ("<", 0.06), "l_linestatus": ["O"]}
_COHORT = "(l_quantity >= 25 AND l_discount < 0.06 AND l_linestatus = 'O')"


@query(
    "SELECT l_returnflag AS class, count(*) FILTER (WHERE " + _COHORT + ") AS in_cohort, count(*) AS in_class, "
    + r4(f"count(*) FILTER (WHERE {_COHORT}) * 100.0 / (SELECT count(*) FROM lineitem WHERE {_COHORT})")
    + " AS prevalence, " + r4(f"count(*) FILTER (WHERE {_COHORT}) * 100.0 / count(*)") + " AS recall, "
    + f"(SELECT count(*) FROM lineitem WHERE {_COHORT}) AS group_size, "
    + r4(f"(SELECT count(*) FROM lineitem WHERE {_COHORT}) * 100.0 / (SELECT count(*) FROM lineitem)")
    + " AS group_percentage FROM lineitem GROUP BY l_returnflag",
)
def cohort_class(spark, sf_dir):
    stats = cohort_classes(read(spark, sf_dir, "lineitem"), cohort_predicate(_RULES), "l_returnflag")
    return stats.selectExpr(
        "class", "in_cohort", "in_class", f"{r4('prevalence')} AS prevalence", f"{r4('recall')} AS recall",
        "group_size", f"{r4('group_percentage')} AS group_percentage",
    )


@query(
    f"WITH s AS (SELECT count(*) FILTER (WHERE {_COHORT}) AS group_size, "
    f"count(*) FILTER (WHERE {_COHORT}) * 100.0 / count(*) AS group_percentage, "
    f"avg(l_extendedprice) FILTER (WHERE {_COHORT}) AS selected_mean, "
    f"avg(l_extendedprice) FILTER (WHERE NOT {_COHORT}) AS rest_mean, "
    f"median(l_extendedprice) FILTER (WHERE {_COHORT}) AS selected_median, "
    f"median(l_extendedprice) FILTER (WHERE NOT {_COHORT}) AS rest_median FROM lineitem) "
    f"SELECT group_size, {r4('group_percentage')} AS group_percentage, {r4('selected_mean')} AS selected_mean, "
    f"{r4('rest_mean')} AS rest_mean, {r4('(selected_mean - rest_mean) / rest_mean * 100')} AS mean_difference, "
    "selected_median, rest_median, "
    f"{r4('(selected_median - rest_median) / rest_median * 100')} AS median_difference FROM s",
)
def cohort_reg(spark, sf_dir):
    stats = cohort_values(read(spark, sf_dir, "lineitem"), cohort_predicate(_RULES), "l_extendedprice")
    return stats.selectExpr(
        "group_size",
        f"{r4('group_percentage')} AS group_percentage",
        f"{r4('selected_mean')} AS selected_mean",
        f"{r4('rest_mean')} AS rest_mean",
        f"{r4('mean_difference')} AS mean_difference",
        "selected_median",
        "rest_median",
        f"{r4('median_difference')} AS median_difference",
    )


@query("SELECT user_id, nullif(value, 0) AS value FROM events WHERE nullif(value, 0) IS NOT NULL")
def null_mask(spark, sf_dir):
    rows = read(spark, sf_dir, "events").selectExpr("user_id", "nullif(value, 0) AS value")
    return without_missing(rows, "user_id", "value")


_ROWS = "SELECT *, row_number() OVER (ORDER BY l_extendedprice, l_returnflag) - 1 AS i, count(*) OVER () AS n FROM lineitem"


@query(
    f"WITH r AS ({_ROWS}), b AS (SELECT *, CAST(floor(i / ceil(n / 5.0)) AS BIGINT) AS bucket FROM r), "
    "s AS (SELECT bucket, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS size "
    "FROM b GROUP BY bucket) "
    "SELECT s.bucket, printf('%.2f - %.2f', low, high) AS label, b.l_returnflag AS class, count(*) AS count, "
    f"{r4('count(*) * 100.0 / any_value(size)')} AS percentage "
    "FROM b JOIN s ON b.bucket = s.bucket GROUP BY s.bucket, low, high, b.l_returnflag",
)
def hist5_class(spark, sf_dir):
    data = equal_count_buckets(read(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag")
    return data.withColumn("percentage", F.expr(r4("percentage")))


@query(
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3, "
    "min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders) "
    "SELECT o_orderpriority AS x, min(o_totalprice) AS minimum, max(o_totalprice) AS maximum, count(*) AS count, "
    f"{r4('quantile_cont(o_totalprice, 0.25)')} AS q1, {r4('median(o_totalprice)')} AS median, "
    f"{r4('quantile_cont(o_totalprice, 0.75)')} AS q3, "
    f"{r4('greatest(any_value(low), any_value(q.q1 - 1.5 * (q.q3 - q.q1)))')} AS axis_low, "
    f"{r4('least(any_value(high), any_value(q.q3 + 1.5 * (q.q3 - q.q1)))')} AS axis_high "
    "FROM orders, q GROUP BY o_orderpriority",
)
def box_stats(spark, sf_dir):
    boxes = box_plot(read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return boxes.selectExpr(
        "x", "minimum", "maximum", "count",
        *(f"{r4(c)} AS {c}" for c in ("q1", "median", "q3", "axis_low", "axis_high")),
    )


@query(
    "SELECT l_returnflag AS x, "
    + ", ".join(
        r4(f"count(*) FILTER (WHERE l_linestatus = '{s}') * 100.0 / count(*)") + f" AS {dq(s)}" for s in ("F", "O")
    )
    + " FROM lineitem GROUP BY l_returnflag",
)
def contingency_pct(spark, sf_dir):
    shares = contingency(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return shares.selectExpr("x", *(f"{r4(c)} AS `{c}`" for c in shares.columns if c != "x"))


def _nested(outer: str, inner: str, path: str) -> str:
    total = "(SELECT count(*) FROM lineitem)"
    parent = f"(SELECT {outer}, count(*) AS p FROM lineitem GROUP BY {outer})"
    return (
        f"SELECT '{path}' AS path, CAST(NULL AS VARCHAR) AS parent, {outer} AS label, count(*) AS count, "
        f"{r4(f'count(*) * 100.0 / {total}')} AS percent_of_parent FROM lineitem GROUP BY {outer} UNION ALL "
        f"SELECT '{path}', l.{outer}, l.{inner}, count(*), {r4('count(*) * 100.0 / any_value(p)')} "
        f"FROM lineitem l JOIN {parent} t ON l.{outer} = t.{outer} GROUP BY l.{outer}, l.{inner}"
    )


@query(
    _nested("l_linestatus", "l_returnflag", "y / x") + " UNION ALL " + _nested("l_returnflag", "l_linestatus", "x / y"),
)
def sunburst_counts(spark, sf_dir):
    data = hierarchy(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return data.withColumn("percent_of_parent", F.expr(r4("percent_of_parent")))


@query(
    "WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, "
    "regr_intercept(l_extendedprice, l_quantity) AS intercept, min(l_quantity) AS x_min, max(l_quantity) AS x_max "
    "FROM lineitem) "
    f"SELECT {r4('slope')} AS slope, {r4('intercept')} AS intercept, x_min, x_max, "
    f"{r4('slope * x_min + intercept')} AS y_at_min, {r4('slope * x_max + intercept')} AS y_at_max FROM f",
)
def line_of_best_fit(spark, sf_dir):
    line = best_fit(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return line.selectExpr(
        f"{r4('slope')} AS slope", f"{r4('intercept')} AS intercept", "x_min", "x_max",
        f"{r4('y_at_min')} AS y_at_min", f"{r4('y_at_max')} AS y_at_max",
    )


@query(
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) "
    "<= CAST(floor(0.8 * (SELECT count(*) FROM orders)) AS BIGINT) AS is_train FROM orders",
)
def split_80_20(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    split = ordered_split(orders, [F.col("o_orderdate"), F.col("o_orderkey")], 0.8, "is_train")
    return split.select("o_orderkey", "is_train")
