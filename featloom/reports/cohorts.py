"""Statistics of a group of rows that is described by rules on features."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.functions import literal, quote
from featloom.plans.profile import is_floating
from featloom.plans.quantiles import grouped_quantiles

COMPARISONS = ("<", "<=", ">=", ">")

Rule = tuple[str, Any] | Collection[Any]


def cohort_predicate(rules: Mapping[str, Rule]) -> str:
    """SQL predicate of a cohort: every rule must hold, and a missing value never does.

    :param rules: Feature name → (comparison, number), or the collection of accepted values.
    """
    parts = []
    for feature, rule in rules.items():
        if isinstance(rule, tuple) and len(rule) == 2 and rule[0] in COMPARISONS:
            comparison, value = rule
            # Spark sorts NaN above all numbers, but no comparison with NaN holds
            x = quote(feature)
            guard = f" AND NOT isnan({x})" if comparison in (">", ">=") else ""
            parts.append(f"({x} {comparison} {literal(value)}{guard})")
        else:
            accepted = ", ".join(literal(v) for v in rule)
            parts.append(f"({quote(feature)} IN ({accepted}))" if accepted else "false")
    return f"coalesce({' AND '.join(parts) or 'true'}, false)"


def without_missing(frame: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null or NaN."""
    schema = frame.schema
    for name in columns:
        frame = frame.where(f"{quote(name)} IS NOT NULL")
        if is_floating(schema[name].dataType):
            frame = frame.where(f"NOT isnan({quote(name)})")
    return frame


def cohort_classes(frame: DataFrame, predicate: str, target: str) -> DataFrame:
    """Per class: its share of the cohort (prevalence) and the share of it inside (recall)."""
    classes = frame.groupBy(F.col(quote(target)).alias("class")).agg(
        F.expr(f"count_if({predicate})").alias("in_cohort"),
        F.count(F.lit(1)).alias("in_class"),
    )
    group_size = classes.agg(F.sum("in_cohort")).scalar()
    total_size = classes.agg(F.sum("in_class")).scalar()
    return classes.select(
        "class",
        "in_cohort",
        "in_class",
        F.coalesce(F.try_divide(F.col("in_cohort") * F.lit(100.0), group_size), F.lit(0.0)).alias("prevalence"),
        (F.col("in_cohort") * F.lit(100.0) / F.col("in_class")).alias("recall"),
        group_size.alias("group_size"),
        (group_size * F.lit(100.0) / total_size).alias("group_percentage"),
    )


def cohort_values(
    frame: DataFrame,
    predicate: str,
    target: str,
    *,
    row_limit: int | None = None,
) -> DataFrame:
    """Mean and median of the target in the cohort and outside, with the difference in percent."""
    marked = frame.selectExpr(f"{predicate} AS inside", f"CAST({quote(target)} AS DOUBLE) AS y")
    means = marked.groupBy("inside").agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n"))
    medians = grouped_quantiles(marked, ["inside"], {"median": ("y", 0.5)}, row_limit=row_limit)

    def side(value: str, inside: bool) -> str:
        return f"max({value}) FILTER (WHERE {'inside' if inside else 'NOT inside'})"

    def difference(name: str) -> str:
        return (
            f"CASE WHEN rest_{name} = 0 THEN 0D "
            f"ELSE (selected_{name} - rest_{name}) / rest_{name} * 100 END AS {name}_difference"
        )

    return (
        # two rows on either side
        means.join(F.broadcast(medians), "inside")
        .selectExpr(
            f"coalesce({side('n', True)}, 0) AS group_size",
            "sum(n) AS total_size",
            *(
                f"{side(value, inside)} AS {name}_{value}"
                for value in ("mean", "median")
                for name, inside in (("selected", True), ("rest", False))
            ),
        )
        .selectExpr(
            "group_size",
            "group_size * 100D / total_size AS group_percentage",
            "selected_mean",
            "rest_mean",
            difference("mean"),
            "selected_median",
            "rest_median",
            difference("median"),
        )
    )
