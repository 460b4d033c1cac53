"""The data behind the charts that relate a feature to the target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.functions import quote
from featloom.plans.ordering import running_total
from featloom.plans.quantiles import grouped_quantiles
from featloom.problem import Problem
from featloom.reports.cohorts import without_missing

# Fixed value: the number of buckets of a histogram.
BUCKETS = 5

# A contingency table has one column per value of y; more columns than this are no table.
MAX_SHARES = 1_000


def equal_count_buckets(frame: DataFrame, x: str, y: str, *, buckets: int = BUCKETS) -> DataFrame:
    """Class counts in consecutive buckets of ``ceil(n / buckets)`` rows, ordered by x (then y).

    Equal (x, y) pairs are counted first; a pair that straddles a bucket limit is divided.
    The positions come from a range-partitioned running total, so a heavy value stays one row.
    """
    pairs = without_missing(frame.selectExpr(f"{quote(x)} AS x", f"{quote(y)} AS y"), "x", "y")
    counted = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(counted, [F.col("x"), F.col("y")], "n", "before")

    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = max(1, -(-total // buckets))
    spread = placed.select(
        "x",
        "y",
        F.explode(F.sequence(F.expr(f"before DIV {size}"), F.expr(f"(before + n - 1) DIV {size}"))).alias("bucket"),
        "before",
        "n",
    ).withColumn(
        "n",
        F.expr(f"least(before + n, (bucket + 1) * {size}) - greatest(before, bucket * {size})"),
    )
    cells = spread.groupBy("bucket", "y").agg(
        F.sum("n").alias("n"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
    )

    per_bucket = cells.groupBy("bucket").agg(
        F.sum("n").alias("size"),
        F.min("low").cast("double").alias("low"),
        F.max("high").cast("double").alias("high"),
    )
    # every bucket lists every class, also without rows
    every = cells.select("y").distinct().select("y", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    every = every.withColumn("bucket", F.col("bucket").cast("long"))
    return (
        every.join(F.broadcast(per_bucket), "bucket", "left")
        .join(cells.select("bucket", "y", "n"), ["bucket", "y"], "left")
        .select(
            "bucket",
            F.expr("CASE WHEN low IS NULL THEN 'nan - nan' ELSE printf('%.2f - %.2f', low, high) END").alias("label"),
            F.col("y").alias("class"),
            F.coalesce("n", F.lit(0)).alias("count"),
            F.expr("coalesce(n * 100D / size, 0D)").alias("percentage"),
        )
    )


def contingency(frame: DataFrame, x: str, y: str) -> DataFrame:
    """Share of each value of y, in percent, for each value of x: one column per value of y."""
    cells = (
        without_missing(frame.selectExpr(f"{quote(x)} AS x", f"{quote(y)} AS y"), "x", "y")
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    values = [row[0] for row in cells.select("y").distinct().orderBy("y").limit(MAX_SHARES + 1).collect()]
    if len(values) > MAX_SHARES:
        raise ValueError(f"{y} has more than {MAX_SHARES} values, too many for one column each")
    wide = cells.groupBy("x").pivot("y", values).agg(F.sum("n"))
    names = [n for n in wide.columns if n != "x"]
    total = " + ".join(f"coalesce({quote(n)}, 0)" for n in names) or "0"
    return wide.selectExpr("x", *(f"coalesce({quote(n)}, 0) * 100D / ({total}) AS {quote(n)}" for n in names))


def contingency_shares(frame: DataFrame, x: str, y: str) -> DataFrame:
    """The same table as rows (x, y, count, percentage), for any number of values of y."""
    cells = (
        without_missing(frame.selectExpr(f"{quote(x)} AS x", f"{quote(y)} AS y"), "x", "y")
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    totals = cells.groupBy("x").agg(F.sum("count").alias("total"))
    return cells.join(totals, "x").select("x", "y", "count", F.expr("count * 100D / total").alias("percentage"))


def hierarchy(frame: DataFrame, x: str, y: str) -> DataFrame:
    """Counts of both nestings of x and y, with the share of each entry in its parent."""
    cells = (
        without_missing(frame.selectExpr(f"{quote(x)} AS x", f"{quote(y)} AS y"), "x", "y")
        .groupBy(F.expr("CAST(x AS STRING)").alias("x"), F.expr("CAST(y AS STRING)").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # inner and outer entries of both nestings, from the counted cells
    entries = cells.selectExpr(
        "inline(array("
        "named_struct('path', 'y / x', 'outer', y, 'inner', x, 'n', n),"
        "named_struct('path', 'y / x', 'outer', y, 'inner', NULL, 'n', n),"
        "named_struct('path', 'x / y', 'outer', x, 'inner', y, 'n', n),"
        "named_struct('path', 'x / y', 'outer', x, 'inner', NULL, 'n', n)))",
    )
    counted = entries.groupBy("path", "outer", "inner").agg(F.sum("n").alias("count"))
    parents = counted.where("inner IS NULL").selectExpr("path", "outer", "count AS parent_count")
    total = cells.agg(F.sum("n")).scalar()
    leaves = counted.where("inner IS NOT NULL").join(parents, ["path", "outer"]).selectExpr(
        "path", "outer AS parent", "inner AS label", "count", "count * 100D / parent_count AS percent_of_parent",
    )
    roots = counted.where("inner IS NULL").select(
        "path",
        F.lit(None).cast("string").alias("parent"),
        F.col("outer").alias("label"),
        "count",
        (F.col("count") * F.lit(100.0) / total).alias("percent_of_parent"),
    )
    return roots.unionByName(leaves)


def box_plot(frame: DataFrame, x: str, y: str, *, row_limit: int | None = None) -> DataFrame:
    """Quartiles and extremes of y per value of x, and the axis limits over all rows.

    The limits reach 1.5 interquartile ranges beyond the quartiles, but not beyond the data.
    """
    pairs = without_missing(
        frame.selectExpr(f"{quote(x)} AS x", f"CAST({quote(y)} AS DOUBLE) AS y"), "x", "y",
    )
    quartiles = {"q1": ("y", 0.25), "median": ("y", 0.5), "q3": ("y", 0.75)}
    extremes = pairs.groupBy("x").agg(
        F.min("y").alias("minimum"), F.max("y").alias("maximum"), F.count(F.lit(1)).alias("count"),
    )
    groups = extremes.join(grouped_quantiles(pairs, ["x"], quartiles, row_limit=row_limit), "x")

    whole = grouped_quantiles(pairs, [], quartiles, row_limit=row_limit).first()
    if whole["q1"] is None:
        return groups.selectExpr("*", "CAST(NULL AS DOUBLE) AS axis_low", "CAST(NULL AS DOUBLE) AS axis_high")
    reach = 1.5 * (whole["q3"] - whole["q1"])
    return groups.select(
        "*",
        F.greatest(extremes.agg(F.min("minimum")).scalar(), F.lit(whole["q1"] - reach)).alias("axis_low"),
        F.least(extremes.agg(F.max("maximum")).scalar(), F.lit(whole["q3"] + reach)).alias("axis_high"),
    )


def best_fit(frame: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x, with its end points at the extremes of x."""
    pairs = without_missing(
        frame.selectExpr(f"try_cast({quote(x)} AS DOUBLE) AS x", f"CAST({quote(y)} AS DOUBLE) AS y"), "x", "y",
    )
    return pairs.selectExpr(
        "regr_slope(y, x) AS slope",
        "regr_intercept(y, x) AS intercept",
        "min(x) AS x_min",
        "max(x) AS x_max",
    ).selectExpr("*", "slope * x_min + intercept AS y_at_min", "slope * x_max + intercept AS y_at_max")


def chart_data(frame: DataFrame, feature: str, target: str, problem: Problem, *, numeric: bool) -> dict[str, DataFrame]:
    """The charts that suit the problem and the kind of feature."""
    match problem, numeric:
        case Problem.classification, True:
            return {
                "histogram": equal_count_buckets(frame, feature, target),
                "box plot": box_plot(frame, target, feature),
            }
        case Problem.classification, False:
            return {
                "shares of target": contingency(frame, feature, target),
                "shares of feature": contingency(frame, target, feature),
                "hierarchy": hierarchy(frame, feature, target),
            }
        case Problem.regression, True:
            points = frame.selectExpr(f"{quote(feature)} AS x", f"{quote(target)} AS y")
            return {"points": without_missing(points, "x", "y"), "best fit": best_fit(frame, feature, target)}
        case _:
            return {"box plot": box_plot(frame, feature, target)}
