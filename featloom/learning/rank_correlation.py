"""Rank correlations of all pairs in one plan: Spearman's rho and Kendall's tau-b, both exact.

A pair of features is a key, never a job of its own: the number of jobs does not depend on the
number of features.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.learning.matrix import FeatureMatrix, as_matrix, indexed, present
from featloom.plans.ordering import running_total
from featloom.plans.skew import split_left_join
from featloom.plans.storage import materialise

# Points that one task compares, about.
STRIP_ROWS = 500_000

# Ranks of different values up to which tasks look them up in a broadcast table.
LISTED_RANKS = 1 << 21

# Strips of heavy values lie between those of a part of the order; a part has fewer of them.
_BETWEEN = 1 << 16


def together(matrix: FeatureMatrix) -> np.ndarray:
    """Rows in which both of two features are present: one small matrix per task."""
    width = matrix.width
    first, second = (a.ravel().astype(np.int32) for a in np.indices((width, width)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                given = (~np.isnan(as_matrix(batch.column(0), width))).astype(float)
                n += given.T @ given
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (first, second, n.ravel())], ["i", "j", "n"])

    counted = matrix.frame.select("features").mapInArrow(partial, "i int, j int, n double")
    found = np.zeros((width, width))
    for row in counted.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        found[row["i"], row["j"]] = row["n"]
    return found


def spearman(matrix: FeatureMatrix) -> DataFrame:
    """Spearman's rho of all pairs, over the rows in which both features are present.

    Ranks depend on these rows, so features are put into classes that are missing in the same
    rows, and a value has a rank for each class: the rank among the rows in which that class is
    present too.  Values are counted by feature and class before they are ordered.  A bounded
    number of ranks is broadcast and no row is shuffled; beyond it, every row gets all ranks of
    its values by one join.
    """
    width = matrix.width
    shared = together(matrix)
    alone = np.diag(shared)
    same = (shared == alone[:, None]) & (shared == alone[None, :])
    firsts = same.argmax(axis=1)  # the first feature with the same rows
    heads, of = np.unique(firsts, return_inverse=True)
    classes = len(heads)

    there = F.expr(f"filter(array({', '.join(f'IF({present(f"features[{h}]")}, {k}, -1)' for k, h in enumerate(heads))}), k -> k >= 0)")
    value = F.expr(f"CASE WHEN {present('value')} THEN value + 0D END")
    long = matrix.frame.select(there.alias("there"), F.posexplode("features").alias("feature", "value")).withColumn("value", value)
    counted = long.where("value IS NOT NULL").groupBy("feature", "there", "value").agg(F.count(F.lit(1)).alias("n"))
    by_class = counted.select("feature", F.explode("there").alias("class"), "value", "n")
    by_class = by_class.groupBy("feature", "class", "value").agg(F.sum("n").alias("n"))
    placed = running_total(by_class, [F.col("feature"), F.col("class"), F.col("value")], "n", "before")
    starts = placed.groupBy("feature", "class").agg(F.min("before").alias("start"))
    # a row per feature and class; ranks are told from their mean, which is known
    middle = F.array(*(F.lit(float(shared[i, h] + 1) / 2) for i in range(width) for h in heads))
    rank = F.expr("before - start + (n + 1) / 2D") - F.get(middle, F.col("feature") * classes + F.col("class"))
    ranks = placed.join(F.broadcast(starts), ["feature", "class"]).select("feature", "class", "value", rank.alias("rank"))
    ranks = materialise(ranks, "ranks")
    if ranks.count() <= LISTED_RANKS:
        return _rank_products(matrix.frame.select("features"), width, of, _listed(ranks, width, classes))
    every = F.sequence(F.lit(0), F.lit(classes - 1))
    table = ranks.groupBy("feature", "value").agg(F.map_from_entries(F.collect_list(F.struct("class", "rank"))).alias("m"))
    table = table.select("feature", "value", F.transform(every, lambda k: F.try_element_at("m", k)).alias("ranks"))
    numbered, _ = indexed(matrix.frame.select("features"))
    long = numbered.select("index", F.posexplode("features").alias("feature", "value")).withColumn("value", value)
    joined = split_left_join(long, table, ["feature", "value"])
    none = F.array_repeat(F.lit(None).cast("double"), classes)
    cell = F.struct("feature", F.coalesce("ranks", none).alias("ranks"))
    rows = joined.groupBy("index").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return _rank_products(rows.selectExpr("flatten(cells.ranks) AS ranks"), width, of)


def _listed(ranks: DataFrame, width: int, classes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per feature its values in ascending order, and their rank in each class (NaN if it has none)."""
    found = ranks.toPandas()
    tables = []
    for f in range(width):
        own = found[found["feature"] == f]
        values, at = np.unique(own["value"].to_numpy(float), return_inverse=True)
        table = np.full((len(values), classes), np.nan)
        table[at, own["class"].to_numpy(int)] = own["rank"].to_numpy(float)
        tables.append((values, table))
    return tables


def _rank_products(
    rows: DataFrame, width: int, of: np.ndarray, listed: list[tuple[np.ndarray, np.ndarray]] | None = None,
) -> DataFrame:
    """Correlation of centred ranks: of each feature among the rows of the other's class.

    :param listed: Ranks of all values, if the rows hold values.
    """
    shared = None if listed is None else rows.sparkSession.sparkContext.broadcast(listed)

    def ranks_of(column: pa.Array) -> np.ndarray:
        if shared is None:
            return as_matrix(column, width * classes).reshape(-1, width, classes)
        x = as_matrix(column, width)
        ranks = np.full((len(x), width, classes), np.nan)
        for f, (values, table) in enumerate(shared.value):
            given = np.flatnonzero(~np.isnan(x[:, f]))
            ranks[given, f] = table[np.searchsorted(values, x[given, f])]
        return ranks

    classes = int(of.max(initial=0)) + 1
    first, second = np.triu_indices(width, k=1)
    members = [np.flatnonzero(of == k) for k in range(classes)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx, yy, xy = (np.zeros((width, width)) for _ in range(3))
        for batch in batches:
            if not batch.num_rows:
                continue
            ranks = ranks_of(batch.column(0))
            for a, b in itertools.product(range(classes), repeat=2):
                x, y = ranks[:, members[a], b], ranks[:, members[b], a]
                here = np.ix_(members[a], members[b])
                given_x, given_y = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
                x, y = np.nan_to_num(x), np.nan_to_num(y)
                xy[here] += x.T @ y
                xx[here] += (x * x).T @ given_y
                yy[here] += given_x.T @ (y * y)
        columns = [first.astype(np.int32), second.astype(np.int32), *(m[first, second] for m in (xx, yy, xy))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "xx", "yy", "xy"])

    sums = rows.mapInArrow(partial, "i int, j int, xx double, yy double, xy double")
    sums = sums.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("xx", "yy", "xy")))
    r = "CASE WHEN xx > 0 AND yy > 0 THEN greatest(-1D, least(1D, xy / sqrt(xx) / sqrt(yy))) END AS r"
    return sums.selectExpr("i", "j", r)


def kendall(matrix: FeatureMatrix) -> DataFrame:
    """Kendall's tau-b of all pairs, over the rows in which both features are present.

    Equal points of a pair are counted first, in the tasks that read them.  Pairs of points
    are then compared by strips of both axes (see :func:`_agreement`).
    """
    rows = matrix.frame.select("features", F.posexplode("features").alias("i", "x"))
    later = F.posexplode(F.slice("features", F.col("i") + 2, F.greatest(F.size("features") - F.col("i") - 1, F.lit(0))))
    points = rows.where(present("x")).select("i", "x", later.alias("j", "y")).where(present("y"))
    points = points.select("i", (F.col("i") + F.col("j") + 1).alias("j"), F.expr("x + 0D AS x"), F.expr("y + 0D AS y"))
    cells = points.groupBy("i", "j", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    cells = materialise(cells, "points")

    size = cells.groupBy("i", "j").agg(F.expr("sum(n) * (sum(n) - 1) / 2D").alias("pairs"))
    for axis in ("x", "y"):
        ties = cells.groupBy("i", "j", axis).agg(F.sum("n").alias("n")).groupBy("i", "j")
        size = size.join(ties.agg(F.expr("sum(CAST(n AS DOUBLE) * (n - 1) / 2)").alias(f"ties {axis}")), ["i", "j"])
    every = F.explode(F.sequence(F.lit(0), F.lit(matrix.width - 1)))
    spark = matrix.frame.sparkSession
    grid = spark.range(1).select(every.alias("i")).select("i", every.alias("j")).where("i < j")
    spread = "sqrt(greatest(0D, pairs - `ties x`)) * sqrt(greatest(0D, pairs - `ties y`))"
    joined = grid.join(size, ["i", "j"], "left").join(_agreement(cells), ["i", "j"], "left")
    return joined.selectExpr("i", "j", f"CASE WHEN {spread} > 0 THEN greatest(-1D, least(1D, coalesce(s, 0D) / ({spread}))) END AS r")


def _agreement(cells: DataFrame) -> DataFrame:
    """Weighted number of concordant minus discordant pairs of points, ``s`` of each (i, j).

    Both axes are cut into strips.  Two points are compared in exactly one of three ways: inside
    a strip of x; inside a strip of y, if only their x strips differ; or as strips, if both
    differ.  Strips are points of a smaller problem of the same kind, so nothing limits their
    number.
    """
    count = cells.count()
    parts = -(-count // STRIP_ROWS)
    if parts <= 1:
        return _compared(cells, ["i", "j"], "x", "y")
    placed = _strips(_strips(cells, "x", "sx", parts), "y", "sy", parts)
    by_y = placed.where("sy % 2 = 0").groupBy("i", "j", "sy", "sx", "y").agg(F.sum("n").alias("n"))
    by_strip = placed.groupBy("i", "j", F.col("sx").alias("x"), F.col("sy").alias("y")).agg(F.sum("n").alias("n"))
    by_strip = materialise(by_strip, "strip-points")
    smaller = 2 * by_strip.count() < count  # it is below STRIP_ROWS squared points
    found = [
        # odd strips hold a single value and therefore no order
        _compared(placed.where("sx % 2 = 0"), ["i", "j", "sx"], "x", "y"),
        _compared(by_y, ["i", "j", "sy"], "sx", "y"),
        _agreement(by_strip) if smaller else _compared(by_strip, ["i", "j"], "x", "y"),
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), found).groupBy("i", "j").agg(F.sum("s").alias("s"))


def _strips(cells: DataFrame, axis: str, name: str, parts: int) -> DataFrame:
    """Number the strips of an axis in its order: parts of a range partitioning, in which values
    with very many points are strips of their own, with odd numbers."""
    dealt = cells.repartitionByRange(parts, "i", "j", axis).withColumn("part", F.spark_partition_id())
    placed = materialise(dealt, "strips")
    own = ["i", "j", "part"]
    counted = placed.groupBy(*own, axis).agg(F.count(F.lit(1)).alias("points")).where(F.col("points") > STRIP_ROWS)
    heavy = materialise(counted.groupBy(*own).agg(F.collect_list(axis).alias("heavy")), "heavy-values")
    number = F.expr(
        f"CAST(part AS BIGINT) * {_BETWEEN} + coalesce(2 * size(filter(heavy, h -> h < {axis})) + CAST(array_contains(heavy, {axis}) AS INT), 0)",
    )
    return placed.join(heavy, own, "left").withColumn(name, number).drop("part", "heavy")


def _compared(points: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Agreement inside each group, whose points one task merges."""

    def count(own: pd.DataFrame) -> pd.DataFrame:
        s = signed_pairs(own["x"], own["y"], own["n"])
        return pd.DataFrame({"i": own["i"].iloc[:1], "j": own["j"].iloc[:1], "s": [s]})

    named = points.select(*group, *(F.col(c).alias(t) for c, t in ((x, "x"), (y, "y")) if c not in group), "n")
    return named.groupBy(*group).applyInPandas(count, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def signed_pairs(x: pd.Series, y: pd.Series, weight: pd.Series) -> float:
    """Sum of ``sign(dx) * sign(dy)`` over all pairs of weighted points with distinct (x, y)."""
    order = np.lexsort((-np.asarray(y, dtype=float), np.asarray(x, dtype=float)))
    x = np.asarray(x, dtype=float)[order]
    w = np.asarray(weight, dtype=float)[order]
    _, rank = np.unique(np.asarray(y, dtype=float)[order], return_inverse=True)

    # merge passes over blocks of doubling size: compare each right half with its left half
    total, block, n = 0.0, 1, len(x)
    position = np.arange(n)
    height = int(rank.max()) + 1 if n else 1
    while block < n:
        pair, is_right = position // (2 * block), (position // block) % 2 == 1
        code = pair * height + rank
        left = np.flatnonzero(~is_right)
        left = left[np.argsort(code[left], kind="stable")]
        sums = np.concatenate([[0.0], np.cumsum(w[left])])
        codes, right = code[left], np.flatnonzero(is_right)
        start = np.searchsorted(codes, pair[right] * height, "left")
        stop = np.searchsorted(codes, (pair[right] + 1) * height, "left")
        below = sums[np.searchsorted(codes, code[right], "left")] - sums[start]
        above = sums[stop] - sums[np.searchsorted(codes, code[right], "right")]
        total += float((w[right] * (below - above)).sum())
        block *= 2

    # pairs of equal x were sorted against each other and counted as discordant
    by_x = pd.Series(w).groupby(x)
    return total + float(((by_x.sum() ** 2 - pd.Series(w**2).groupby(x).sum()) / 2).sum())
