"""Quantiles per group, also for groups that do not fit into one task.

Small groups use the built-in ``percentile`` aggregate, groups beyond the row limit a radix
selection over counted prefixes of their values, in a fixed number of scans.  Quantiles of the
elements of an array column are bracketed by a sketch and then counted inside the brackets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featloom.functions import quote
from featloom.plans.skew import HotGroups, find_hot_groups
from featloom.plans.storage import materialise, release

# Values that one task may hold for the exact quantiles of a group, over all its targets.
VALUE_LIMIT = 4_000_000

# Share of the rows of a group by which the rank of a sketched quantile may be off.
SKETCH_ERROR = 1 / 10_000

# Prefixes per power of two, and equal steps that a prefix is cut into.
STEPS = 1 << 10
CELLS = 1 << 21

# Sign and binary logarithm of a value: a whole number that never decreases with the value.
# Zero is 0, infinities and NaN (last, as Spark orders it) lie beyond all logarithms.
PREFIX = f"""CASE WHEN isnan(value) THEN {8000 * STEPS}L
  WHEN abs(value) = CAST('Infinity' AS DOUBLE) THEN CAST(signum(value) AS BIGINT) * {4000 * STEPS}L
  WHEN value = 0 THEN 0L
  WHEN value IS NOT NULL THEN CAST(signum(value) AS BIGINT) * CAST(floor((log2(abs(value)) + 1100) * {STEPS}) AS BIGINT) END"""

# Ranks of the sketch that brackets quantiles of arrays, and values that a task counts at a time.
BRACKETS = 2_000
BUFFERED = 1 << 20

_CELL = {"n": "count(value)", "low": "min(value)", "high": "max(value)"}


def default_row_limit(targets: int) -> int:
    """Rows of a group whose quantiles one task may compute for this many targets."""
    return VALUE_LIMIT // max(1, targets)


def percentile_sql(sql: str, p: float, where: str | None = None) -> str:
    condition = f" FILTER (WHERE {where})" if where else ""
    return f"percentile({sql}, {p!r}D){condition}"


def sketch_sql(sql: str, p: float) -> str:
    """A quantile from a mergeable sketch."""
    return f"percentile_approx(CAST({sql} AS DOUBLE), {p!r}D, {round(1 / SKETCH_ERROR)})"


def grouped_quantiles(
    frame: DataFrame,
    keys: Sequence[str],
    targets: Mapping[str, tuple[str, float]],
    *,
    row_limit: int | None = None,
    checked_rows: int | None = None,
) -> DataFrame:
    """One row per group with an exact, linearly interpolated quantile per target.

    :param keys: Columns of ``frame`` to group by; empty for the whole frame.
    :param targets: Output name → (SQL expression, probability).  Nulls are ignored.
    :param row_limit: Largest group for one task; chosen by the number of targets if absent.
    :param checked_rows: Known upper bound of the number of rows, if any.
    """
    keys = list(keys)
    row_limit = row_limit or default_row_limit(len(targets))
    builtin = [F.expr(percentile_sql(sql, p)).alias(name) for name, (sql, p) in targets.items()]
    by = [F.col(quote(k)) for k in keys]
    if checked_rows is not None and checked_rows <= row_limit:
        return frame.groupBy(*by).agg(*builtin)

    hot = find_hot_groups(frame, keys, row_limit=row_limit)
    if hot is None:
        return frame.groupBy(*by).agg(*builtin)
    if not keys:
        return hot_quantiles(frame, keys, targets, row_limit=row_limit)
    heavy, light = split_by_heat(frame, keys, hot)
    return light.groupBy(*by).agg(*builtin).unionByName(
        hot_quantiles(heavy, keys, targets, row_limit=row_limit),
    )


def split_by_heat(frame: DataFrame, keys: Sequence[str], hot: HotGroups) -> tuple[DataFrame, DataFrame]:
    """Rows of hot groups, and all other rows.  Few hot keys are broadcast, without a shuffle."""
    listed = hot.listed.select(*(F.col(quote(k)).alias(f"hot {i}") for i, k in enumerate(keys)))
    match = F.lit(True)
    for i, key in enumerate(keys):
        match = match & F.col(quote(key)).eqNullSafe(F.col(quote(f"hot {i}")))
    return frame.join(listed, match, "left_semi"), frame.join(listed, match, "left_anti")


def hot_quantiles(
    frame: DataFrame,
    keys: Sequence[str],
    targets: Mapping[str, tuple[str, float]],
    *,
    row_limit: int,
    expand: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """Exact quantiles of arbitrarily large groups by radix selection, for all of them together.

    A value has a prefix that keeps the order: its sign and its binary logarithm in steps of
    1 / ``STEPS``.  Counted prefixes tell where the wanted ranks lie; if too much lies there, those
    cells are counted again in ``CELLS`` equal steps, of which one holds at most 2**21 different
    numbers; what is left is counted value by value.  That is two scans, or three, whatever the
    size of the groups and the number of targets, and all counts are combined before the shuffle.

    :param expand: Turns rows with all keys but the first (the names of all are passed) into those of the
        groups, which may overlap.  It sees counts, and values with the prefix of a wanted cell,
        never all rows.
    """
    keys = list(keys)
    aliases = [f"key {i}" for i in range(len(keys))]
    expand = expand or (lambda part, _: part)
    overlapping = set(keys) - set(frame.columns)
    group = [*aliases, "target"]
    by = [F.col(quote(g)) for g in group]
    probabilities = F.array(*(F.lit(p) for _, p in targets.values()))

    # long form: one row per (group, target, value)
    values = ", ".join(
        f"named_struct('target', {i}, 'value', CAST({sql} AS DOUBLE))"
        for i, (sql, _) in enumerate(targets.values())
    )
    rows = frame.selectExpr(
        *(f"{quote(k)} AS {quote(a)}" for k, a in zip(keys, aliases) if k not in overlapping),
        f"inline(array({values}))",
    ).withColumn("prefix", F.expr(PREFIX))

    own = [F.col(quote(a)) for k, a in zip(keys, aliases) if k not in overlapping]
    counted = rows.groupBy(*own, "target", "prefix").agg(*(F.expr(sql).alias(name) for name, sql in _CELL.items()))
    if overlapping:
        counted = expand(counted, aliases).groupBy(*by, "prefix").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    everywhere = Window.partitionBy(*by)
    total = F.sum("n").over(everywhere)
    position = (total - 1) * F.element_at(probabilities, F.col("target") + 1)
    counted = counted.withColumn("empty", total == 0).withColumn("position", position).selectExpr(
        "empty",
        *(quote(g) for g in group),
        "prefix", "n", "low", "high", "0L AS base",
        "CAST(floor(position) AS BIGINT) AS low_rank", "CAST(ceil(position) AS BIGINT) AS high_rank",
        "position - floor(position) AS fraction",
    )
    cells = materialise(_wanted(counted, group, "prefix", keep="empty"), "quantile-cells")
    groups = cells.select(*(F.col(quote(a)) for a in aliases)).distinct()  # also those without a value
    if overlapping:
        rows = expand(rows.join(cells.select("target", "prefix").distinct(), ["target", "prefix"], "left_semi"), aliases)
    if (cells.agg(F.max("n")).first()[0] or 0) > row_limit:
        step = f"CASE WHEN high > low THEN CAST(floor((value - low) / (high - low) * {CELLS}) AS BIGINT) ELSE 0 END"
        finer = _inside(rows, cells, group).withColumn("step", F.expr(step))
        carried = ["prefix", "base", "low_rank", "high_rank", "fraction"]
        finer = finer.groupBy(*by, *carried, "step").agg(*(F.expr(sql).alias(name) for name, sql in _CELL.items()))
        cells = materialise(_wanted(finer, [*group, "prefix"], "step"), "quantile-cells")

    # the few distinct values left inside each cell, with their exact ranks
    inside = _inside(rows, cells, group)
    copies = inside.groupBy(*by, "low", "base", "low_rank", "high_rank", "fraction", "value").agg(
        F.count(F.lit(1)).alias("copies"),
    )
    ordered = Window.partitionBy(*by, "low").orderBy("value")
    last = F.col("base") + F.sum("copies").over(ordered) - 1
    ranked = copies.withColumn("last", last).withColumn("first", F.expr("last - copies + 1"))
    result = (
        ranked.groupBy(*by)
        .agg(
            F.expr("max(value) FILTER (WHERE low_rank BETWEEN first AND last)").alias("low"),
            F.expr("max(value) FILTER (WHERE high_rank BETWEEN first AND last)").alias("high"),
            F.max("fraction").alias("fraction"),
        )
        .withColumn("value", F.expr("CASE WHEN low = high THEN low ELSE low * (1 - fraction) + high * fraction END"))
    )
    # back to one row per group; a group may have no value for some target
    wide = [F.expr(f"max(value) FILTER (WHERE target = {i})").alias(name) for i, name in enumerate(targets)]
    if not keys:
        return result.agg(*wide)
    found = result.groupBy(*(F.col(quote(a)) for a in aliases)).agg(*wide)
    found = found.withColumnsRenamed({a: f"of {a}" for a in aliases})
    match = F.lit(True)
    for alias in aliases:
        match = match & F.col(quote(alias)).eqNullSafe(F.col(quote(f"of {alias}")))
    joined = groups.join(found, match, "left").drop(*(f"of {a}" for a in aliases))
    return joined.withColumnsRenamed(dict(zip(aliases, keys)))


def _wanted(counted: DataFrame, group: Sequence[str], cell: str, keep: str = "false") -> DataFrame:
    """Cells with a wanted rank, or that are to be kept, and what lies before them."""
    ordered = Window.partitionBy(*(F.col(quote(g)) for g in group)).orderBy(F.col(cell).asc_nulls_last())
    placed = counted.withColumn("base", F.col("base") + F.sum("n").over(ordered) - F.col("n"))
    holds = "low_rank BETWEEN base AND base + n - 1 OR high_rank BETWEEN base AND base + n - 1"
    return placed.where(f"{holds} OR {keep}")


def _inside(rows: DataFrame, cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """Values inside the cells of their group, next to the cell.

    ``cells`` has at most two rows per hot group and target and is stored, so the engine knows its
    size and broadcasts it only if it is small.
    """
    listed = cells.drop("step", "empty", "n").withColumnsRenamed({g: f"of {g}" for g in [*group, "prefix"]})
    match = (F.col("prefix") == F.col("of prefix")) & F.expr("value BETWEEN low AND high")
    for g in group:
        match = match & F.col(quote(g)).eqNullSafe(F.col(quote(f"of {g}")))
    return rows.join(listed, match).drop(*(f"of {g}" for g in [*group, "prefix"]))


def array_quantiles(
    frame: DataFrame, column: str, places: Sequence[int], shares: Sequence[float], *, slack: int = 2,
) -> dict[int, np.ndarray]:
    """Exact quantiles of elements of an array of doubles: for each place the smallest value that
    at least a share of the rows does not exceed, for each share.

    A sketch brackets each quantile; one more scan counts what lies between the brackets and, value
    by value, the small share of the rows that lies inside them.  A rank outside of its bracket
    would show in these counts, and is looked for again in a wider one.

    :param column: Array without null or NaN in the given places.
    :param slack: Half the width of a bracket, in ranks of the sketch.
    """
    places = list(places)
    if not places or not shares:
        return {}
    margin = slack / BRACKETS
    found = {}
    for low in range(0, len(places), 100):
        own = places[low : low + 100]
        ends = [e for p in shares for e in (max(0.0, p - margin), min(1.0, p + margin))]
        cells = (F.percentile_approx(F.get(column, F.lit(f)), ends, BRACKETS).alias(str(f)) for f in own)
        row = frame.agg(F.count(F.lit(1)).alias("n"), *cells).first()
        rows = row["n"]
        if not rows:
            found |= {f: np.empty(0) for f in own}
            continue
        brackets = {f: _disjoint(np.array(row[str(f)], dtype=np.float64) + 0.0) for f in own}
        ranks = [max(1, math.ceil(Fraction(p).limit_denominator(1_000_000) * rows)) for p in shares]
        found |= _ranked(frame.select(column), brackets, ranks)
    missed = [f for f, values in found.items() if len(values) and np.isnan(values).any()]
    return found | (array_quantiles(frame, column, missed, shares, slack=slack * 32) if missed else {})


def _disjoint(ends: np.ndarray) -> np.ndarray:
    """Intervals (low, high) in ascending order, of which those that touch are one."""
    merged: list[list[float]] = []
    for low, high in sorted(ends.reshape(-1, 2).tolist()):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return np.array(merged)


def _ranked(frame: DataFrame, brackets: Mapping[int, np.ndarray], ranks: Sequence[int]) -> dict[int, np.ndarray]:
    """Values at the given ranks (from 1) of elements of the only column; NaN where no bracket holds one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {f: np.zeros(2 * len(own) + 1, np.int64) for f, own in brackets.items()}
        inside: dict[int, list[np.ndarray]] = {f: [] for f in brackets}

        def counted(f: int) -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(inside[f]), return_counts=True)
            inside[f].clear()
            cell = 2 * np.searchsorted(brackets[f][:, 1], values, "left") + 1
            return record(f, cell, values, n)

        def record(f: int, cell: np.ndarray, values: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
            own = pa.nulls(len(n), pa.float64()) if values is None else pa.array(values)
            columns = [pa.array(np.full(len(n), f, np.int32)), pa.array(cell.astype(np.int32)), own, pa.array(n)]
            return pa.RecordBatch.from_arrays(columns, ["place", "cell", "value", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for f, own in brackets.items():
                v = x[:, f] + 0.0
                # odd cells are the brackets, even ones lie between them
                cell = np.searchsorted(own[:, 0], v, "right") + np.searchsorted(own[:, 1], v, "left")
                totals[f] += np.bincount(cell, minlength=len(totals[f]))
                inside[f].append(v[cell % 2 == 1])
                if sum(map(len, inside[f])) > BUFFERED:
                    yield counted(f)
        for f in brackets:
            if inside[f]:
                yield counted(f)
            yield record(f, np.arange(len(totals[f])), None, totals[f])

    parts = frame.mapInArrow(count, "place int, cell int, value double, n long")
    parts = parts.groupBy("place", "cell", "value").agg(F.sum("n").alias("n"))
    parts = materialise(parts, "bracketed")
    wanted = []
    totals = {f: np.zeros(2 * len(own) + 1, np.int64) for f, own in brackets.items()}
    for row in parts.where("value IS NULL").collect():  # a row per place and cell
        totals[row["place"]][row["cell"]] = row["n"]
    for f, n in totals.items():
        last = np.cumsum(n)
        for k, rank in enumerate(ranks):
            cell = int(np.searchsorted(last, rank, "left"))
            if cell % 2:
                wanted.append((f, cell, k, int(rank - last[cell] + n[cell])))
    found = {f: np.full(len(ranks), np.nan) for f in brackets}
    if wanted:
        listed = frame.sparkSession.createDataFrame(wanted, "place int, cell int, k int, rank long")
        ordered = Window.partitionBy("place", "cell").orderBy("value")
        values = parts.where("value IS NOT NULL").withColumn("last", F.sum("n").over(ordered))
        values = values.join(F.broadcast(listed), ["place", "cell"]).where("rank <= last AND rank > last - n")
        for row in values.collect():  # a row per place and rank
            found[row["place"]][row["k"]] = row["value"]
    release(parts)
    return found
