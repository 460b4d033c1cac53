"""One aggregate plan for many feature tables over the same frame and key."""

from __future__ import annotations

import dataclasses
import sys
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.functions import quote
from featloom.plans.groupscan import LIMB_BITS, scan_groups, scannable
from featloom.plans.profile import is_floating
from featloom.plans.quantiles import default_row_limit, hot_quantiles, percentile_sql, sketch_sql, split_by_heat
from featloom.plans.skew import HotGroups, find_hot_groups
from featloom.plans.storage import materialise

# Result columns up to which one aggregate with FILTER clauses stays in generated code.  More
# slices are aggregated one below the other instead: same scan, shuffle and results.
FILTER_COLUMNS = 100

# Rows of a group of several grouping sets from which on it costs less to merge counts by all keys, once
# for all sets, than to shuffle a copy of its rows per set.
SET_ROWS = 1 << 19

# Column with the number of the grouping set.
GROUPING_SET = "grouping set"

# Statistics per numeric column, in the order in which feature tables list them.
STATISTICS = ("max", "mean", "median", "min", "std", "sum", "var")


@dataclasses.dataclass(frozen=True)
class Slice:
    """Rows to aggregate (None = all rows) under a prefix for the result columns."""

    prefix: str
    where: str | None


def statistic(prefix: str, kind: str, column: str) -> str:
    """Physical name of a statistic in the result of :func:`grouped_statistics`."""
    return f"{prefix}{kind}({column})"


def row_count(prefix: str) -> str:
    return f"{prefix}count(*)"


def grouped_statistics(
    frame: DataFrame,
    keys: Mapping[str, str],
    values: Mapping[str, str],
    slices: Sequence[Slice],
    *,
    row_limit: int | None = None,
    checked_rows: int | None = None,
    sets: Sequence[Collection[str]] | None = None,
    exact: bool = True,
) -> DataFrame:
    """Row count and all statistics of each value column, per key and slice of the rows.

    Any number of slices costs one scan and one shuffle: few of them are FILTER clauses of
    one aggregate, many are told apart behind the shuffle by grouping on the slice as well.

    While every group fits into a task the rows are shuffled once by key and aggregated
    there completely: partial medians save nothing and would force a sort on both sides.
    Plain numbers are sorted by key and aggregated many groups and slices at a time on Arrow
    batches (``groupscan.py``), other types by built-in aggregates.
    If some group is too large, everything but the medians is combined before the
    shuffle, and the medians of the large groups are found by radix selection.

    Several sets of keys are grouping sets: a row is repeated per set behind the one scan, with
    the number of the set in ``GROUPING_SET`` and null for the keys that the set lacks, which that
    number tells from null keys.  Rows are only repeated for the groups that fit into a task; for large
    ones partial results by all keys are.

    Without ``exact`` the medians are those of mergeable sketches, so every statistic is combined
    before the shuffle, whatever the size of a group; ranks err by ``SKETCH_ERROR`` of its rows.

    :param keys: Key name → SQL expression over ``frame``.
    :param values: Column name → SQL expression over ``frame``.
    :param slices: Row subsets, as SQL predicates over ``frame``.
    :param row_limit: Largest group whose medians one task may compute.
    :param checked_rows: Known upper bound of the number of rows, if any.
    :param sets: Sets of key names to group by; all keys together if absent.
    :param exact: Whether medians are exact.
    """
    key_names = list(keys)
    rows = frame.selectExpr(
        *(f"{sql} AS {quote(name)}" for name, sql in keys.items()),
        *(f"{sql} AS {quote(f'value {i}')}" for i, sql in enumerate(values.values())),
        *(f"({s.where}) AS {quote(f'slice {j}')}" for j, s in enumerate(slices) if s.where is not None),
    )
    kinds = [rows.schema[f"value {i}"].dataType for i in range(len(values))]
    all_keys, given = key_names, rows
    if sets is not None:
        sets = [{all_keys.index(k) for k in chosen} for chosen in sets]
        rows = _repeated(rows, all_keys, sets)
        key_names = [GROUPING_SET, *all_keys]
        checked_rows = None if checked_rows is None else checked_rows * len(sets)
    by = [F.col(quote(k)) for k in key_names]

    simple, finished, medians = [], [], {}
    for j, piece in enumerate(slices):
        chosen = None if piece.where is None else quote(f"slice {j}")
        condition = f" FILTER (WHERE {chosen})" if chosen else ""
        simple.append(F.expr(f"count(1){condition}").alias(row_count(piece.prefix)))
        finished.append(quote(row_count(piece.prefix)))
        for i, (column, kind) in enumerate(zip(values, kinds)):
            x = quote(f"value {i}")
            simple += _raw_statistics(x, kind, condition, f"{j} {i}")
            finished += _derived_statistics(piece.prefix, column, kind, f"{j} {i}")
            sliced = f"CASE WHEN {chosen} THEN {x} END" if chosen else x
            medians[statistic(piece.prefix, "median", column)] = (sliced, 0.5)

    row_limit = row_limit or min(default_row_limit(len(medians)), SET_ROWS if sets else sys.maxsize)
    hot = None
    if exact and medians and (checked_rows is None or checked_rows > row_limit):
        if sets is None:
            hot = find_hot_groups(rows, key_names, row_limit=row_limit)
        else:
            sizes = given.groupBy(*(F.col(quote(k)) for k in all_keys)).agg(F.count(F.lit(1)).alias("rows of keys"))
            sizes = materialise(sizes, "group-sizes")
            hot = find_hot_groups(_repeated(sizes, all_keys, sets), key_names, row_limit=row_limit, counted_in="rows of keys")

    def complete(part: DataFrame) -> DataFrame:
        if scannable(part, key_names, kinds):
            scanned = scan_groups(part, key_names, kinds, [None if p.where is None else f"slice {j}" for j, p in enumerate(slices)])
            if len(scanned.columns) > FILTER_COLUMNS:
                scanned = materialise(scanned, "slices")
            names = {f"rows {j}": row_count(p.prefix) for j, p in enumerate(slices)}
            names |= {f"median {j} {i}": statistic(p.prefix, "median", c) for j, p in enumerate(slices) for i, c in enumerate(values)}
            return scanned.withColumnsRenamed(names)
        if len(slices) * (1 + len(STATISTICS) * len(values)) > FILTER_COLUMNS and len(slices) > 1:
            return _by_slice(part.repartition(*by), key_names, list(values), kinds, slices)
        builtin = [F.expr(percentile_sql(sql, p)).alias(name) for name, (sql, p) in medians.items()]
        return part.repartition(*by).groupBy(*by).agg(*simple, *builtin)

    if not exact:
        sketched = [F.expr(sketch_sql(sql, p)).alias(name) for name, (sql, p) in medians.items()]
        grouped = rows.groupBy(*by).agg(*simple, *sketched)
    elif not medians:
        grouped = rows.groupBy(*by).agg(*simple)
    elif hot is None:
        grouped = complete(rows)
    else:
        if sets is None:
            heavy, light = split_by_heat(rows, key_names, hot)
            cold = complete(light)
            combined = heavy.groupBy(*by).agg(*simple)
            found = hot_quantiles(heavy, key_names, medians, row_limit=row_limit)
        else:
            def expand(part: DataFrame, names: list[str]) -> DataFrame:
                return _of_hot_groups(_repeated(part, names[1:], sets, names[0]), names, hot)

            cold = complete(_light_rows(given, sizes, all_keys, sets, hot))
            combined = _merged(given, all_keys, kinds, slices, lambda part: expand(part, key_names))
            combined = combined.select(*(F.col(quote(c)).cast(cold.schema[c].dataType).alias(c) for c in combined.columns))
            found = hot_quantiles(given, key_names, medians, row_limit=row_limit, expand=expand)
        found = found.withColumnsRenamed({k: f"of {k}" for k in key_names})
        match = F.lit(True)
        for key in key_names:
            match = match & F.col(quote(key)).eqNullSafe(F.col(quote(f"of {key}")))
        # one row per hot group on both sides; the engine broadcasts what is small
        grouped = cold.unionByName(combined.join(found, match).drop(*(f"of {k}" for k in key_names)))

    return grouped.selectExpr(
        *(quote(k) for k in key_names),
        *finished,
        *(quote(name) for name in medians),
    )


def _repeated(
    rows: DataFrame, keys: Sequence[str], sets: Sequence[Collection[int]], name: str = GROUPING_SET, numbers: str | None = None,
) -> DataFrame:
    """Every row once per set of keys; keys outside of the set are null.

    :param sets: Positions of keys.
    :param numbers: Column with the numbers of the sets that a row is wanted in; all if absent.
    """
    number = quote(name)
    wanted = F.array(*(F.lit(j) for j in range(len(sets)))) if numbers is None else F.col(quote(numbers))
    rows = rows.select("*", F.explode(wanted).alias(name))
    inside = {k: ", ".join(str(j) for j, chosen in enumerate(sets) if i in chosen) or "NULL" for i, k in enumerate(keys)}
    return rows.selectExpr(
        number,
        *(f"CASE WHEN {number} IN ({inside[k]}) THEN {quote(k)} END AS {quote(k)}" for k in keys),
        *(quote(c) for c in rows.columns if c not in (*keys, name, numbers)),
    )


def _of_hot_groups(rows: DataFrame, keys: Sequence[str], hot: HotGroups, how: str = "left_semi") -> DataFrame:
    """Repeated rows in hot groups, or in the others; keys in the order of those of ``hot``."""
    listed = hot.listed.toDF(*(f"hot {i}" for i in range(len(keys))))
    match = F.lit(True)
    for i, key in enumerate(keys):
        match = match & F.col(quote(key)).eqNullSafe(F.col(quote(f"hot {i}")))
    return rows.join(listed, match, how)


def _light_rows(
    rows: DataFrame, sizes: DataFrame, keys: Sequence[str], sets: Sequence[Collection[int]], hot: HotGroups,
) -> DataFrame:
    """Rows once per set in which their group is not hot.  Which sets these are follows from the keys."""
    own = [f"own {i}" for i in range(len(keys))]
    named = sizes.select(*(F.col(quote(k)) for k in keys), *(F.col(quote(k)).alias(o) for k, o in zip(keys, own)))
    light = _of_hot_groups(_repeated(named, keys, sets), [GROUPING_SET, *keys], hot, "left_anti")
    light = light.groupBy(*own).agg(F.collect_list(GROUPING_SET).alias("light sets"))
    light = materialise(light, "light-keys")
    match = F.lit(True)
    for key, o in zip(keys, own):
        match = match & F.col(quote(key)).eqNullSafe(F.col(quote(o)))
    return _repeated(rows.join(light, match).drop(*own), keys, sets, numbers="light sets")


def _merged(rows: DataFrame, keys: Sequence[str], kinds: Sequence[T.DataType], slices: Sequence[Slice], expand) -> DataFrame:
    """Everything but the medians, for groups that ``expand`` makes of groups by all keys.

    Sums of squares are merged around the mean of the group, so that nothing cancels out.
    """
    parts, tags, sums = [], [], {}
    for j, piece in enumerate(slices):
        condition = "" if piece.where is None else f" FILTER (WHERE {quote(f'slice {j}')})"
        parts.append(F.expr(f"count(1){condition}").alias(row_count(piece.prefix)))
        sums[row_count(piece.prefix)] = "sum"
        for i, kind in enumerate(kinds):
            tag, x = f"{j} {i}", quote(f"value {i}")
            wide = f"CAST({x} AS DOUBLE)"
            parts += _raw_statistics(x, kind, condition, tag)[:-1]
            parts.append(F.expr(f"avg({wide}){condition}").alias(f"mean {tag}"))
            parts.append(F.expr(f"var_pop({wide}){condition} * count({x}){condition}").alias(f"squares {tag}"))
            sums |= {f"n {tag}": "sum", f"sum {tag}": "sum", f"max {tag}": "max", f"min {tag}": "min"}
            tags.append(tag)
    part = materialise(rows.groupBy(*(F.col(quote(k)) for k in keys)).agg(*parts), "partial-statistics")
    groups = expand(part)
    by = groups.columns[: 1 + len(keys)]
    means = (F.expr(f"sum(`n {t}` * `mean {t}`) / nullif(sum(`n {t}`), 0)").alias(f"centre {t}") for t in tags)
    centres = groups.groupBy(*(F.col(quote(k)) for k in by)).agg(*means)
    centres = centres.withColumnsRenamed({k: f"of {k}" for k in by})
    match = F.lit(True)
    for key in by:
        match = match & F.col(quote(key)).eqNullSafe(F.col(quote(f"of {key}")))
    spread = groups.join(centres, match).groupBy(*(F.col(quote(k)) for k in by))
    merged = [F.expr(f"{how}({quote(name)})").alias(name) for name, how in sums.items()]
    var = "sum(`squares {t}` + `n {t}` * (`mean {t}` - `centre {t}`) * (`mean {t}` - `centre {t}`)) / (sum(`n {t}`) - 1)"
    merged += [F.expr(f"CASE WHEN sum(`n {t}`) > 1 THEN {var.format(t=t)} END").alias(f"var {t}") for t in tags]
    return spread.agg(*merged)


def _by_slice(
    rows: DataFrame,
    keys: list[str],
    columns: list[str],
    kinds: list[T.DataType],
    slices: Sequence[Slice],
) -> DataFrame:
    """The columns of the FILTER form, from rows that are partitioned by key already.

    Rows are repeated per slice inside their task; both aggregates reuse the partitioning.
    """
    numbers = (f"CASE WHEN {quote(f'slice {j}')} THEN {j} END" if s.where is not None else str(j) for j, s in enumerate(slices))
    own = F.expr(f"explode(filter(array({', '.join(numbers)}), j -> j IS NOT NULL))").alias("of slice")
    long = rows.select(*(quote(k) for k in keys), *(f"value {i}" for i in range(len(columns))), own)
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, kind in enumerate(kinds):
        parts += _raw_statistics(quote(f"value {i}"), kind, "", str(i))
        parts.append(F.expr(percentile_sql(quote(f"value {i}"), 0.5)).alias(f"median {i}"))
    stats = long.groupBy(*(quote(k) for k in keys), "of slice").agg(*parts)
    names = [c for c in stats.columns if c not in (*keys, "of slice")]
    entry = f"struct({', '.join(quote(n) for n in names)})"
    entries = [F.expr(f"any_value(CASE WHEN `of slice` = {j} THEN {entry} END, true)").alias(f"entry {j}") for j in range(len(slices))]
    # written down: planning hundreds of columns over the aggregates takes longer than computing them
    entries = materialise(stats.groupBy(*(quote(k) for k in keys)).agg(*entries), "slices")
    wide = []
    for j, piece in enumerate(slices):
        def of(name: str, j: int = j) -> str:
            return f"{quote(f'entry {j}')}.{quote(name)}"

        wide.append(f"coalesce({of('rows')}, 0L) AS {quote(row_count(piece.prefix))}")
        for i, column in enumerate(columns):
            wide.append(f"coalesce({of(f'n {i}')}, 0L) AS {quote(f'n {j} {i}')}")
            wide += [f"{of(f'{part} {i}')} AS {quote(f'{part} {j} {i}')}" for part in ("sum", "max", "min", "var")]
            wide.append(f"{of(f'median {i}')} AS {quote(statistic(piece.prefix, 'median', column))}")
    return entries.selectExpr(*(quote(k) for k in keys), *wide)


def _raw_statistics(x: str, kind: T.DataType, condition: str, tag: str):
    """The sums that all statistics of a column can be derived from."""
    ordered = f"nanvl({x}, NULL)" if is_floating(kind) else x
    wide = f"CAST({x} AS DOUBLE)"
    parts = {"n": f"count({x})", "sum": f"sum({x})", "max": f"max({ordered})", "min": f"min({ordered})"}
    parts["var"] = f"var_samp({wide})"
    sums = {part: sql + condition for part, sql in parts.items()}
    if isinstance(kind, T.LongType):
        sums["sum"] = _wide_sum(x, condition)
    return [F.expr(sql).alias(f"{part} {tag}") for part, sql in sums.items()]


def _wide_sum(x: str, condition: str) -> str:
    """Sum of BIGINT values, which may exceed BIGINT, from sums of three limbs that cannot.

    Limbs of 21 bits leave room for 2**42 rows; they are put together behind the aggregate.
    """
    low = (1 << LIMB_BITS) - 1
    limbs = (f"shiftright({x}, {2 * LIMB_BITS})", f"shiftright({x}, {LIMB_BITS}) & {low}L", f"{x} & {low}L")
    worth = (1 << 2 * LIMB_BITS, 1 << LIMB_BITS, 1)
    return " + ".join(f"CAST(sum({limb}){condition} AS DECIMAL(38, 0)) * {w}BD" for limb, w in zip(limbs, worth))


def _derived_statistics(prefix: str, column: str, kind: T.DataType, tag: str) -> list[str]:
    n, total, var = (quote(f"{part} {tag}") for part in ("n", "sum", "var"))
    zero = f"coalesce({total}, 0BD)" if isinstance(kind, (T.DecimalType, T.LongType)) else f"coalesce({total}, 0)"
    derived = {
        "max": quote(f"max {tag}"),
        "mean": f"CAST({total} AS DOUBLE) / nullif({n}, 0)",
        "min": quote(f"min {tag}"),
        "std": f"sqrt({var})",
        "sum": zero,
        "var": var,
    }
    return [f"{sql} AS {quote(statistic(prefix, part, column))}" for part, sql in derived.items()]
