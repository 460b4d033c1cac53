"""Positions in a total order without ever sorting in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featloom.plans.storage import materialise

PART = "part of order"


def ordered_parts(frame: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partition by ``order`` and record the part each row belongs to.

    All rows of part *i* come before all rows of part *i + 1*.  The result is written to
    the shared folder, so the part numbers are data and stay the same in every later job.
    """
    parts = frame.repartitionByRange(*order).withColumn(PART, F.spark_partition_id())
    return materialise(parts, "ordered")


def part_offsets(parts: DataFrame, weight: Column | None = None) -> dict[int, int]:
    """Total weight before each part.  One row per part reaches the driver, never data rows."""
    weight = F.lit(1) if weight is None else weight
    totals = sorted(parts.groupBy(quote_part()).agg(F.sum(weight).alias("w")).collect())
    offsets, running = {}, 0
    for part, total in totals:
        offsets[part] = running
        running += total
    return offsets


def quote_part() -> Column:
    return F.col(f"`{PART}`")


def running_total(frame: DataFrame, order: Sequence[Column], weight: str, name: str) -> DataFrame:
    """Add the sum of ``weight`` over all rows that come earlier in a total order.

    ``order`` must be unique (group equal values first), which also keeps the parts even.
    """
    parts = ordered_parts(frame, order)
    offsets = part_offsets(parts, F.col(weight))
    before = frame.sparkSession.createDataFrame(list(offsets.items()), f"`{PART}` int, `offset of part` long")
    earlier = Window.partitionBy(quote_part()).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.join(F.broadcast(before), PART)
        .withColumn(name, F.col("`offset of part`") + F.coalesce(F.sum(weight).over(earlier), F.lit(0)))
        .drop(PART, "offset of part")
    )


def ordered_split(frame: DataFrame, order: Sequence[Column], share: float, name: str) -> DataFrame:
    """Add a boolean column that is true for the first ``floor(share * n)`` rows.

    Only the one part that holds the cut is ranked; all other parts lie on one side of it.
    """
    tie = F.monotonically_increasing_id()
    parts = ordered_parts(frame.withColumn("tie of order", tie), [*order, F.col("`tie of order`")])
    sizes = sorted(parts.groupBy(quote_part()).count().collect())
    total = sum(size for _, size in sizes)
    cut = int(share * total + 1e-9)

    running, split_part, inside = 0, -1, 0
    for part, size in sizes:
        if running <= cut < running + size:
            split_part, inside = part, cut - running
        running += size

    before = parts.where(quote_part() != split_part).withColumn(
        name,
        (quote_part() < split_part) if split_part >= 0 else F.lit(True),
    )
    within = Window.partitionBy(quote_part()).orderBy(*order, F.col("`tie of order`"))
    at_cut = parts.where(quote_part() == split_part).withColumn(name, F.row_number().over(within) <= inside)
    return before.unionByName(at_cut).drop(PART, "tie of order")
