"""Finding groups that are too large for one task, and joining around them."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.functions import quote
from featloom.plans.storage import materialise

# Groups up to this many rows are safe inside one task that streams over them.
ROW_LIMIT = 1_000_000

# Up to this many hot keys are broadcast; Spark chooses the join for more of them.
MAX_HOT_GROUPS = 50_000


@dataclasses.dataclass(frozen=True)
class HotGroups:
    """Keys whose groups exceed the row limit, written down."""

    keys: DataFrame
    count: int

    @property
    def listed(self) -> DataFrame:
        """The keys for a join: broadcast as long as they are few."""
        return F.broadcast(self.keys) if self.count <= MAX_HOT_GROUPS else self.keys


def find_hot_groups(
    frame: DataFrame,
    keys: Sequence[str],
    *,
    row_limit: int = ROW_LIMIT,
    counted_in: str | None = None,
) -> HotGroups | None:
    """Keys with more than ``row_limit`` rows, or None if there are none.

    One scan of the key columns (two if something is hot); the count is combined before the
    shuffle, so a key that holds most of the rows costs nothing extra.  The limit does not
    depend on the table.

    :param counted_in: Column with the number of rows that each row of ``frame`` stands for.
    """
    rows = quote("rows in group")
    size = F.count(F.lit(1)) if counted_in is None else F.sum(quote(counted_in))
    counted = frame.groupBy(*(F.col(quote(k)) for k in keys)).agg(size.alias("rows in group"))
    hot = counted.where(F.col(rows) > row_limit)
    count = hot.count()
    if not count:  # the usual case writes nothing
        return None
    return HotGroups(keys=materialise(hot, "hot-keys").drop("rows in group"), count=count)


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str], *, null_safe: bool = False):
    """Join condition on equally named keys."""
    condition = F.lit(True)
    for key in keys:
        x, y = left[quote(key)], right[quote(key)]
        condition = condition & (x.eqNullSafe(y) if null_safe else (x == y))
    return condition


def split_left_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    row_limit: int = ROW_LIMIT,
    checked_rows: int | None = None,
) -> DataFrame:
    """``left LEFT JOIN right`` where ``right`` has at most one row per key.

    If some key holds more left rows than one task should see, the left side is split
    into three disjoint parts: rows with a null key (they match nothing and need no
    shuffle), rows with a hot key, and the rest (an ordinary shuffled join without heavy
    keys).  The right side is written down first, so its plan runs once, and the size of its
    rows with hot keys is known: Spark broadcasts them if they are small, however wide they
    are, and otherwise splits the large partitions of a shuffled join.

    :param checked_rows: Known upper bound of the number of left rows, if any.
    """
    keys = list(keys)
    hot = None
    if checked_rows is None or checked_rows > row_limit:
        hot = find_hot_groups(left, keys, row_limit=row_limit)
    if hot is None:
        return left.join(right, on=keys, how="left")

    some_null = F.lit(False)
    for key in keys:
        some_null = some_null | F.col(quote(key)).isNull()

    hot_keys = hot.listed.where(~some_null)
    present = left.where(~some_null)
    right = materialise(right, "right-side")
    hot_right = materialise(right.join(hot_keys, on=keys, how="left_semi"), "hot-right-side")

    width = [f for f in right.schema.fields if f.name not in keys]
    unmatched = left.where(some_null).select(
        *(F.col(quote(k)) for k in keys),
        *(F.col(quote(c)) for c in left.columns if c not in keys),
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in width),
    )
    heavy = present.join(hot_keys, on=keys, how="left_semi").join(hot_right, on=keys, how="left")
    light = present.join(hot_keys, on=keys, how="left_anti").join(right, on=keys, how="left")
    return light.unionByName(heavy).unionByName(unmatched)


def first_duplicate(frame: DataFrame, keys: Sequence[str], *, ignore_nulls: bool = False):
    """One key that occurs more than once, or None."""
    if ignore_nulls:
        frame = frame.where(" AND ".join(f"{quote(k)} IS NOT NULL" for k in keys))
    counted = frame.groupBy(*(F.col(quote(k)) for k in keys)).agg(F.count(F.lit(1)).alias("rows in group"))
    return counted.where(F.col("`rows in group`") > 1).drop("rows in group").first()
