"""Key joins between tables."""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Iterable

from pyspark.sql import functions as F

from featloom.functions import quote
from featloom.operators.compose import Transform
from featloom.plans.skew import ROW_LIMIT, first_duplicate, split_left_join
from featloom.schema import Table


@dataclasses.dataclass(frozen=True, kw_only=True)
class Join(Transform):
    """Left-join every pair of tables where one holds the primary key of the other.

    A pair is skipped if the name of one table contains the name of the other: the one
    may already be made from the other.

    :param row_limit: Largest number of rows with one key that one task should join.
    """

    row_limit: int = ROW_LIMIT

    def apply(self, tables: Iterable[Table]) -> Iterable[Table]:
        for x, y in itertools.combinations(list(tables), 2):
            if x.name in y.name or y.name in x.name:
                continue
            if _covers(x, y):
                yield self._joined(x, y)
            elif _covers(y, x):
                yield self._joined(y, x)

    def _joined(self, left: Table, right: Table) -> Table:
        key = right.key
        added = [c for c in right.columns if not left.has(c.name)]
        if not right.is_unique and (duplicate := first_duplicate(right.data, key, ignore_nulls=True)):
            raise ValueError(f"the key of table {right.name} is not unique: {duplicate} repeats")
        data = split_left_join(
            left.data,
            right.data.select(*(F.col(quote(n)) for n in [*key, *(c.name for c in added)])),
            key,
            row_limit=self.row_limit,
            checked_rows=left.max_rows,
        )
        return Table(
            name=f"join({left.name}, {right.name})",
            columns=[*left.columns, *added],
            data=data,
            unique_on=left.unique_on,
            max_rows=left.max_rows,
        )


def _covers(x: Table, y: Table) -> bool:
    return bool(y.key) and all(x.has(name) for name in y.key)
