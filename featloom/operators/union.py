"""Stacking tables with equal columns."""

from __future__ import annotations

import dataclasses
import functools
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.functions import quote
from featloom.operators.compose import Transform
from featloom.schema import Attribute, Column, Table


@dataclasses.dataclass(frozen=True)
class Union(Transform):
    """Stack all tables that have the same set of column names, keeping every row."""

    def apply(self, tables: Iterable[Table]) -> Iterable[Table]:
        groups: dict[frozenset[str], list[Table]] = defaultdict(list)
        for table in tables:
            groups[frozenset(c.name for c in table.columns)].append(table)
        return [group[0] if len(group) == 1 else _stacked(group) for group in groups.values()]


def _stacked(group: list[Table]) -> Table:
    names = [c.name for c in group[0].columns]
    columns = []
    for name in names:
        parents = [(t.column(name), t.name) for t in group]
        common = frozenset.intersection(*(c.attributes for c, _ in parents))
        # unique in each part does not mean unique in the whole
        columns.append(
            Column(name=name, attributes=common - {Attribute.primary_key}, derived_from=parents),
        )

    schemas = [t.data.schema for t in group]
    parts = [t.data.select(*(F.col(quote(n)) for n in names)) for t in group]
    for name in names:
        kinds = {schema[name].dataType for schema in schemas}
        if len(kinds) > 1 and any(isinstance(kind, T.StringType) for kind in kinds):
            parts = [p.withColumn(name, F.col(quote(name)).cast("string")) for p in parts]

    bounds = [t.max_rows for t in group]
    return Table(
        name=f"union({', '.join(t.name for t in group)})",
        columns=columns,
        data=functools.reduce(lambda a, b: a.unionByName(b), parts),
        max_rows=None if None in bounds else sum(bounds),
    )
