"""Row filters: boolean branches and recency."""

from __future__ import annotations

import dataclasses
import datetime
from collections.abc import Collection, Iterable

from pyspark.sql import types as T

from featloom.functions import literal
from featloom.operators.compose import Transform
from featloom.schema import Attribute, Table


@dataclasses.dataclass(frozen=True)
class Filter(Transform):
    """Split every table by each complete boolean column, once per truth value."""

    def apply(self, tables: Iterable[Table]) -> Iterable[Table]:
        for table in tables:
            for column in table.columns:
                if column.has(Attribute.boolean, Attribute.not_null):
                    holds = table.expr(column)
                    yield table.restrict(holds, name=f"filter({table.name}, {column.name})")
                    yield table.restrict(f"NOT ({holds})", name=f"filter({table.name}, not({column.name}))")


@dataclasses.dataclass(frozen=True, kw_only=True)
class Window(Transform):
    """Keep only recent rows: one table per period and temporal column.

    :param periods: How far to look back.
    :param as_of: Point in time to look back from (UTC); now, unless given.
    """

    periods: Collection[datetime.timedelta]
    as_of: datetime.datetime | None = None

    def apply(self, tables: Iterable[Table]) -> Iterable[Table]:
        now = self.as_of or datetime.datetime.now(datetime.timezone.utc)
        if now.tzinfo is not None:
            now = now.astimezone(datetime.timezone.utc).replace(tzinfo=None)

        for table in tables:
            schema = table.data.schema
            temporal = [
                c
                for c in table.columns
                if c.has(Attribute.temporal)
                and isinstance(schema[c.name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
            ]
            for period in self.periods:
                for column in temporal:
                    start = now - period
                    if isinstance(schema[column.name].dataType, T.TimestampType):
                        start = start.replace(tzinfo=datetime.timezone.utc)
                    suffix = f", {column.name}" if len(temporal) > 1 else ""
                    yield table.restrict(
                        f"{table.expr(column)} >= {literal(start)}",
                        name=f"window({table.name}, {period}{suffix})",
                    )
