"""Casting columns to the types that their values suggest."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.functions import quote
from featloom.operators.compose import Transform
from featloom.schema import Attribute, Column, Table

# Shapes of the texts that count as dates, timestamps and times of day.
DATE_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIMESTAMP_SHAPE = r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?$"
ZONED_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})$"
TIME_SHAPE = r"^[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?$"

_INTEGERS = (
    (T.ByteType(), -(2**7), 2**7 - 1),
    (T.ShortType(), -(2**15), 2**15 - 1),
    (T.IntegerType(), -(2**31), 2**31 - 1),
)


@dataclasses.dataclass(frozen=True, kw_only=True)
class Cast(Transform):
    """Turn texts into dates, timestamps or times, and 0/1 numbers into booleans.

    A column is cast only if *every* one of its values allows it, which one aggregate per
    table decides; nothing is decided from a sample.

    :param shrink: Also give integers the smallest type that holds all their values.
    """

    shrink: bool = False

    def apply(self, tables: Iterable[Table]) -> Iterable[Table]:
        return [self._cast(table) for table in tables]

    def _cast(self, table: Table) -> Table:
        schema = table.data.schema
        checks: dict[str, str] = {}
        for i, column in enumerate(table.columns):
            x = quote(column.name)
            if column.has(Attribute.textual, Attribute.not_null):
                for kind, (_, parsed) in _parsers(x).items():
                    checks[f"{kind} {i}"] = f"count({parsed})"
            elif column.has(Attribute.numeric):
                if column.has(Attribute.not_null):
                    checks[f"other {i}"] = f"count_if({x} IS NULL OR {x} NOT IN (0, 1))"
                    checks[f"min {i}"], checks[f"max {i}"] = f"min({x})", f"max({x})"
                elif self.shrink:
                    checks[f"min {i}"], checks[f"max {i}"] = f"min({x})", f"max({x})"
        if not checks:
            return table
        facts = table.data.agg(
            F.expr("count(1)").alias("rows"),
            *(F.expr(sql).alias(name) for name, sql in checks.items()),
        ).first()

        derived = []
        for i, column in enumerate(table.columns):
            kind = schema[column.name].dataType
            derived.append(self._decide(table, column, kind, i, facts))
        return table.derive(derived)

    def _decide(self, table: Table, column: Column, kind: T.DataType, i: int, facts) -> tuple[Column, str]:
        x = table.expr(column)
        rows = facts["rows"]

        def becomes(*attributes: Attribute) -> Column:
            return Column(name=column.name, attributes=attributes, derived_from=[(column, table.name)])

        if rows and f"date {i}" in facts:
            for name, (cast, _) in _parsers(x).items():
                if facts[f"{name} {i}"] == rows:
                    if name == "time":
                        # the TIME type of Spark 4.1 is off by default
                        table.frame.sparkSession.conf.set("spark.sql.timeType.enabled", "true")
                    return becomes(Attribute.temporal), cast

        if f"min {i}" in facts:
            low, high = facts[f"min {i}"], facts[f"max {i}"]
            if rows and f"other {i}" in facts and not facts[f"other {i}"] and (low, high) == (0, 1):
                flags = (Attribute.boolean, Attribute.categorical, Attribute.not_null)
                return becomes(*flags), f"CAST({x} AS BOOLEAN)"
            if self.shrink and low is not None and isinstance(kind, T.IntegralType):
                for smaller, least, greatest in _INTEGERS:
                    if least <= low and high <= greatest:
                        return column, f"CAST({x} AS {smaller.simpleString()})"
        return column, x


def _parsers(x: str) -> dict[str, tuple[str, str]]:
    """For each kind of text: the cast, and an expression that is null where it fails.

    A plain cast would also read "2021" as a date, so the shape is checked first.
    """
    date = f"CASE WHEN {x} RLIKE r'{DATE_SHAPE}' THEN try_cast({x} AS DATE) END"
    stamp = f"CASE WHEN {x} RLIKE r'{TIMESTAMP_SHAPE}' THEN try_cast(replace({x}, '/', '-') AS TIMESTAMP_NTZ) END"
    zoned = f"CASE WHEN {x} RLIKE r'{ZONED_SHAPE}' THEN try_cast({x} AS TIMESTAMP) END"
    on_a_day = f"try_cast(concat('1970-01-01 ', {x}) AS TIMESTAMP_NTZ)"
    time = f"CASE WHEN {x} RLIKE r'{TIME_SHAPE}' THEN {on_a_day} END"
    return {
        "date": (date, date),
        "timestamp": (stamp, stamp),
        "zoned": (zoned, zoned),
        "time": (f"CAST({x} AS TIME)", time),
    }
