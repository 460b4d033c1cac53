"""One-hot encoding and imputation."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.functions import display, literal, quote
from featloom.operators.compose import Transform
from featloom.plans.dictionary import dictionary, with_ids
from featloom.plans.profile import is_profiled
from featloom.schema import Attribute, Column, Table

_DUMMY = frozenset({Attribute.boolean, Attribute.categorical, Attribute.not_null})


@dataclasses.dataclass(frozen=True, kw_only=True)
class Encode(Transform):
    """Add a boolean column per category of each categorical column.

    Textual sources stay, behind the untouched columns; other sources stay in place.  A column of
    more categories than ``max_columns`` gets one column instead, with the number of its
    category in a dictionary (see ``plans.dictionary``): sorted, from 0, null for null.

    :param max_columns: Most dummies of one column.
    """

    max_columns: int = 10_000

    def apply(self, tables: Iterable[Table]) -> Iterable[Table]:
        return [self._encode(table) for table in tables]

    def _encode(self, table: Table) -> Table:
        schema = table.data.schema
        sources = [
            c
            for c in table.columns
            if c.has(Attribute.categorical) and is_profiled(schema[c.name].dataType)
        ]
        if not sources:
            return table

        encoded: list[tuple[Column, str]] = []
        numbered: dict[str, tuple[str, DataFrame]] = {}
        for column, categories in zip(sources, self._categories(table, sources, schema)):
            x = table.expr(column)
            if column.has(Attribute.textual):
                moved = dataclasses.replace(column, derived_from=[(column, table.name)])
                encoded.append((moved, x))
            if categories is None:
                number = Column(
                    name=f"id({column})",
                    attributes={Attribute.numeric} | (column.attributes & {Attribute.not_null}),
                    derived_from=[(column, table.name)],
                )
                # the numbers hold for the rows of this table, whatever its frame has besides
                known = dictionary(table.data, quote(column.name))
                numbered[number.name] = (x if table.where is None else f"CASE WHEN {table.where} THEN {x} END", known)
                encoded.append((number, quote(number.name)))
                continue
            for value in categories:
                dummy = Column(
                    name=f"{column} == {display(value)}",
                    attributes=_DUMMY,
                    derived_from=[(column, table.name)],
                )
                encoded.append((dummy, f"({x} = {_typed(value, schema[column.name].dataType)})"))

        replaced = {column.name for column, _ in encoded}
        untouched = [(c, table.expr(c)) for c in table.columns if c.name not in replaced]
        if not numbered:
            return table.derive([*untouched, *encoded])
        return Table(
            name=table.name,
            columns=[column for column, _ in [*untouched, *encoded]],
            data=with_ids(table.frame, numbered),
            exprs={column.name: sql for column, sql in [*untouched, *encoded]},
            where=table.where,
            unique_on=table.unique_on,
            max_rows=table.max_rows,
            pairs=table.pairs,
        )

    def _categories(self, table: Table, sources: list[Column], schema: T.StructType) -> list[list | None]:
        """Sorted distinct values of all categorical columns, from one scan; None if they are too many.

        Values are made distinct before and after a single shuffle by ordinary hash
        aggregation, which spills; only categories that become columns reach the driver.
        """
        pairs = ", ".join(
            f"named_struct('source', {i}, 'value', CAST({quote(c.name)} AS STRING))"
            for i, c in enumerate(sources)
        )
        distinct = table.data.selectExpr(f"inline(array({pairs}))").where("value IS NOT NULL").distinct()
        limit = self.max_columns + 1
        ranked = distinct.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("value")))

        values: list[list] = [[] for _ in sources]
        for row in ranked.where(F.col("place") <= limit).collect():
            kind = schema[sources[row["source"]].name].dataType
            values[row["source"]].append(_parse(row["value"], kind))
        return [None if len(v) == limit else sorted(set(v)) for v in values]


def _typed(value: object, kind: T.DataType) -> str:
    """Literal of the type of the column: a wider one would not equal a FLOAT."""
    return literal(value) if isinstance(kind, T.StringType) else f"CAST({literal(value)} AS {kind.simpleString()})"


def _parse(text: str, kind: T.DataType):
    """Read back a value that Spark has written as text."""
    if isinstance(kind, T.BooleanType):
        return text == "true"
    if isinstance(kind, T.IntegralType):
        return int(text)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(text)
    if isinstance(kind, T.NumericType):
        return float(text)
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(text)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.datetime.fromisoformat(text)
    return text


@dataclasses.dataclass(frozen=True)
class Impute(Transform):
    """Replace nulls by 0 in numeric columns and by false in boolean ones.  NaN stays."""

    def apply(self, tables: Iterable[Table]) -> Iterable[Table]:
        for table in tables:
            yield table.derive([self._impute(table, column) for column in table.columns])

    @staticmethod
    def _impute(table: Table, column: Column) -> tuple[Column, str]:
        x = table.expr(column)
        if column.has(Attribute.numeric):
            filled = f"coalesce({x}, 0)"
        elif column.has(Attribute.boolean):
            filled = f"coalesce({x}, false)"
        else:
            return column, x
        complete = Column(
            name=column.name,
            attributes=column.attributes | {Attribute.not_null},
            derived_from=[(column, table.name)],
        )
        return complete, filled
