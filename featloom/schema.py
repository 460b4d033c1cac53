"""Column specifications, tables and datasets.

A :class:`Table` is a Spark ``DataFrame`` plus *named SQL expressions* over it and
an optional row predicate.  Row-wise operators only add expressions and filters
only add predicates, so every table that descends from one frame still knows that
frame.  Later operators use this to answer many tables with a single plan: all
filtered aggregates of a table become one aggregate, and all features of a frame
need one join.
"""

from __future__ import annotations

import dataclasses
import enum
import functools
from collections.abc import Iterable, Iterator, Mapping
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from featloom.functions import quote

if TYPE_CHECKING:
    from featloom.operators.compose import Transform


@enum.unique
class Attribute(enum.Enum):
    """What is known about the values of a column.  Fixed values: the names."""

    boolean = "boolean"
    categorical = "categorical"
    not_null = "not_null"
    numeric = "numeric"
    primary_key = "primary_key"
    temporal = "temporal"
    textual = "textual"

    def __str__(self) -> str:
        return self.name


@dataclasses.dataclass(frozen=True, kw_only=True)
class Column:
    """Name, attributes and lineage of a column.

    ``derived_from`` holds (parent column, name of the parent's table) pairs.
    """

    name: str
    attributes: frozenset[Attribute] = dataclasses.field(default=frozenset(), repr=False)
    derived_from: tuple[tuple["Column", str], ...] = dataclasses.field(default=(), repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "attributes", frozenset(self.attributes))
        object.__setattr__(
            self,
            "derived_from",
            tuple((parent, str(table)) for parent, table in self.derived_from),
        )

    def __str__(self) -> str:
        return self.name

    def has(self, *attributes: Attribute) -> bool:
        return self.attributes.issuperset(attributes)

    @property
    def is_key(self) -> bool:
        return Attribute.primary_key in self.attributes

    @functools.cached_property
    def roots(self) -> frozenset[tuple[str, str | None]]:
        """(column, table) pairs without parents that this column goes back to."""
        found: set[tuple[str, str | None]] = set()
        for parent, table in self.derived_from:
            found |= {(name, home or table) for name, home in parent.roots}
        return frozenset(found) or frozenset({(self.name, None)})

    def is_related(self, other: "Column", /) -> bool:
        """Whether both columns go back to a root of the same name."""
        return not {name for name, _ in self.roots}.isdisjoint(name for name, _ in other.roots)


@dataclasses.dataclass(frozen=True)
class Pair:
    """A column made from two others: an operation and the SQL of its operands."""

    symbol: str
    left: str
    right: str

    @property
    def sql(self) -> str:
        if self.symbol == "/":
            return (
                f"CASE WHEN {self.right} = 0 THEN CAST('NaN' AS DOUBLE) "
                f"ELSE CAST({self.left} AS DOUBLE) / {self.right} END"
            )
        return f"({self.left} {'AND' if self.symbol == '&' else 'OR'} {self.right})"

    def over(self, columns: Mapping[str, str]) -> "Pair":
        """The same operation with other SQL for its operands."""
        return Pair(self.symbol, columns[self.left], columns[self.right])


class Table:
    """A named set of columns over a Spark frame."""

    def __init__(
        self,
        *,
        name: str,
        columns: Iterable[Column],
        data: DataFrame,
        exprs: Mapping[str, str] | None = None,
        where: str | None = None,
        unique_on: Iterable[str] | None = None,
        max_rows: int | None = None,
        pairs: Mapping[str, Pair] | None = None,
    ) -> None:
        """
        :param name: Name of the table.
        :param columns: Columns in this table.
        :param data: Frame that the expressions read from.
        :param exprs: SQL expression of each column; a plain reference if absent.
        :param where: SQL predicate that rows of the frame must satisfy.
        :param unique_on: Columns of this table proven unique over *all* rows of the frame.
        :param max_rows: Proven upper bound of the number of rows of the frame.
        :param pairs: Columns that combine two operands.  There can be very many of them, so
            extraction and training move the operands instead.
        """
        self.name = name
        self.columns = list(columns)
        self.frame = data
        self.where = where
        self.unique_on = frozenset(unique_on) if unique_on is not None else None
        self.max_rows = max_rows
        self.pairs = {c.name: pairs[c.name] for c in self.columns if c.name in pairs} if pairs else {}
        self._exprs = {c.name: (exprs or {}).get(c.name, quote(c.name)) for c in self.columns}

        folded: dict[str, str] = {}
        for column in self.columns:
            twin = folded.setdefault(column.name.lower(), column.name)
            if twin != column.name or len(self._exprs) != len(self.columns):
                raise ValueError(f"table {name}: columns {twin!r} and {column.name!r} collide")

    def __str__(self) -> str:
        return self.name

    def __repr__(self) -> str:
        return f"Table(name={self.name!r}, columns={[c.name for c in self.columns]})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Table) and other.name == self.name

    def __hash__(self) -> int:
        return hash(self.name)

    @functools.cached_property
    def data(self) -> DataFrame:
        """The table as a lazy DataFrame."""
        frame = self.frame if self.where is None else self.frame.where(self.where)
        plain = all(self._exprs[n] == quote(n) for n in self.names)
        if plain and self.names == frame.columns:
            return frame
        return frame.selectExpr(*(f"{self._exprs[n]} AS {quote(n)}" for n in self.names))

    @property
    def names(self) -> list[str]:
        """Names of the columns, for those who need no attributes."""
        return [c.name for c in self.columns]

    def narrow(self, names: Iterable[str]) -> "Table":
        """Only the columns of these names, in their present order."""
        chosen = set(names)
        return self.select([c for c in self.columns if c.name in chosen])

    @property
    def key(self) -> list[str]:
        """Names of the primary key columns."""
        return [c.name for c in self.columns if c.is_key]

    @property
    def is_unique(self) -> bool:
        """Whether the primary key is proven unique over the whole frame."""
        return self.unique_on is not None and self.unique_on <= set(self.key)

    def expr(self, column: str | Column) -> str:
        """SQL expression of a column over the frame of this table."""
        return self._exprs[str(column)]

    def has(self, name: str) -> bool:
        return name in self._exprs

    def column(self, name: str) -> Column:
        for column in self.columns:
            if column.name == name:
                return column
        raise ValueError(f"table {self.name} has no column {name}")

    def select(self, columns: Iterable[Column]) -> "Table":
        """Project the given columns; their attributes and lineage replace the present ones."""
        return self.derive([(column, self._exprs[column.name]) for column in columns])

    def derive(
        self,
        columns: Iterable[tuple[Column, str]],
        *,
        name: str | None = None,
        renamed: Mapping[str, str] | None = None,
        pairs: Mapping[str, Pair] | None = None,
    ) -> "Table":
        """A row-wise descendant: same frame and rows, other columns."""
        columns = list(columns)
        if pairs is None:
            pairs = {c.name: self.pairs[c.name] for c, sql in columns if self._is_pair(c.name, sql)}
        names = {column.name for column, _ in columns}
        unique = self.unique_on
        if unique is not None:
            unique = frozenset((renamed or {}).get(n, n) for n in unique)
        return Table(
            name=name or self.name,
            columns=[column for column, _ in columns],
            data=self.frame,
            exprs={column.name: sql for column, sql in columns},
            where=self.where,
            unique_on=unique if unique is not None and unique <= names else None,
            max_rows=self.max_rows,
            pairs=pairs,
        )

    def _is_pair(self, name: str, sql: str) -> bool:
        return name in self.pairs and self._exprs[name] == sql

    def restrict(self, predicate: str, *, name: str) -> "Table":
        """The rows that satisfy a predicate over the frame."""
        return Table(
            name=name,
            columns=self.columns,
            data=self.frame,
            exprs=self._exprs,
            where=predicate if self.where is None else f"({self.where}) AND ({predicate})",
            unique_on=self.unique_on,
            max_rows=self.max_rows,
            pairs=self.pairs,
        )


@dataclasses.dataclass(frozen=True)
class Dataset:
    """An ordered collection of tables."""

    tables: list[Table]

    def __iter__(self) -> Iterator[Table]:
        return iter(self.tables)

    def apply(self, transform: "Transform", /) -> "Dataset":
        return Dataset(list(transform.apply(self.tables)))

    def features(self, known: DataFrame | Table, *, keep_known: bool = False) -> DataFrame:
        """Features of all tables for the ``known`` rows, as one wide lazy frame."""
        from featloom.operators.extract import Extract, assemble

        return assemble(self.apply(Extract(known=known)), known if keep_known else None)

    def table(self, name: str) -> Table:
        for table in self.tables:
            if table.name == name:
                return table
        raise ValueError(f"dataset has no table {name}")
