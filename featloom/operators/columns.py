"""Operators that choose, rename or re-describe columns and tables."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Collection, Iterable, Mapping

from featloom.functions import quote
from featloom.operators.compose import Transform
from featloom.plans.skew import first_duplicate
from featloom.schema import Attribute, Column, Dataset, Table

ColumnOfTable = tuple[Column | str, Table | str]


@dataclasses.dataclass(frozen=True, kw_only=True)
class Keep(Transform):
    """Keep only some columns or tables.  An empty choice restricts nothing.

    :param columns: (column, table) pairs to keep, matched by name.
    :param tables: Tables to keep, matched by name.
    """

    columns: Collection[ColumnOfTable] | None = None
    tables: Collection[Table | str] | None = None

    def apply(self, tables: Iterable[Table]) -> Iterable[Table]:
        pairs = {(str(c), str(t)) for c, t in self.columns or ()}
        names = {str(t) for t in self.tables or ()}
        return _choose(
            tables,
            table_stays=lambda t: not names or t.name in names,
            column_stays=lambda c, t: not pairs or (c, t.name) in pairs,
        )


@dataclasses.dataclass(frozen=True, kw_only=True)
class Drop(Transform):
    """Drop some columns or tables.  A table that loses all its columns disappears.

    :param columns: (column, table) pairs to drop, matched by name.
    :param tables: Tables to drop, matched by name.
    """

    columns: Collection[ColumnOfTable] | None = None
    tables: Collection[Table | str] | None = None

    def apply(self, tables: Iterable[Table]) -> Iterable[Table]:
        pairs = {(str(c), str(t)) for c, t in self.columns or ()}
        names = {str(t) for t in self.tables or ()}
        return _choose(
            tables,
            table_stays=lambda t: t.name not in names,
            column_stays=lambda c, t: (c, t.name) not in pairs,
        )


def _choose(
    tables: Iterable[Table],
    *,
    table_stays: Callable[[Table], bool],
    column_stays: Callable[[str, Table], bool],
) -> Iterable[Table]:
    for table in filter(table_stays, tables):
        names = [n for n in table.names if column_stays(n, table)]
        if len(names) == len(table.names):
            yield table
        elif names:
            yield table.narrow(names)


@dataclasses.dataclass(frozen=True, kw_only=True)
class Rename(Transform):
    """Rename columns.  A name is only replaced if the new one is not taken yet.

    :param mapping: Old name → new name.
    """

    mapping: Mapping[str, str]

    def apply(self, tables: Iterable[Table]) -> Iterable[Table]:
        for table in tables:
            applied = {
                old: new for old, new in self.mapping.items() if table.has(old) and not table.has(new)
            }
            yield table.derive(
                [
                    (dataclasses.replace(c, name=applied[c.name], derived_from=[(c, table.name)]), table.expr(c))
                    if c.name in applied
                    else (c, table.expr(c))
                    for c in table.columns
                ],
                renamed=applied,
            )


@dataclasses.dataclass(frozen=True, kw_only=True)
class Require(Transform):
    """Keep only the tables for which a predicate holds.

    :param predicate: Called with each table.
    """

    predicate: Callable[[Table], bool]

    def apply(self, tables: Iterable[Table]) -> Iterable[Table]:
        return [table for table in tables if self.predicate(table)]


def with_attributes(dataset: Dataset, edits: Mapping[str, Mapping[str, Collection[Attribute]]]) -> Dataset:
    """Override attributes: table name → column name → attributes.  Lineage is kept."""
    return Dataset(
        [
            table.select(
                dataclasses.replace(c, attributes=frozenset(edits[table.name][c.name]))
                if c.name in edits[table.name]
                else c
                for c in table.columns
            )
            if table.name in edits
            else table
            for table in dataset
        ],
    )


def redact(
    dataset: Dataset,
    *,
    columns: Collection[ColumnOfTable] = (),
    tables: Collection[Table | str] = (),
) -> Dataset:
    """Hide columns or whole tables from all later operators."""
    return dataset.apply(Drop(columns=columns, tables=tables))


def declare_key(dataset: Dataset, table: Table | str, columns: Collection[str]) -> Dataset:
    """Make ``columns`` the whole primary key of a table, after checking that they are unique.

    Inference tags every column that is unique by itself; this names the one key to join on.
    """
    edited = []
    for candidate in dataset:
        if candidate.name == str(table):
            missing = [name for name in columns if not candidate.has(name)]
            if missing:
                raise ValueError(f"table {candidate.name} has no columns {missing}")
            candidate = candidate.select(
                dataclasses.replace(
                    c,
                    attributes=c.attributes | {Attribute.primary_key}
                    if c.name in columns
                    else c.attributes - {Attribute.primary_key},
                )
                for c in candidate.columns
            )
            if not candidate.is_unique:
                # over the whole frame, so that filters of the table share the proof
                whole = candidate.frame.selectExpr(
                    *(f"{candidate.expr(n)} AS {quote(n)}" for n in columns),
                )
                if duplicate := first_duplicate(whole, list(columns)):
                    raise ValueError(f"{list(columns)} is no key of {candidate.name}: {duplicate} repeats")
                candidate.unique_on = frozenset(columns)
        edited.append(candidate)
    return Dataset(edited)


def drop_related(
    dataset: Dataset,
    target: Column,
    *,
    table: Table | str | None = None,
    qualified: bool = False,
) -> Dataset:
    """Drop every column that goes back to the same root as the target, in any table.

    Roots are compared by column name alone, on the safe side.  With ``qualified=True``
    they must also come from the same table as the target, which is ``table``.
    """
    origin = {(name, home or (str(table) if table else None)) for name, home in target.roots}

    def leaks(column: Column, owner: Table) -> bool:
        if not qualified:
            return column.is_related(target)
        return not origin.isdisjoint((name, home or owner.name) for name, home in column.roots)

    related = [(c, t) for t in dataset for c in t.columns if leaks(c, t)]
    return dataset.apply(Drop(columns=related))
