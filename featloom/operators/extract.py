"""Feature extraction: bring the features of all keyed tables to the known rows."""

from __future__ import annotations

import dataclasses
from collections import defaultdict
from collections.abc import Iterable
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.functions import quote
from featloom.operators.compose import Transform
from featloom.plans.skew import ROW_LIMIT, first_duplicate, split_left_join
from featloom.schema import Attribute, Column, Pair, Table


@dataclasses.dataclass(frozen=True, kw_only=True)
class Extract(Transform):
    """Left-join the known rows with every table whose primary key they cover.

    All resulting tables read from one wide frame: the known rows plus all features.
    Per distinct key the feature frames are first joined to the distinct known keys
    (every side is unique there, and aggregates are already partitioned by that key);
    the known rows themselves then take part in one join per key only.

    :param known: What is known at the time of prediction.
    :param row_limit: Largest number of known rows with one key that one task should join.
    :param validate: Check keys that are not proven unique, and fail on duplicates.
    """

    SEPARATOR: ClassVar[str] = " :: "

    known: DataFrame | Table
    row_limit: int = ROW_LIMIT
    validate: bool = True

    def apply(self, tables: Iterable[Table]) -> Iterable[Table]:
        known = self.known.data if isinstance(self.known, Table) else self.known
        known_names = set(known.columns)

        matched: list[tuple[Table, list[_Feature]]] = []
        for table in tables:
            features = _features(table)
            if table.key and features and known_names.issuperset(table.key):
                matched.append((table, features))

        by_key: dict[tuple[str, ...], list[_Source]] = defaultdict(list)
        sources = {}
        for table, features in matched:
            source = _Source(table)
            for feature in features:
                # a value that is already known wins over the one of the table
                if feature.source.name not in known_names:
                    source.need(feature)
            if source.columns:
                by_key[tuple(sorted(table.key))].append(source)
            sources[id(table)] = source

        wide = known
        for key, group in by_key.items():
            wide = self._joined(wide, list(key), group)

        for table, features in matched:
            source = sources[id(table)]
            exprs, pairs = {}, {}
            for f in features:
                if f.source.name in known_names:
                    exprs[f.column.name] = quote(f.source.name)
                elif f.pair is not None:
                    pairs[f.column.name] = f.pair.over(source.columns)
                    exprs[f.column.name] = pairs[f.column.name].sql
                else:
                    exprs[f.column.name] = source.columns[f.sql]
            yield Table(
                name=f"features({table.name})",
                columns=[f.column for f in features],
                data=wide,
                exprs=exprs,
                pairs=pairs,
            )

    def _joined(self, known: DataFrame, key: list[str], group: list["_Source"]) -> DataFrame:
        sides = self._sides(key, group)
        declared = isinstance(self.known, Table) and (
            self.known.unique_on is not None
            and self.known.where is None
            and self.known.unique_on <= set(key)
        )
        if declared:
            for side in sides:
                known = known.join(side, on=key, how="left")
            return known

        if len(sides) == 1:
            features = sides[0]
        else:
            features = known.select(*(F.col(quote(k)) for k in key)).distinct()
            for side in sides:
                features = features.join(side, on=key, how="left")
        checked = self.known.max_rows if isinstance(self.known, Table) else None
        return split_left_join(known, features, key, row_limit=self.row_limit, checked_rows=checked)

    def _sides(self, key: list[str], group: list["_Source"]) -> list[DataFrame]:
        """One frame per join: tables over one frame share it if their key is unique there."""
        shared: dict[tuple, list[_Source]] = defaultdict(list)
        for position, source in enumerate(group):
            table = source.table
            owner = id(table.frame) if table.is_unique else f"table {position}"
            shared[(owner, *(table.expr(k) for k in key))].append(source)

        sides = []
        for members in shared.values():
            first = members[0].table
            alike = len({m.table.where for m in members}) == 1
            frame = first.frame.where(first.where) if alike and first.where is not None else first.frame
            side = frame.selectExpr(
                *(f"{first.expr(k)} AS {quote(k)}" for k in key),
                *(
                    f"{sql if alike else _guard(sql, m.table.where)} AS {name}"
                    for m in members
                    for sql, name in m.columns.items()
                ),
            )
            if self.validate and not first.is_unique:
                if duplicate := first_duplicate(side, key, ignore_nulls=True):
                    raise ValueError(f"the key of table {first.name} is not unique: {duplicate} repeats")
            sides.append(side)
        return sides


class _Source:
    """The columns that one table brings into the join: SQL over its frame → quoted name.

    Pairs bring their operands only; they are computed after the join.  That is the same,
    since they are null wherever all their operands are.
    """

    def __init__(self, table: Table) -> None:
        self.table = table
        self.columns: dict[str, str] = {}

    def need(self, feature: "_Feature") -> None:
        if feature.pair is None:
            self.columns.setdefault(feature.sql, quote(feature.column.name))
        else:
            for sql in (feature.pair.left, feature.pair.right):
                name = f"operand {len(self.columns)}{Extract.SEPARATOR}{self.table.name}"
                self.columns.setdefault(sql, quote(name))


@dataclasses.dataclass(frozen=True)
class _Feature:
    column: Column
    source: Column
    sql: str
    pair: Pair | None


def _features(table: Table) -> list[_Feature]:
    key = [(c, table.name) for c in table.columns if c.is_key]
    found = [
        _Feature(
            column=Column(
                name=f"{c.name}{Extract.SEPARATOR}{table.name}",
                attributes=c.attributes,
                derived_from=[(c, table.name), *key],
            ),
            source=c,
            sql=table.expr(c),
            pair=table.pairs.get(c.name),
        )
        for c in table.columns
        if not c.is_key and c.attributes & {Attribute.boolean, Attribute.numeric}
    ]
    return sorted(found, key=lambda f: len(f.column.name))


def _guard(sql: str, where: str | None) -> str:
    return sql if where is None else f"CASE WHEN {where} THEN {sql} END"


def assemble(features, known: DataFrame | Table | None = None) -> DataFrame:
    """Put the features of all extracted tables side by side.

    :param features: Dataset of tables extracted for the same known rows.
    :param known: The known rows, if their columns shall stay in front of the features.
    """
    tables = list(features)
    if not tables:
        raise ValueError("no table has a primary key that the known columns cover")
    if any(t.frame is not tables[0].frame or t.where is not None for t in tables):
        raise ValueError("tables do not describe the same rows; extract them together")
    names = [] if known is None else (known.data if isinstance(known, Table) else known).columns
    return tables[0].frame.selectExpr(
        *(quote(name) for name in names),
        *(f"{t.expr(c)} AS {quote(c.name)}" for t in tables for c in t.columns),
    )


def split_feature_name(name: str) -> tuple[str, str]:
    """Feature and source table of a generated feature name."""
    feature, _, source = name.partition(Extract.SEPARATOR)
    return feature, source
