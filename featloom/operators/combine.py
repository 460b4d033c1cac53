"""Pairwise combinations of the columns of a table."""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Iterable

from featloom.operators.compose import Transform
from featloom.schema import Attribute, Column, Pair, Table


@dataclasses.dataclass(frozen=True)
class Combine(Transform):
    """Ratios of numeric columns and conjunctions/disjunctions of boolean ones.

    The output holds the primary key and the combinations; a table without any pair
    yields nothing.
    """

    def apply(self, tables: Iterable[Table]) -> Iterable[Table]:
        for table in tables:
            pairs = [*_pairs(table, Attribute.numeric, "/"), *_pairs(table, Attribute.boolean, "&|")]
            if pairs:
                key = [(c, table.expr(c)) for c in table.columns if c.is_key]
                yield table.derive(
                    [*key, *((column, pair.sql) for column, pair in pairs)],
                    name=f"combine({table.name})",
                    pairs={column.name: pair for column, pair in pairs},
                )


def _pairs(table: Table, kind: Attribute, symbols: str) -> Iterable[tuple[Column, Pair]]:
    operands = [c for c in table.columns if c.has(kind) and not c.is_key]
    for x, y in itertools.combinations(operands, 2):
        for symbol in symbols:
            column = Column(
                name=f"{x} {symbol} {y}",
                attributes=x.attributes & y.attributes,
                derived_from=[(x, table.name), (y, table.name)],
            )
            yield column, Pair(symbol, table.expr(x), table.expr(y))
