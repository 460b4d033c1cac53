"""Group-by feature aggregation."""

from __future__ import annotations

import dataclasses
import itertools
from collections import defaultdict
from collections.abc import Collection, Iterable

from featloom.functions import quote
from featloom.operators.compose import Transform
from featloom.plans.grouping import GROUPING_SET, STATISTICS, Slice, grouped_statistics, row_count, statistic
from featloom.plans.storage import materialise
from featloom.schema import Attribute, Column, Table

# Statistics that can only be null if the aggregated column holds nulls.
_AS_COMPLETE_AS_INPUT = {"max", "mean", "median", "min"}


@dataclasses.dataclass(frozen=True, kw_only=True)
class Aggregate(Transform):
    """Group by some of the pivotable columns and summarise all numeric columns.

    Tables over the same frame (a table and its filters, for example) share one aggregate plan,
    and so do all combinations of pivots: one scan and one shuffle, written down once if there
    are several combinations, because every combination is a frame of its own.

    :param is_pivotable: Columns that may be grouped by.
    :param max_pivots: Largest number of columns to group by together.
    :param row_limit: Largest group whose medians one task may compute; by default it depends
        on the number of medians.
    :param exact: Whether medians are exact, or those of sketches that are combined before rows
        are shuffled (see ``SKETCH_ERROR``).
    """

    is_pivotable: Collection[str | Column]
    max_pivots: int = 1
    row_limit: int | None = None
    exact: bool = True

    def apply(self, tables: Iterable[Table]) -> Iterable[Table]:
        requests = [
            _Request(table, pivots, pivotable)
            for table in tables
            for pivotable in [self._pivotable(table)]
            for size in range(1, self.max_pivots + 1)
            for pivots in itertools.combinations(pivotable, size)
        ]

        shared: dict[tuple, list[_Request]] = defaultdict(list)
        for request in requests:
            shared[request.signature].append(request)

        finished = {}
        for group in shared.values():
            for request, table in zip(group, self._grouped(group)):
                finished[id(request)] = table
        return [finished[id(request)] for request in requests]

    def _pivotable(self, table: Table) -> list[Column]:
        allowed = {str(column) for column in self.is_pivotable}
        return [c for c in table.columns if c.name in allowed and not c.is_key]

    def _grouped(self, requests: list["_Request"]) -> list[Table]:
        first = requests[0]
        sets = list(dict.fromkeys(r.names for r in requests))
        tables = list({id(r.table): r.table for r in requests}.values())
        prefixes = {id(t): f"{i}: " if len(tables) > 1 else "" for i, t in enumerate(tables)}
        # rows that no table wants are filtered in the scan
        wanted = {t.where for t in tables}
        alike = len(wanted) == 1
        frame = first.table.frame
        if None not in wanted:
            frame = frame.where(" OR ".join(f"({w})" for w in sorted(wanted)))
        grouped = grouped_statistics(
            frame,
            {c.name: first.table.expr(c) for r in requests for c in r.pivots},
            {c.name: first.table.expr(c) for c in first.measured},
            [Slice(prefixes[id(t)], None if alike else t.where) for t in tables],
            row_limit=self.row_limit,
            checked_rows=first.table.max_rows,
            sets=sets if len(sets) > 1 else None,
            exact=self.exact,
        )
        frames = {sets[0]: grouped}
        if len(sets) > 1:
            stored = materialise(grouped, "grouping-sets")
            own = {chosen: stored.where(f"{quote(GROUPING_SET)} = {j}") for j, chosen in enumerate(sets)}
            unset = {chosen: [p for p in stored.columns if p == GROUPING_SET or (p in first.pivotable and p not in chosen)] for chosen in sets}
            frames = {chosen: own[chosen].drop(*unset[chosen]) for chosen in sets}
        return [self._result(r, frames[r.names], prefixes[id(r.table)], fused=not alike) for r in requests]

    def _result(self, request: "_Request", grouped, prefix: str, *, fused: bool) -> Table:
        table = request.table
        columns = [
            (
                Column(
                    name=c.name,
                    attributes=c.attributes | {Attribute.primary_key},
                    derived_from=[(c, table.name)],
                ),
                quote(c.name),
            )
            for c in request.pivots
        ]
        count = Column(name="count(*)", attributes={Attribute.numeric, Attribute.not_null})
        columns.append((count, quote(row_count(prefix))))
        for x in request.measured:
            for kind in STATISTICS:
                complete = kind == "sum" or (kind in _AS_COMPLETE_AS_INPUT and x.has(Attribute.not_null))
                column = Column(
                    name=f"{kind}({x})",
                    attributes=x.attributes - {Attribute.not_null}
                    | ({Attribute.not_null} if complete else set()),
                    derived_from=[(x, table.name)],
                )
                columns.append((column, quote(statistic(prefix, kind, x.name))))

        pivots = [c.name for c in request.pivots]
        return Table(
            name=f"group_by({table.name}, {', '.join(pivots)})",
            columns=[column for column, _ in columns],
            data=grouped,
            exprs={column.name: sql for column, sql in columns},
            # without rows of its slice a group would not exist in an aggregate of its own
            where=f"{quote(row_count(prefix))} > 0" if fused else None,
            unique_on=pivots,
            max_rows=table.max_rows,
        )


class _Request:
    """One table to group by one combination of columns."""

    def __init__(self, table: Table, pivots: tuple[Column, ...], pivotable: list[Column]) -> None:
        names = {c.name for c in pivotable}
        self.table = table
        self.pivots = pivots
        self.names = tuple(c.name for c in pivots)
        self.pivotable = {c.name: table.expr(c) for c in pivotable}
        self.measured = [
            c
            for c in table.columns
            if c.has(Attribute.numeric) and not c.is_key and c.name not in names
        ]

    @property
    def signature(self) -> tuple:
        """Requests with equal signatures differ only in their rows and in the pivots they choose."""
        return (
            id(self.table.frame),
            tuple(self.pivotable.items()),
            tuple((c.name, self.table.expr(c)) for c in self.measured),
        )
