"""Materialising tables."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable

from pyspark.sql import DataFrame

from featloom.operators.compose import Transform
from featloom.plans.storage import materialise
from featloom.schema import Table


@dataclasses.dataclass(frozen=True, kw_only=True)
class Collect(Transform):
    """Compute all tables once, so that later operators do not repeat the work.

    The rows stay distributed.  By default they are cached on the executors (and
    recomputed if lost); ``durable=True`` writes them to the shared folder instead.
    """

    durable: bool = False

    def apply(self, tables: Iterable[Table]) -> Iterable[Table]:
        done: dict[int, DataFrame] = {}
        for table in tables:
            frame = table.frame
            if id(frame) not in done:
                done[id(frame)] = materialise(frame, "collected") if self.durable else frame.persist()
            yield Table(
                name=table.name,
                columns=table.columns,
                data=done[id(frame)],
                exprs={c.name: table.expr(c) for c in table.columns},
                where=table.where,
                unique_on=table.unique_on,
                max_rows=table.max_rows,
                pairs=table.pairs,
            )
