"""The cleaning sequence that a freshly loaded dataset goes through."""

from __future__ import annotations

from featloom.operators import Cast, Encode, Union
from featloom.schema import Dataset


def clean(dataset: Dataset) -> Dataset:
    """Cast columns to their natural types, stack equal tables, encode categories."""
    return dataset.apply(Cast().then(Union()).then(Encode()))


def preview(table, rows: int = 100, order_by: list[str] | None = None):
    """The first rows of a table, in a fixed order if ``order_by`` is given."""
    if not 1 <= rows <= 10_000:
        raise ValueError("a preview shows between 1 and 10000 rows")
    data = table.data
    return (data.orderBy(*order_by) if order_by else data).limit(rows)
