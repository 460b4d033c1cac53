"""Kinds of prediction problems."""

from __future__ import annotations

import enum

from featloom.schema import Attribute, Column, Table


@enum.unique
class Problem(enum.Enum):
    """What a model predicts: a class or a number."""

    classification = "classification"
    regression = "regression"

    def __str__(self) -> str:
        return self.name


def suggest_problem(table: Table, target: Column | str) -> tuple[Problem, list[Column]]:
    """Default problem and known columns for a target: a complete column of the table."""
    column = table.column(str(target))
    if not column.has(Attribute.not_null):
        raise ValueError(f"{column} has missing values and cannot be a target")
    problem = Problem.classification if column.has(Attribute.categorical) else Problem.regression
    return problem, [c for c in table.columns if c.is_key and c.name != column.name]
