"""Queries over the given tables, each with the SQL that must give the same result."""

from workload.registry import ORACLES, QUERIES
from workload import features, reports, surfaces, tables, training  # noqa: F401  (they fill the registry)

__all__ = ["ORACLES", "QUERIES"]
