"""Small helpers that turn Python values and column names into Spark SQL text.

Generated feature names contain spaces, parentheses, commas and dots, so every
reference to a column goes through :func:`quote`.
"""

from __future__ import annotations

import datetime
import decimal
import math


def quote(name: str) -> str:
    """Backtick-quote a column name."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: object) -> str:
    """Write ``value`` as a Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value) if -(2**31) < value < 2**31 else f"{value}L"
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return f"CAST('{value}' AS DOUBLE)"
        return f"{value!r}D"
    if isinstance(value, decimal.Decimal):
        return f"{value:f}BD"
    if isinstance(value, datetime.datetime):
        kind = "TIMESTAMP_NTZ" if value.tzinfo is None else "TIMESTAMP"
        return f"{kind}'{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    raise TypeError(f"no SQL literal for {type(value).__name__}")


def display(value: object) -> str:
    """Format a category value the way it appears in a generated column name."""
    return str(value)


def missing(sql: str, floating: bool) -> str:
    """Predicate: the value is null (or NaN, for floating point columns)."""
    return f"({sql} IS NULL OR isnan({sql}))" if floating else f"({sql} IS NULL)"
