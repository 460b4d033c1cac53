"""Registry of queries, and helpers for comparable output.

Sums of doubles differ in their last bits between engines, so computed doubles are
rounded the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from featloom import Dataset, Table
from featloom.functions import quote
from featloom.plans.grouping import STATISTICS
from featloom.sources.files import parquet_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL to compare it with."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def load(spark: SparkSession, sf_dir: str, *names: str) -> Dataset:
    """Profiled tables."""
    return Dataset([parquet_table(spark, f"{sf_dir}/{name}.parquet") for name in names])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dq(name: str) -> str:
    """Quote a name for standard SQL."""
    return '"' + name.replace('"', '""') + '"'


def r4(sql: str) -> str:
    """Rounding that both engines agree on, as SQL that both understand."""
    return f"round(CAST({sql} AS DOUBLE) + 1.234567e-7, 4)"


def comparable(kind: str, sql: str) -> str:
    """A statistic in comparable form."""
    if kind == "var":
        return f"round(CAST({sql} AS DOUBLE) / 1e6 + 1.234567e-7, 4)"
    if kind in ("mean", "std", "sum"):
        return r4(sql)
    return f"CAST({sql} AS DOUBLE) + 0.0"


def kind_of(name: str) -> str:
    """Statistic that a generated column name starts with, or an empty text."""
    kind = name.split("(", 1)[0]
    return kind if kind in STATISTICS else ""


def tidy(frame: DataFrame) -> DataFrame:
    """Round generated statistics for comparison; other columns stay as they are."""
    return frame.selectExpr(
        *(
            f"{comparable(kind_of(n), quote(n))} AS {quote(n)}" if kind_of(n) else quote(n)
            for n in frame.columns
        ),
    )


# SQL of each statistic; all values are finite in the given tables
_SQL = {
    "max": "max({x})",
    "mean": "avg({x})",
    "median": "median({x})",
    "min": "min({x})",
    "std": "stddev_samp({x})",
    "sum": "sum({x})",
    "var": "var_samp({x})",
}


def stat_columns(columns: list[str], *, suffix: str = "", where: str | None = None) -> str:
    """Select list of row count and all statistics, for an oracle."""
    condition = f" FILTER (WHERE {where})" if where else ""
    rows = f"count(*){condition}"
    items = [f"{f'nullif({rows}, 0)' if where else rows} AS {dq('count(*)' + suffix)}"]
    for x in columns:
        for kind, template in _SQL.items():
            sql = template.format(x=x) + condition
            items.append(f"{comparable(kind, sql)} AS {dq(f'{kind}({x}){suffix}')}")
    return ", ".join(items)


def stat_names(columns: list[str], suffix: str = "") -> list[str]:
    return [f"count(*){suffix}", *(f"{kind}({x}){suffix}" for x in columns for kind in _SQL)]


def named(table: Table) -> DataFrame:
    """The rows of a table behind its name."""
    return table.data.selectExpr(f"'{table.name}' AS table_name", "*")
