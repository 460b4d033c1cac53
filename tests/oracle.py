"""Compare queries with their oracle SQL: ``python tests/oracle.py [folder] [query ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    """A value in a form that compares and sorts equally for both engines."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else repr(number + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def compare(spark, connection, folder: str, query, sql: str) -> str | None:
    """None if both results are equal, else what differs."""
    frame = query(spark, folder)
    names = sorted(frame.columns)
    positions = [frame.columns.index(n) for n in names]
    ours = sorted(tuple(plain(row[i]) for i in positions) for row in frame.collect())

    cursor = connection.execute(sql)
    oracle_names = [d[0] for d in cursor.description]
    if sorted(oracle_names) != names:
        return f"columns differ: {set(names) ^ set(oracle_names)}"
    positions = [oracle_names.index(n) for n in names]
    theirs = sorted(tuple(plain(row[i]) for i in positions) for row in cursor.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows, expected {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        cells = [(n, x, y) for n, x, y in zip(names, *wrong[0]) if x != y]
        return f"{len(wrong)} of {len(ours)} rows differ, first: {cells[:4]}"
    return None


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(arguments: list[str]) -> int:
    import __spark_entry__ as entry

    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    chosen = arguments[1:] or list(entry.queries())
    spark, connection = session(), connect(folder)
    failures = 0
    for name in chosen:
        start = time.time()
        sql = entry.oracle_sql().get(name)
        try:
            if sql is None:
                problem = None if entry.queries()[name](spark, folder).count() >= 0 else "no rows"
            else:
                problem = compare(spark, connection, folder, entry.queries()[name], sql)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += problem is not None
        kind = "rows only" if sql is None else "oracle"
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(chosen) - failures} of {len(chosen)} queries agree")
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
