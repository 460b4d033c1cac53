"""File sources: one table per file, named after the file."""

from __future__ import annotations

import posixpath
import warnings
from collections.abc import Collection, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.functions import literal, quote
from featloom.plans.profile import table
from featloom.schema import Dataset, Table

# The null marker that directories of downloaded files use.
DIRECTORY_NULLS = ("NA",)


def from_csv(
    spark: SparkSession,
    files: str | Iterable[str],
    *,
    ignore_errors: bool = False,
    null_values: str | Collection[str] | None = None,
    multi_line: bool | None = None,
) -> Dataset:
    """Read CSV files with header lines; types are inferred from all rows.

    Quotes are doubled inside quoted values.  A column is of the narrowest of bigint, double
    and boolean (true or false) that holds all of its values, else text; dates stay text.

    :param ignore_errors: Read rows with too many or too few values as far as they fit, with a
        warning that counts them, instead of failing.
    :param null_values: Texts that stand for null, besides the empty text.
    :param multi_line: Whether quoted values may hold line breaks, which makes a file the work of
        one task.  By default a scan of the lines decides for each file: only if some line
        leaves a quote open are its records read across lines.  The rows are the same.
    """
    paths = [files] if isinstance(files, str) else list(files)
    nulls = [null_values] if isinstance(null_values, str) else list(null_values or ())
    return Dataset(
        [table(_read_csv(spark, p, ignore_errors, nulls, multi_line), posixpath.basename(p)) for p in paths],
    )


def from_csv_dir(spark: SparkSession, path: str, *, multi_line: bool | None = None) -> Dataset:
    """Read all ``*.csv`` files of a folder, on any file system that Spark can reach."""
    return from_csv(
        spark,
        _files_in(spark, path, ".csv"),
        ignore_errors=True,
        null_values=DIRECTORY_NULLS,
        multi_line=multi_line,
    )


def from_parquet(spark: SparkSession, files: str | Iterable[str], *, exact: bool = False) -> Dataset:
    """Read parquet files or folders.  Only the footers are read until values are needed."""
    paths = [files] if isinstance(files, str) else list(files)
    return Dataset([parquet_table(spark, path, exact=exact) for path in paths])


def parquet_table(spark: SparkSession, path: str, *, exact: bool = False) -> Table:
    name = posixpath.basename(path.rstrip("/")).removesuffix(".parquet")
    return table(spark.read.parquet(path), name, exact=exact)


def read_known(
    spark: SparkSession,
    path: str,
    known: DataFrame | T.StructType,
    *,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read known rows from a CSV file with at least the given columns, in any order.

    :param known: Frame or schema whose column names and types the rows must have.
    """
    schema = known.schema if isinstance(known, DataFrame) else known
    uploaded = _reader(spark, path, multi_line).csv(path)
    missing = [f.name for f in schema if f.name not in uploaded.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return uploaded.select(*(F.col(quote(f.name)).cast(f.dataType).alias(f.name) for f in schema))


def _reader(spark: SparkSession, path: str, multi_line: bool | None):
    spans = _spans_lines(spark, path) if multi_line is None else multi_line
    return spark.read.options(header=True, escape='"', multiLine=spans)


def _spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a record may go on behind the end of its line, by a scan that tasks share.

    The first line of such a record leaves a quote open, so it has an odd number of quotes;
    a carriage return inside a line is a line break, too.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))
    odd = (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2 == 1
    return lines.where(odd | F.contains("line", F.lit("\r"))).limit(1).count() > 0


def _read_csv(spark: SparkSession, path: str, ignore_errors: bool, nulls: list[str], multi_line: bool | None) -> DataFrame:
    reader = _reader(spark, path, multi_line)
    names = reader.csv(path).columns
    if ignore_errors:
        texts = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _MISFIT]])
        rows = reader.schema(texts).csv(path, columnNameOfCorruptRecord=_MISFIT)
    else:
        rows = reader.csv(path, mode="FAILFAST")
    listed = ", ".join(literal(n) for n in nulls)
    values = [f"CASE WHEN {quote(n)} NOT IN ({listed}) THEN {quote(n)} END AS {quote(n)}" if nulls else quote(n) for n in names]
    misfit = quote(_MISFIT) if ignore_errors else "CAST(NULL AS STRING)"
    rows = rows.selectExpr(*values, f"{misfit} AS {quote(_MISFIT)}")
    return _inferred(rows, names, path)


_MISFIT = "row that does not fit"
_FITS = {
    "BIGINT": "try_cast({x} AS BIGINT)",
    "DOUBLE": "try_cast({x} AS DOUBLE)",
    "BOOLEAN": "CASE WHEN lower(trim({x})) IN ('true', 'false') THEN 1 END",
}


def _inferred(rows: DataFrame, names: list[str], path: str) -> DataFrame:
    """Cast text columns to the first of the types that holds every value, by one scan."""
    checks = [F.count(F.expr(sql.format(x=quote(n)))).alias(f"{kind} {i}") for i, n in enumerate(names) for kind, sql in _FITS.items()]
    present = [F.count(F.col(quote(n))).alias(f"present {i}") for i, n in enumerate(names)]
    facts = rows.agg(F.count(quote(_MISFIT)).alias("misfits"), *present, *checks).first()
    if facts["misfits"]:
        warnings.warn(f"{path}: {facts['misfits']} rows do not fit the header", stacklevel=4)
    chosen = []
    for i, name in enumerate(names):
        fits = (k for k in _FITS if facts[f"present {i}"] and facts[f"{k} {i}"] == facts[f"present {i}"])
        chosen.append(f"CAST({quote(name)} AS {next(fits, 'STRING')}) AS {quote(name)}")
    return rows.selectExpr(*chosen)


def _files_in(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """Files of a folder, listed through Spark so that any storage works."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .load(path)
        .select("path")
        .orderBy("path")
    )
    return [row["path"] for row in listed.collect()]
