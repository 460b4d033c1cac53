"""Dictionaries: the distinct values of a column with dense numbers, kept as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.functions import quote
from featloom.plans.ordering import running_total
from featloom.plans.skew import split_left_join
from featloom.plans.storage import materialise

_KEY = "value of dictionary"


def dictionary(frame: DataFrame, sql: str) -> DataFrame:
    """``value`` and ``id``: the distinct values of an expression, numbered from 0 in their order.

    Values are made distinct before the shuffle and ordered by range partitions, so their
    number is not limited.  Null is no value.
    """
    values = frame.select(F.expr(sql).alias("value")).where("value IS NOT NULL").distinct()
    numbered = running_total(values.withColumn("one", F.lit(1)), [F.col("value")], "one", "id")
    return materialise(numbered.select("value", F.col("id").cast("long").alias("id")), "dictionary")


def with_ids(frame: DataFrame, words: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """Add columns with the numbers of values: name → (expression, dictionary).

    Dictionaries are stored, so the engine broadcasts the small ones; values that hold very many
    rows are joined apart.  Null has the number null.
    """
    for name, (sql, known) in words.items():
        kept = [quote(c) for c in frame.columns]
        listed = known.withColumnsRenamed({"value": _KEY, "id": name})
        joined = split_left_join(frame.withColumn(_KEY, F.expr(sql)), listed, [_KEY])
        frame = joined.selectExpr(*kept, quote(name))
    return frame


def sparse_dummies(frame: DataFrame, columns: Sequence[str], *, name: str = "dummies") -> tuple[DataFrame, list[str], dict[str, DataFrame]]:
    """Add a sparse vector with a 1 per column: at the number of its value, or behind all values if null.

    Returns the frame, the columns in their order in the vector, and the dictionaries, whose sizes
    plus one are the widths: a column per category never exists.
    """
    words = {c: dictionary(frame, quote(c)) for c in columns}
    sizes = [words[c].count() for c in columns]
    ids, own = [f"id of {c}" for c in columns], [f"dummies of {c}" for c in columns]
    numbered = with_ids(frame, {i: (quote(c), words[c]) for i, c in zip(ids, columns)})
    for i, size in zip(ids, sizes):
        numbered = numbered.withColumn(i, F.coalesce(F.col(quote(i)), F.lit(size)).cast("double"))
    # the widths are known: the encoder is fitted to the largest numbers alone
    largest = frame.sparkSession.createDataFrame([tuple(float(size) for size in sizes)], ids)
    encoded = OneHotEncoder(inputCols=ids, outputCols=own, dropLast=False).fit(largest).transform(numbered)
    assembled = VectorAssembler(inputCols=own, outputCol=name).transform(encoded)
    return assembled.drop(*ids, *own), list(columns), words
