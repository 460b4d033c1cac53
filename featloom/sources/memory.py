"""Tables from frames that are already at hand."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from featloom.plans.profile import table
from featloom.schema import Dataset, Table


def from_frames(spark: SparkSession, frames: Mapping[str, Any]) -> Dataset:
    """Profile named frames: Spark or pandas frames, Arrow tables, or dicts of columns (lists or numpy arrays)."""
    return Dataset([table(_into_frame(spark, value), name) for name, value in frames.items()])


def _into_frame(spark: SparkSession, value: Any) -> DataFrame:
    if isinstance(value, DataFrame):
        return value
    if isinstance(value, Mapping):
        return spark.createDataFrame(pa.table({name: pa.array(column) for name, column in value.items()}))
    return spark.createDataFrame(value)


def into_dataset(*values: Dataset | Table | Iterable) -> Dataset:
    """Flatten tables, datasets and nested iterables of them into one dataset."""
    tables: list[Table] = []
    for value in values:
        if isinstance(value, Table):
            tables.append(value)
        else:
            for item in value:
                tables.extend(into_dataset(item))
    return Dataset(tables)
