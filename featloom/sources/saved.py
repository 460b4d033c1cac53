"""Saving a dataset as parquet plus a small description of its columns."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from featloom.schema import Attribute, Column, Dataset, Table


def save_dataset(dataset: Dataset, path: str) -> None:
    """Write every table as parquet below ``path``, next to attributes and lineage."""
    root = path.rstrip("/")
    described = []
    for i, table in enumerate(dataset):
        table.data.write.parquet(f"{root}/table-{i}")
        described.append(
            {
                "name": table.name,
                "unique_on": None if table.unique_on is None else sorted(table.unique_on),
                "max_rows": table.max_rows,
                "columns": [
                    {
                        "name": c.name,
                        "attributes": sorted(a.name for a in c.attributes),
                        "roots": sorted([name, home or ""] for name, home in c.roots) if c.derived_from else [],
                    }
                    for c in table.columns
                ],
            },
        )
    spark = _session(dataset)
    spark.createDataFrame([(json.dumps(described),)], "description string").coalesce(1).write.text(
        f"{root}/columns",
    )


def load_dataset(spark: SparkSession, path: str) -> Dataset:
    """Read a dataset that :func:`save_dataset` has written."""
    root = path.rstrip("/")
    described = json.loads(spark.read.text(f"{root}/columns", wholetext=True).first()[0])
    return Dataset(
        [
            Table(
                name=entry["name"],
                columns=[
                    Column(
                        name=c["name"],
                        attributes={Attribute[a] for a in c["attributes"]},
                        derived_from=[(Column(name=name), home) for name, home in c["roots"]],
                    )
                    for c in entry["columns"]
                ],
                data=spark.read.parquet(f"{root}/table-{i}"),
                # rows of a filtered table are the frame now, so the proof stays valid
                unique_on=entry["unique_on"],
                max_rows=entry["max_rows"],
            )
            for i, entry in enumerate(described)
        ],
    )


def _session(dataset: Dataset) -> SparkSession:
    for table in dataset:
        return table.frame.sparkSession
    raise ValueError("an empty dataset cannot be saved")
