"""Feature rows as one array column, with the target next to it."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.functions import literal, quote
from featloom.plans.dictionary import dictionary, with_ids
from featloom.plans.ordering import PART, part_offsets, quote_part
from featloom.plans.skew import split_left_join
from featloom.plans.storage import materialise
from featloom.problem import Problem
from featloom.schema import Pair

# Classes up to which a label is an expression; it is a join for more of them.
FEW_CLASSES = 200


@dataclasses.dataclass(frozen=True)
class FeatureMatrix:
    """Rows with ``features`` (array of doubles) and a numeric ``label``.

    A feature is missing if it is null, NaN or infinite.

    Wide tables are slow as thousands of columns, so training works on one array.

    :param classes: Sorted class values of a classification target; the label is the index.
    """

    frame: DataFrame
    names: list[str]
    problem: Problem
    classes: list[Any] | None = None

    @property
    def width(self) -> int:
        return len(self.names)

    def take(self, chosen: Sequence[int]) -> "FeatureMatrix":
        """Only the features at the given positions."""
        positions = F.array(*(F.lit(int(i)) for i in chosen)) if chosen else F.expr("CAST(array() AS array<int>)")
        features = F.transform(positions, lambda i: F.get(F.col("features"), i))
        return dataclasses.replace(
            self,
            frame=self.frame.withColumn("features", features),
            names=[self.names[i] for i in chosen],
        )

    def where(self, predicate: str) -> "FeatureMatrix":
        return dataclasses.replace(self, frame=self.frame.where(predicate))


def array_of(cells: Sequence[str]) -> str:
    """SQL of a feature array.  It stays this plain, so that its generated code gets compiled."""
    return f"CAST(array({', '.join(f'CAST({c} AS DOUBLE)' for c in cells)}) AS array<double>)"


def present(sql: str) -> str:
    """Predicate: a feature is not missing (null, NaN or infinite)."""
    return f"coalesce(abs({sql}) < CAST('Infinity' AS DOUBLE), false)"


def combined(frame: DataFrame, width: int, recipe: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Turn the last column, an array of operands, into an array of ``features``.

    Thousands of generated expressions would take longer to plan than to compute, so tasks
    combine whole columns of each Arrow batch.

    :param width: Number of operands.
    :param recipe: Per feature the symbol of a pair and the positions of its operands; an
        empty symbol takes the first operand as it is.
    """
    symbols = np.array([symbol for symbol, _, _ in recipe])
    left = np.array([i for _, i, _ in recipe], dtype=int)
    right = np.array([j for _, _, j in recipe], dtype=int)
    ratios, both, either = (np.flatnonzero(symbols == s) for s in "/&|")
    kept = frame.schema.fields[:-1]
    schema = T.StructType([*kept, T.StructField("features", T.ArrayType(T.DoubleType()))])

    def combine(x: np.ndarray) -> np.ndarray:
        out = x[:, left]
        with np.errstate(all="ignore"):
            quotient = x[:, left[ratios]] / x[:, right[ratios]]
        out[:, ratios] = np.where(np.isfinite(quotient), quotient, np.nan)
        # NaN is unknown: it decides neither a conjunction with 0 nor a disjunction with 1
        for columns, decisive in ((both, 0.0), (either, 1.0)):
            a, b = x[:, left[columns]], x[:, right[columns]]
            open_ = np.where(np.isnan(a) | np.isnan(b), np.nan, 1.0 - decisive)
            out[:, columns] = np.where((a == decisive) | (b == decisive), decisive, open_)
        return out

    def combine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_matrix(batch.column(batch.num_columns - 1), width)
            # slices bound the memory of batches with thousands of features per row
            for start in range(0, len(x), 512):
                features = combine(x[start : start + 512])
                offsets = pa.array(np.arange(0, features.size + 1, len(recipe), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(start, len(features)) for c in batch.columns[:-1]),
                        pa.ListArray.from_arrays(offsets, pa.array(features.ravel())),
                    ],
                    [*batch.schema.names[:-1], "features"],
                )

    return frame.mapInArrow(combine_batches, schema)


def feature_matrix(
    frame: DataFrame,
    features: Sequence[str] | Mapping[str, str],
    target: str,
    problem: Problem,
    *,
    extra: Sequence[str] = (),
    classes: list[Any] | None = None,
    pairs: Mapping[str, Pair] | None = None,
) -> FeatureMatrix:
    """Assemble features and target; class values are numbered in sorted order.

    :param features: Feature columns, or feature name → SQL over the frame.
    :param extra: Other columns to carry along.
    :param classes: Known class values; read from the data if absent.
    :param pairs: The features that combine two operands, by name; only their operands
        become expressions.
    """
    cells = dict(features) if isinstance(features, Mapping) else {n: quote(n) for n in features}
    if problem is Problem.classification:
        if classes is None:
            classes = class_values(frame, target)
        if len(classes) <= FEW_CLASSES:
            label = label_of(target, classes)
        else:
            frame, label = _with_labels(frame, target, classes), "CAST(`label of class` AS DOUBLE)"
    else:
        label = f"CAST({quote(target)} AS DOUBLE)"
    kept = [*(quote(e) for e in extra), f"{label} AS label"]
    if not pairs:
        rows = frame.selectExpr(*kept, f"{array_of(list(cells.values()))} AS features")
        return FeatureMatrix(rows, list(cells), problem, classes)

    operands: dict[str, int] = {}

    def at(sql: str) -> int:
        return operands.setdefault(sql, len(operands))

    recipe = [
        (pairs[n].symbol, at(pairs[n].left), at(pairs[n].right)) if n in pairs else ("", at(sql), 0)
        for n, sql in cells.items()
    ]
    rows = frame.selectExpr(*kept, f"{array_of(list(operands))} AS operands")
    return FeatureMatrix(combined(rows, len(operands), recipe), list(cells), problem, classes)


def class_values(frame: DataFrame, target: str) -> list[Any]:
    """Sorted distinct values of the target, which a model lists as its answers."""
    return sorted(row[0] for row in frame.select(F.col(quote(target))).distinct().na.drop().collect())


def encode_labels(frame: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Add a ``label`` with the number of the class, for any number of classes, and the dictionary
    (``value``, ``id``) to read it back."""
    classes = dictionary(frame, quote(target))
    return with_ids(frame, {"label": (quote(target), classes)}), classes


def decode_labels(frame: DataFrame, classes: DataFrame, *, label: str = "label", name: str = "class") -> DataFrame:
    """Add the class that a label stands for."""
    return split_left_join(frame, classes.withColumnsRenamed({"id": label, "value": name}), [label])


def label_of(target: str, classes: list[Any]) -> str:
    cases = " ".join(f"WHEN {literal(value)} THEN {i}D" for i, value in enumerate(classes))
    return f"CASE {quote(target)} {cases} END" if classes else "CAST(NULL AS DOUBLE)"


def _with_labels(frame: DataFrame, target: str, classes: list[Any]) -> DataFrame:
    """The number of the class as ``label of class``, by a join."""
    kind = frame.schema[target].dataType
    schema = T.StructType([T.StructField("value", kind), T.StructField("id", T.LongType())])
    known = frame.sparkSession.createDataFrame([(value, i) for i, value in enumerate(classes)], schema)
    return with_ids(frame, {"label of class": (quote(target), known)})


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column as a two-dimensional array, with NaN for all missing values."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.where(np.isfinite(flat), flat, np.nan).reshape(-1, width)


def spread(frame: DataFrame) -> DataFrame:
    """Rows in at least as many partitions as there are cores.

    Small inputs come in few files; costly work per row should still use every core.  Large
    inputs have enough files and are not shuffled.  Files are counted without running a job.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if len(frame.inputFiles()) < cores else frame


@dataclasses.dataclass(frozen=True)
class FeatureSummary:
    """Facts about one feature, over its present values."""

    present: int
    mean: float
    low: float
    high: float


def summarise(matrix: FeatureMatrix) -> list[FeatureSummary]:
    """Count, mean and extremes of each feature: one pass, one small row per task and feature."""
    width = matrix.width

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, total = np.zeros(width), np.zeros(width)
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column(0), width)
            given = ~np.isnan(x)
            present += given.sum(axis=0)
            total += np.where(given, x, 0).sum(axis=0)
            low = np.minimum(low, np.where(given, x, np.inf).min(axis=0))
            high = np.maximum(high, np.where(given, x, -np.inf).max(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width, dtype=np.int32)), *(pa.array(v) for v in (present, total, low, high))],
            ["feature", "present", "total", "low", "high"],
        )

    parts = matrix.frame.select("features").mapInArrow(
        partial, "feature int, present double, total double, low double, high double",
    )
    rows = (
        parts.groupBy("feature")
        .agg(F.sum("present"), F.sum("total"), F.min("low"), F.max("high"))
        .orderBy("feature")
        .collect()
    )
    return [
        FeatureSummary(int(n), total / n, low, high) if n else FeatureSummary(0, 0.0, 0.0, 0.0)
        for _, n, total, low, high in rows
    ]


def fills_of(summaries: Sequence[FeatureSummary]) -> list[float]:
    """Stand-ins for missing values: below all present ones, so that a tree can split them off."""
    return [s.low - max(1.0, abs(s.low)) if s.present else 0.0 for s in summaries]


def filled(frame: DataFrame, fills: Sequence[float]) -> DataFrame:
    """Replace missing features by their stand-ins."""
    if not fills:
        return frame
    stand_ins = F.array(*(F.lit(float(f)) for f in fills))
    replaced = F.zip_with(
        "features", stand_ins, lambda x, f: F.when(F.abs(x) < F.lit(float("inf")), x).otherwise(f),
    )
    return frame.withColumn("features", replaced)


def vectors(frame: DataFrame) -> DataFrame:
    """Add the features as an ML vector."""
    return frame.withColumn("vector", array_to_vector("features"))


def indexed(frame: DataFrame) -> tuple[DataFrame, int]:
    """Number the rows 0..n-1 in no particular order, and count them.

    Positions inside a partition are made data by writing the frame once; the number of
    rows before each partition is added from a table with one row per partition.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialise(
        frame.withColumn(PART, F.spark_partition_id()).withColumn("place in part", within), "indexed",
    )
    offsets = part_offsets(placed)
    before = frame.sparkSession.createDataFrame(list(offsets.items()), f"`{PART}` int, `offset of part` long")
    numbered = (
        placed.join(F.broadcast(before), PART)
        .withColumn("index", F.col("offset of part") + F.col("place in part"))
        .drop(PART, "offset of part", "place in part")
    )
    last = placed.where(quote_part() == max(offsets, default=0)).count() if offsets else 0
    return numbered, max(offsets.values(), default=0) + last


def with_donors(numbered: DataFrame, rows: int, seed: int) -> DataFrame:
    """Give each row the features of another one as ``donor``, so that donors permute the rows.

    The permutation is affine modulo the number of rows: it needs no sort, and every row
    gives exactly once, so the join has no heavy keys.
    """
    random = np.random.default_rng(seed)
    factor = 1
    if rows > 2:
        factor = int(random.integers(1, rows))
        while np.gcd(factor, rows) != 1:
            factor = factor % (rows - 1) + 1
    shift = int(random.integers(0, max(1, rows)))
    number = F.expr(f"CAST(pmod({factor}BD * CAST(index AS DECIMAL(19, 0)) + {shift}BD, {max(1, rows)}BD) AS BIGINT)")
    donors = numbered.select(number.alias("index"), F.col("features").alias("donor"))
    return numbered.join(donors, "index")
