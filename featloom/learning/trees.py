"""Shapley values of tree ensembles.

Every leaf of a tree is a small cooperative game: its value is reached if the conditions
of its path hold.  A feature that is left out lets each condition hold with the share of
training rows that went that way (path-dependent Shapley values).  Conditions of one path
on the same feature merge into an interval, so a leaf has one player per feature on its
path, and the values follow from the elementary symmetric polynomials of the players.
"""

from __future__ import annotations

import dataclasses
import itertools
import math
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.learning.matrix import as_matrix, filled, spread
from featloom.learning.predictors import FittedTrees
from featloom.plans.storage import scratch_path

# Up to this many players all patterns of held conditions are tabulated per leaf.
TABULATED_PLAYERS = 8

# Up to this many outputs are tabulated per tree.
TABULATED_CELLS = 1 << 18


@dataclasses.dataclass(frozen=True)
class Leaf:
    """Players of a leaf: features with the interval that leads to it, and its outputs."""

    tree: int
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    outputs: np.ndarray


@dataclasses.dataclass(frozen=True)
class Ensemble:
    """All leaves of a model.

    :param outputs: Class index per output, or None for a single output.
    """

    leaves: list[Leaf]
    outputs: list[int | None]

    @property
    def expectation(self) -> np.ndarray:
        """Outputs of the model if nothing is known about a row."""
        return sum(
            (leaf.outputs * leaf.share.prod() for leaf in self.leaves),
            np.zeros(len(self.outputs)),
        )


def read_ensemble(spark: SparkSession, fitted: FittedTrees) -> Ensemble:
    """Leaves of a fitted model, from its saved node table.

    The outputs are the margin of boosted trees, the class probabilities of a forest, or
    the predicted number.
    """
    models = getattr(fitted.model, "models", None)
    if models is not None:
        outputs: list[int | None] = list(range(len(models)))
        leaves: list[Leaf] = []
        for k, model in enumerate(models):
            first = leaves[-1].tree + 1 if leaves else 0
            leaves += [
                dataclasses.replace(leaf, tree=first + leaf.tree, outputs=np.eye(len(models))[k] * leaf.outputs[0])
                for leaf in _leaves(spark, model)
            ]
        return Ensemble(leaves, outputs)
    leaves = _leaves(spark, fitted.model)
    width = len(leaves[0].outputs) if leaves else 1
    return Ensemble(leaves, list(range(width)) if width > 1 else [None])


def _leaves(spark: SparkSession, model: Any) -> list[Leaf]:
    path = scratch_path(spark, "trees")
    model.write().save(path)
    # the model itself lives on the driver; its node table has the same size
    trees: dict[int, dict[int, Any]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        trees.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    weights = list(model.treeWeights)
    votes = type(model).__name__ == "RandomForestClassificationModel"
    if type(model).__name__.startswith("RandomForest"):
        weights = [w / sum(weights) for w in weights]
    found: list[Leaf] = []
    for tree, nodes in sorted(trees.items()):
        reached: list[Leaf] = []
        _walk(nodes, 0, {}, weights[tree], votes, reached)
        found += [dataclasses.replace(leaf, tree=tree) for leaf in reached]
    return found


def _walk(nodes: dict, at: int, players: dict, weight: float, votes: bool, found: list[Leaf]) -> None:
    node = nodes[at]
    if node["leftChild"] < 0:
        value = np.array(node["impurityStats"]) if votes else np.array([node["prediction"]])
        value = value / value.sum() if votes else value
        features = sorted(players)
        columns = [np.array([players[f][k] for f in features], dtype=float) for k in range(3)]
        found.append(Leaf(0, np.array(features, dtype=int), *columns, value * weight))
        return
    split = node["split"]
    feature, threshold = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
    low, high, share = players.get(feature, (-math.inf, math.inf, 1.0))
    for child, interval in (
        (node["leftChild"], (low, min(high, threshold))),
        (node["rightChild"], (max(low, threshold), high)),
    ):
        ratio = _weight(nodes[child], votes) / _weight(node, votes)
        _walk(nodes, child, {**players, feature: (*interval, share * ratio)}, weight, votes, found)


def _weight(node: Any, votes: bool) -> float:
    """Weight of the training rows of a node: its votes, or the first of the sums its variance follows from."""
    return sum(node["impurityStats"]) if votes else node["impurityStats"][0]


def swapped_outputs(ensemble: Ensemble, own: np.ndarray, donor: np.ndarray, features: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of rows as they are (rows x outputs), and with one feature at a time taken from
    their donors (features x rows x outputs).

    A leaf is reached if all its conditions hold; a swapped feature changes only the leaves that
    it has a condition in, by that condition alone.  So all variants follow from one
    evaluation of the conditions, and no row is ever repeated.
    """
    place = {f: k for k, f in enumerate(features)}
    outputs = np.zeros((len(own), len(ensemble.outputs)))
    changes = np.zeros((len(features), len(own), len(ensemble.outputs)))
    for leaf in ensemble.leaves:
        holds = (leaf.low < own[:, leaf.features]) & (own[:, leaf.features] <= leaf.high)
        missed = (~holds).sum(axis=1)
        reached = missed == 0
        outputs[reached] += leaf.outputs
        given = (leaf.low < donor[:, leaf.features]) & (donor[:, leaf.features] <= leaf.high)
        for k, f in enumerate(leaf.features):
            others = missed == ~holds[:, k]
            step = (others & given[:, k]).astype(np.int8) - reached.astype(np.int8)
            changed = np.flatnonzero(step)
            changes[place[f], changed] += step[changed, None] * leaf.outputs
    return outputs, outputs + changes


def swapped_function(ensemble: Ensemble, features: Sequence[int]):
    """The function of rows and donors that :func:`swapped_outputs` is, for many rows.

    A tree only sees between which of its thresholds a value lies, so its outputs are tabulated by
    these intervals, and a swapped feature moves a row inside the table.  Trees with too many
    combinations of intervals are evaluated leaf by leaf.
    """
    limits: dict[int, list[float]] = {f: [] for f in features}
    trees = [list(leaves) for _, leaves in itertools.groupby(ensemble.leaves, key=lambda leaf: leaf.tree)]
    for leaf in ensemble.leaves:
        for f, low, high in zip(leaf.features, leaf.low, leaf.high):
            limits[f] += [v for v in (low, high) if np.isfinite(v)]
    cuts = {f: np.unique(v) for f, v in limits.items()}
    tables, rest = [], []
    for leaves in trees:
        table = _tabulated(leaves, cuts, len(ensemble.outputs))
        if table is None:
            rest += leaves
        else:
            tables.append(table)
    others = dataclasses.replace(ensemble, leaves=rest)

    def outputs(own: np.ndarray, donor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain, swapped = swapped_outputs(others, own, donor, features)
        places = {f: (np.searchsorted(cuts[f], own[:, f], "left"), np.searchsorted(cuts[f], donor[:, f], "left")) for f in features}
        for steps, table in tables:
            at = {f: step[places[f][0]] for f, step in steps.items()}
            cell = sum(at.values(), np.zeros(len(own), np.int64))
            found = table[cell]
            plain += found
            for k, f in enumerate(features):
                swapped[k] += table[cell - at[f] + steps[f][places[f][1]]] if f in steps else found
        return plain, swapped

    return outputs


def _tabulated(leaves: list[Leaf], cuts: dict[int, np.ndarray], outputs: int):
    """Steps in a table per place among all thresholds of a feature, and the table of a tree."""
    limits: dict[int, np.ndarray] = {}
    for f in sorted({int(f) for leaf in leaves for f in leaf.features}):
        ends = [v for leaf in leaves for v in (*leaf.low[leaf.features == f], *leaf.high[leaf.features == f])]
        limits[f] = np.unique([v for v in ends if np.isfinite(v)])
    shape = [len(v) + 1 for v in limits.values()]
    if math.prod(shape) * outputs > TABULATED_CELLS:
        return None
    table = np.zeros((*shape, outputs))
    for leaf in leaves:
        box = [slice(None)] * len(shape)
        for f, low, high in zip(leaf.features, leaf.low, leaf.high):
            own = limits[int(f)]
            first = 0 if low == -math.inf else int(np.searchsorted(own, low)) + 1
            box[list(limits).index(int(f))] = slice(first, None if high == math.inf else int(np.searchsorted(own, high)) + 1)
        table[tuple(box)] += leaf.outputs
    steps = {}
    for k, (f, own) in enumerate(limits.items()):
        # the interval of the tree that a place among all thresholds lies in
        inside = np.concatenate([np.searchsorted(own, cuts[f], "left"), [len(own)]])
        steps[f] = inside.astype(np.int64) * math.prod(shape[k + 1 :])
    return steps, table.reshape(-1, outputs)


def answers(outputs: np.ndarray, classes: bool) -> np.ndarray:
    """What the model predicts: a class number (the first of the best ones), or the value itself."""
    if not classes:
        return outputs[..., 0]
    if outputs.shape[-1] == 1:  # margin of two classes
        return (outputs[..., 0] > 0).astype(float)
    return np.round(outputs, 12).argmax(axis=-1).astype(float)


def leaf_values(share: np.ndarray, holds: np.ndarray) -> np.ndarray:
    """Shapley value of each player of a leaf with output 1.

    :param share: Probability that a left-out condition holds, per player.
    :param holds: Whether each condition holds, one row per pattern.
    """
    players = len(share)
    order = range(players)
    weights = [math.factorial(s) * math.factorial(players - s - 1) / math.factorial(players) for s in order]
    values = np.zeros(holds.shape)
    for k in order:
        # coefficients of the product over the other players of (share + holds * t)
        sizes = np.zeros((len(holds), players))
        sizes[:, 0] = 1.0
        for j in order:
            if j != k:
                with_player = sizes * holds[:, [j]]
                sizes = sizes * share[j]
                sizes[:, 1:] += with_player[:, :-1]
        values[:, k] = (holds[:, k] - share[k]) * (sizes @ weights)
    return values


def impact_function(ensemble: Ensemble, width: int):
    """Function from feature rows to impacts of shape (rows, features, outputs).

    A tree only sees between which of its thresholds a value lies, so per tree each
    combination of such intervals is computed once, however many rows share it.
    """
    trees = [_TreeImpacts(list(leaves), len(ensemble.outputs)) for _, leaves in
             itertools.groupby(ensemble.leaves, key=lambda leaf: leaf.tree)]

    def impacts(x: np.ndarray) -> np.ndarray:
        result = np.zeros((len(x), width, len(ensemble.outputs)))
        for tree in trees:
            if len(tree.features):
                result[:, tree.features] += tree.of(x[:, tree.features])
        return result

    return impacts


class _TreeImpacts:
    """Impacts of one tree on the features that it uses."""

    def __init__(self, leaves: list[Leaf], outputs: int) -> None:
        self.features = np.unique(np.concatenate([leaf.features for leaf in leaves]))
        self.outputs = outputs
        limits = [[] for _ in self.features]
        self.leaves = []
        for leaf in leaves:
            at = np.searchsorted(self.features, leaf.features)
            for k, low, high in zip(at, leaf.low, leaf.high):
                limits[k] += [v for v in (low, high) if np.isfinite(v)]
            players = len(at)
            table = None
            if 0 < players <= TABULATED_PLAYERS:
                patterns = (np.arange(2**players)[:, None] >> np.arange(players)) & 1
                table = leaf_values(leaf.share, patterns.astype(float))
            self.leaves.append((leaf, at, table))
        self.limits = [np.unique(v) for v in limits]
        self.cells = math.prod(len(v) + 1 for v in self.limits)

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.cells >= 2**62:
            return self._of_each(x)
        cell = np.zeros(len(x), dtype=np.int64)
        for k, limits in enumerate(self.limits):
            # a value equal to a threshold goes left
            cell = cell * (len(limits) + 1) + np.searchsorted(limits, x[:, k], "left")
        _, first, inverse = np.unique(cell, return_index=True, return_inverse=True)
        return self._of_each(x[first])[inverse]

    def _of_each(self, x: np.ndarray) -> np.ndarray:
        result = np.zeros((len(x), len(self.features), self.outputs))
        for leaf, at, table in self.leaves:
            if not len(at):
                continue
            values = x[:, at]
            holds = (values > leaf.low) & (values <= leaf.high)
            pattern = holds @ (1 << np.arange(len(at)))
            if table is None:
                seen, pattern = np.unique(pattern, return_inverse=True)
                bits = (seen[:, None] >> np.arange(len(at))) & 1
                table = leaf_values(leaf.share, bits.astype(float))
            result[:, at] += table[pattern][:, :, None] * leaf.outputs
        return result


def explain(
    frame: DataFrame,
    fitted: FittedTrees,
    names: Sequence[str],
    *,
    keys: Sequence[str] = (),
    classes: Sequence[Any] | None = None,
) -> DataFrame:
    """Impact of each feature on each row, in long form: keys, class, feature, impact.

    For each row and class the impacts add up to the output minus its expectation.
    """
    ensemble = read_ensemble(frame.sparkSession, fitted)
    width, outputs = len(names), len(ensemble.outputs)
    rows = spread(filled(frame, fitted.fills).select(*keys, "features"))
    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])]
        + ["output int", "impacts array<double>"],
    )

    def explain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        impacts = impact_function(ensemble, width)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = impacts(as_matrix(batch.column(batch.num_columns - 1), width))
            for output in range(outputs):
                flat = pa.array(values[:, :, output].ravel())
                offsets = pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:-1],
                        pa.array(np.full(batch.num_rows, output, dtype=np.int32)),
                        pa.ListArray.from_arrays(offsets, flat),
                    ],
                    [*batch.schema.names[:-1], "output", "impacts"],
                )

    long = rows.mapInArrow(explain_rows, schema).select(
        *keys, "output", F.posexplode("impacts").alias("position", "impact"),
    )
    labels = [str(classes[k]) if classes is not None and k is not None else None for k in ensemble.outputs]
    return long.select(
        *keys,
        F.get(F.array(*(F.lit(label).cast("string") for label in labels)), F.col("output")).alias("class"),
        F.get(F.array(*(F.lit(n) for n in names)), F.col("position")).alias("feature"),
        "impact",
    )


def mean_impacts(frame: DataFrame, fitted: FittedTrees, width: int) -> list[float]:
    """Mean absolute impact of each feature over all rows and outputs, summed inside the tasks."""
    ensemble = read_ensemble(frame.sparkSession, fitted)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        impacts = impact_function(ensemble, width)
        total, rows = np.zeros(width), 0
        for batch in batches:
            if batch.num_rows:
                total += np.abs(impacts(as_matrix(batch.column(0), width))).mean(axis=2).sum(axis=0)
                rows += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(width, dtype=np.int32)),
                pa.array(total),
                pa.array(np.full(width, rows, dtype=np.int64)),
            ],
            ["feature", "total", "rows"],
        )

    parts = spread(filled(frame, fitted.fills).select("features")).mapInArrow(
        partial, "feature int, total double, rows long",
    )
    found = parts.groupBy("feature").agg(F.sum("total"), F.sum("rows")).orderBy("feature").collect()
    return [total / rows if rows else 0.0 for _, total, rows in found]
