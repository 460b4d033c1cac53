"""Feature selection: each selector decides which features of a matrix to keep."""

from __future__ import annotations

import abc
import dataclasses
import math
import sys
from collections.abc import Iterator, Sequence
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.learning.correlation import pair_correlations
from featloom.learning.matrix import FeatureMatrix, as_matrix, indexed, with_donors
from featloom.learning.predictors import FittedTrees, PredictionMethod
from featloom.learning.trees import answers, mean_impacts, read_ensemble, swapped_function
from featloom.plans.quantiles import array_quantiles
from featloom.plans.storage import materialise, release
from featloom.problem import Problem


# Rows that are scored with all features permuted in one step.
STEP = 2048

# Rows of a file of a Boruta trial, from which fitting and scoring take their partitions.
TRIAL_ROWS = 1 << 18


class Selector(abc.ABC):
    """Chooses features."""

    @abc.abstractmethod
    def select(self, matrix: FeatureMatrix) -> list[bool]:
        """Whether to keep each feature of the matrix."""

    def chosen(self, matrix: FeatureMatrix) -> list[int]:
        """Positions of the features to keep."""
        return [i for i, keep in enumerate(self.select(matrix)) if keep]


def top(scores: Sequence[float], n: int) -> list[bool]:
    """The ``n`` highest scores; of equal ones, the first."""
    best = sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:n]
    return [i in set(best) for i in range(len(scores))]


@dataclasses.dataclass(frozen=True, kw_only=True)
class FeatureImportance(Selector):
    """Features at least as important to a fitted predictor as the mean, at most ``n``."""

    n: int
    predictor: PredictionMethod

    def select(self, matrix: FeatureMatrix) -> list[bool]:
        if self.n >= matrix.width:
            return [True] * matrix.width
        importances = self.predictor.fit(matrix).importances
        mean = sum(importances) / len(importances)
        return [best and value >= mean for best, value in zip(top(importances, self.n), importances)]


@dataclasses.dataclass(frozen=True, kw_only=True)
class Correlation(Selector):
    """Features that correlate with no *later* feature by ``max`` or more, in absolute value.

    The last of a group of correlated features therefore survives.
    """

    max: float = 0.5
    method: Literal["pearson", "kendall", "spearman"] = "pearson"

    def select(self, matrix: FeatureMatrix) -> list[bool]:
        pairs = pair_correlations(matrix, self.method)
        tied = pairs.where(F.abs("r") >= self.max).select("i").distinct().collect()
        dropped = {row["i"] for row in tied}
        return [i not in dropped for i in range(matrix.width)]


@dataclasses.dataclass(frozen=True, kw_only=True)
class ShapelyImpact(Selector):
    """The ``n`` features with the largest mean absolute Shapley value for a fitted predictor."""

    n: int
    predictor: PredictionMethod

    def select(self, matrix: FeatureMatrix) -> list[bool]:
        if self.n >= matrix.width:
            return [True] * matrix.width
        fitted = self.predictor.fit(matrix)
        return top(mean_impacts(matrix.frame, fitted, matrix.width), self.n)


@dataclasses.dataclass(frozen=True, kw_only=True)
class MutualInformation(Selector):
    """The ``n`` features that share most information with the target.

    :param bins: Quantile bins of every feature, and of the target of a regression; None
        counts every value by itself.
    """

    n: int
    problem: Problem
    bins: int | None = 32

    def select(self, matrix: FeatureMatrix) -> list[bool]:
        if self.n >= matrix.width:
            return [True] * matrix.width
        scores = [0.0] * matrix.width
        for row in mutual_information(matrix, bins=self.bins).collect():
            scores[row["feature"]] = row["information"]
        return top(scores, self.n)


def mutual_information(matrix: FeatureMatrix, *, bins: int | None = None) -> DataFrame:
    """Mutual information (in nats) of each feature with the target, from counts.

    The estimator follows from ``bins`` alone, never from the data.  With None every value of a
    feature and of the target counts by itself.  With a number, every feature is cut at its
    exact quantiles into that many bins (fewer where quantiles are equal), and so is the target of a
    regression; classes count by themselves.  Missing features count as 0,
    infinite ones as the largest number.

    Tasks count first, so what is shuffled is a row per value and target per batch, or a row per
    bin and target per task.
    """
    width = matrix.width
    largest = f"{sys.float_info.max!r}D"
    rows = matrix.frame.selectExpr(
        "transform(concat(features, array(label)), "
        f"x -> greatest(-{largest}, least({largest}, coalesce(nanvl(x, 0D), 0D)))) AS x",
    )
    cut = [] if bins is None else [*range(width), *([width] if matrix.problem is Problem.regression else [])]
    limits = _bin_limits(rows, cut, bins)
    names = ["feature", "bin", "target", "n"]
    classes = max(1, len(matrix.classes or ()))

    def listed(f: int, values: np.ndarray, targets: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(n), f, np.int32), values.astype(float), targets.astype(float), n.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_matrix(batch.column(0), width + 1)
            classes, target = np.unique(x[:, -1], return_inverse=True)
            for f in range(width):
                values, place = np.unique(x[:, f], return_inverse=True)
                codes, n = np.unique(place * len(classes) + target, return_counts=True)
                yield listed(f, values[codes // len(classes)], classes[codes % len(classes)], n)

    def count_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets = len(limits[width]) + 1 if width in limits else classes
        counts = [np.zeros((len(limits[f]) + 1) * targets, np.int64) for f in range(width)]
        for batch in batches:
            x = as_matrix(batch.column(0), width + 1)
            target = np.searchsorted(limits[width], x[:, -1], "left") if width in limits else x[:, -1].astype(np.int64)
            for f in range(width):
                codes = np.searchsorted(limits[f], x[:, f], "left") * targets + target
                counts[f] += np.bincount(codes, minlength=len(counts[f]))
        for f, n in enumerate(counts):
            codes = np.flatnonzero(n)
            yield listed(f, codes // targets, codes % targets, n[codes])

    if bins is not None:
        count = count_bins
    counted = rows.mapInArrow(count, "feature int, bin double, target double, n long")
    cells = counted.groupBy("feature", "bin", "target").agg(F.sum("n").alias("n"))

    by_bin = cells.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_target = cells.groupBy("feature", "target").agg(F.sum("n").alias("nt"))
    by_feature = cells.groupBy("feature").agg(F.sum("n").alias("total"))
    return (
        cells.join(by_bin, ["feature", "bin"])
        .join(by_target, ["feature", "target"])
        .join(by_feature, "feature")
        .groupBy("feature")
        .agg(F.expr("sum(n / total * ln(n * CAST(total AS DOUBLE) / nb / nt))").alias("information"))
    )


def _bin_limits(rows: DataFrame, cut: list[int], bins: int | None) -> dict[int, np.ndarray]:
    """Upper limits of the bins of some elements of the array ``x``: its quantiles."""
    shares = [k / bins for k in range(1, bins)] if bins else []
    return {f: np.unique(values) for f, values in array_quantiles(rows, "x", cut, shares).items()}


@dataclasses.dataclass(frozen=True, kw_only=True)
class PermutationImportance(Selector):
    """The ``n`` features whose permutation costs a fitted predictor most.

    The cost is the mean loss of score over the repeats, minus two standard deviations.
    """

    n: int
    predictor: PredictionMethod
    repeats: int = 5
    seed: int = 0

    def select(self, matrix: FeatureMatrix) -> list[bool]:
        if self.n >= matrix.width:
            return [True] * matrix.width
        fitted = self.predictor.fit(matrix)
        losses = permutation_losses(matrix, fitted, repeats=self.repeats, seed=self.seed)
        return top([float(np.mean(v) - 2 * np.std(v)) for v in losses], self.n)


def permutation_losses(
    matrix: FeatureMatrix,
    fitted: FittedTrees,
    *,
    repeats: int = 5,
    seed: int = 0,
) -> list[list[float]]:
    """Loss of score (accuracy or R²) when one feature is permuted: features x repeats.

    One self-join per repeat gives every row a donor.  Tasks answer for each row as it is and
    with every feature in turn taken from the donor, in one evaluation of the trees over whole
    Arrow batches; a row per task and feature leaves them.  Features that the model does not
    use cannot lose anything.
    """
    numbered, rows = indexed(matrix.frame.select("features", "label"))
    losses = [[0.0] * repeats for _ in range(matrix.width)]
    ensemble = read_ensemble(matrix.frame.sparkSession, fitted)
    used = sorted({int(f) for leaf in ensemble.leaves for f in leaf.features})
    spread_of = None
    if matrix.problem is Problem.regression:
        spread_of = numbered.agg(F.var_pop("label")).first()[0]
    if not used or not rows or spread_of == 0:
        return losses
    width, fills = matrix.width, np.array(fitted.fills)
    classes = matrix.problem is Problem.classification

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(used) + 1), 0
        swapped_of = swapped_function(ensemble, used)
        for batch in (b.slice(low, STEP) for b in batches for low in range(0, b.num_rows, STEP)):
            own, donor = (np.where(np.isnan(x), fills, x) for x in (as_matrix(batch.column(c), width) for c in ("features", "donor")))
            label = batch.column("label").to_numpy(zero_copy_only=False)
            given = ~np.isnan(label)
            plain, swapped = swapped_of(own, donor)
            found = np.concatenate([answers(plain, classes)[None], answers(swapped, classes)])[:, given]
            total += ((found != label[given]) if classes else (found - label[given]) ** 2).sum(axis=1)
            n += int(given.sum())
        columns = [np.array([-1, *used], np.int32), total, np.full(len(total), n, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["permuted", "error", "n"])

    for repeat in range(repeats):
        donated = with_donors(numbered, rows, seed + repeat).select("label", "features", "donor")
        summed = donated.mapInArrow(errors, "permuted int, error double, n long").groupBy("permuted")
        mean = {row[0]: row[1] for row in summed.agg(F.expr("try_divide(sum(error), sum(n))")).collect()}
        if mean[-1] is None:
            return losses
        for feature in used:
            losses[feature][repeat] = (mean[feature] - mean[-1]) / (spread_of or 1.0)
    return losses



@dataclasses.dataclass(frozen=True, kw_only=True)
class Boruta(Selector):
    """Features that beat the best of their permuted copies more often than chance would.

    In each trial the predictor is fitted to all undecided features and to a permuted
    (shadow) copy of each; a hit is an importance above that of every shadow.  Features
    with significantly few hits are dropped on the way; accepted and undecided ones stay.

    :param importance: How to measure importance: ``shap``, ``gini`` or ``perm``.
    """

    importance: Literal["shap", "gini", "perm"] = "shap"
    predictor: PredictionMethod
    problem: Problem
    trials: int = 20
    pvalue: float = 0.05
    seed: int = 0

    def select(self, matrix: FeatureMatrix) -> list[bool]:
        numbered, rows = indexed(matrix.frame.select("features", "label"))
        hits = [0] * matrix.width
        active = list(range(matrix.width))
        # every feature is tested twice, so both tests share the corrected level
        level = self.pvalue / max(1, matrix.width)
        accepted: set[int] = set()
        for trial in range(1, self.trials + 1):
            if not set(active) - accepted:
                break
            scores, best_shadow = self._scores(matrix, numbered, rows, active, trial)
            for feature, score in zip(list(active), scores):
                hits[feature] += score > best_shadow
            for feature in list(active):
                if feature in accepted:
                    continue
                if binomial_tail(hits[feature], trial) < level:
                    accepted.add(feature)
                elif binomial_tail(trial - hits[feature], trial) < level:
                    active.remove(feature)
        return [i in active for i in range(matrix.width)]

    def _scores(
        self,
        matrix: FeatureMatrix,
        numbered: DataFrame,
        rows: int,
        active: list[int],
        trial: int,
    ) -> tuple[list[float], float]:
        chosen = F.array(*(F.lit(i) for i in active))
        donated = with_donors(numbered, rows, self.seed + trial)
        doubled = donated.select(
            "label",
            F.concat(
                F.transform(chosen, lambda i: F.get(F.col("features"), i)),
                F.transform(chosen, lambda i: F.get(F.col("donor"), i)),
            ).alias("features"),
        )
        # each of the passes over a trial would join and shuffle all rows again
        parts = max(doubled.sparkSession.sparkContext.defaultParallelism, -(-rows // TRIAL_ROWS))
        doubled = materialise(doubled.repartition(parts), "trial")
        names = [str(i) for i in range(2 * len(active))]
        trial_matrix = dataclasses.replace(matrix, frame=doubled, names=names)
        fitted = self.predictor.fit(trial_matrix)
        match self.importance:
            case "shap":
                scores = mean_impacts(doubled, fitted, len(names))
            case "gini":
                scores = fitted.importances
            case _:
                scores = [float(np.mean(v)) for v in permutation_losses(trial_matrix, fitted, repeats=1)]
        release(doubled)
        return scores[: len(active)], max(scores[len(active) :])


def binomial_tail(successes: int, trials: int) -> float:
    """Probability of at least this many successes in fair coin flips."""
    return sum(math.comb(trials, k) for k in range(successes, trials + 1)) / 2**trials
