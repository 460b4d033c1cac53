"""Pairwise correlation of many features in a few passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.learning.matrix import FeatureMatrix, as_matrix, summarise
from featloom.learning.rank_correlation import kendall, spearman

METHODS = ("pearson", "spearman", "kendall")


def pair_correlations(matrix: FeatureMatrix, method: str = "pearson") -> DataFrame:
    """Correlation ``r`` of all pairs of features ``i < j`` over rows in which both are present.

    An undefined correlation (of a constant feature, say) is null.
    """
    if method == "pearson":
        return _pearson(matrix)
    if method == "spearman":
        return spearman(matrix)
    if method == "kendall":
        return kendall(matrix)
    raise ValueError(f"unknown correlation method {method}")


def _pearson(matrix: FeatureMatrix) -> DataFrame:
    """Masked products of each Arrow batch, added up per task and then per pair."""
    width = matrix.width
    centre = np.array([s.mean for s in summarise(matrix)])
    first, second = np.triu_indices(width, k=1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss, sp = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column(0), width) - centre
            given = ~np.isnan(x)
            mask, x = given.astype(float), np.where(given, x, 0.0)
            n += mask.T @ mask
            s += x.T @ mask
            ss += (x * x).T @ mask
            sp += x.T @ x
        columns = [first.astype(np.int32), second.astype(np.int32), n[first, second]]
        columns += [s[first, second], s[second, first], ss[first, second], ss[second, first], sp[first, second]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
        )

    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    sums = (
        matrix.frame.select("features")
        .mapInArrow(partial, schema)
        .groupBy("i", "j")
        .agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    )
    # relative thresholds: a spread that is only rounding noise counts as none
    return sums.selectExpr(
        "i",
        "j",
        "n * sxx - sx * sx AS vx",
        "n * syy - sy * sy AS vy",
        "n * sxy - sx * sy AS v",
        "n * sxx AS wx",
        "n * syy AS wy",
    ).selectExpr(
        "i",
        "j",
        "CASE WHEN vx > 1e-14 * wx AND vy > 1e-14 * wy "
        "THEN greatest(-1D, least(1D, v / sqrt(vx) / sqrt(vy))) END AS r",
    )

