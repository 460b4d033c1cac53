"""Feature selection, prediction and explanation on Spark ML."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules["featloom"])

from featloom.learning.correlation import pair_correlations  # noqa: E402
from featloom.learning.matrix import FeatureMatrix, feature_matrix  # noqa: E402
from featloom.learning.model import Model, Prediction  # noqa: E402
from featloom.learning.predictors import (  # noqa: E402
    PREDICTION_METHODS,
    Baseline,
    BoostedTrees,
    PredictionMethod,
    RandomForest,
)
from featloom.learning.selectors import (  # noqa: E402
    Boruta,
    Correlation,
    FeatureImportance,
    MutualInformation,
    PermutationImportance,
    Selector,
    ShapelyImpact,
)

__all__ = [
    "PREDICTION_METHODS",
    "Baseline",
    "BoostedTrees",
    "Boruta",
    "Correlation",
    "FeatureImportance",
    "FeatureMatrix",
    "Model",
    "MutualInformation",
    "PermutationImportance",
    "Prediction",
    "PredictionMethod",
    "RandomForest",
    "Selector",
    "ShapelyImpact",
    "feature_matrix",
    "pair_correlations",
]
