"""Transforms over collections of tables."""

from featloom.operators.aggregate import Aggregate
from featloom.operators.cast import Cast
from featloom.operators.collect import Collect
from featloom.operators.columns import (
    Drop,
    Keep,
    Rename,
    Require,
    declare_key,
    drop_related,
    redact,
    with_attributes,
)
from featloom.operators.combine import Combine
from featloom.operators.compose import AllOf, AnyOf, Identity, Transform
from featloom.operators.encode import Encode, Impute
from featloom.operators.extract import Extract, assemble, split_feature_name
from featloom.operators.filters import Filter, Window
from featloom.operators.join import Join
from featloom.operators.union import Union

__all__ = [
    "Aggregate",
    "AllOf",
    "AnyOf",
    "Cast",
    "Collect",
    "Combine",
    "Drop",
    "Encode",
    "Extract",
    "Filter",
    "Identity",
    "Impute",
    "Join",
    "Keep",
    "Rename",
    "Require",
    "Transform",
    "Union",
    "Window",
    "assemble",
    "declare_key",
    "drop_related",
    "redact",
    "split_feature_name",
    "with_attributes",
]
