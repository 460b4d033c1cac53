"""Infer the attributes of columns from their types and values."""

from __future__ import annotations

import dataclasses
import functools
import weakref
from collections.abc import Collection, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.functions import quote
from featloom.schema import Attribute, Column, Table

# A column with at most this many distinct values is categorical.
MAX_CATEGORIES = 50

# Size of the distinct-count sketches: 2^12 registers, a standard error of 1.6 %.
SKETCH_REGISTERS_LOG2 = 12

# Below this ratio of sketched distinct values to rows a column cannot be a key (six errors away).
NEARLY_UNIQUE = 0.9

# At most this many exact distinct counts share one scan (each expands the rows once).
DISTINCT_COLUMNS_PER_SCAN = 16

_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType, getattr(T, "TimeType", T.DateType))
_FLOATING = (T.FloatType, T.DoubleType)


@dataclasses.dataclass(frozen=True)
class ColumnProfile:
    """Counts of one column.  Null counts as one distinct value."""

    name: str
    rows: int
    nulls: int
    distinct: int | None
    exact: bool


def is_profiled(kind: T.DataType) -> bool:
    """Whether values of the type can be counted as distinct and tagged."""
    return isinstance(kind, (T.BooleanType, T.NumericType, T.StringType, *_TEMPORAL))


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, _FLOATING)


def type_attributes(kind: T.DataType) -> set[Attribute]:
    """Attributes that follow from the type alone."""
    if isinstance(kind, T.BooleanType):
        return {Attribute.boolean}
    if isinstance(kind, T.NumericType):
        return {Attribute.numeric}
    if isinstance(kind, T.StringType):
        return {Attribute.textual}
    if isinstance(kind, _TEMPORAL):
        return {Attribute.temporal}
    return set()


def profile(frame: DataFrame, *, exact: bool = False, names: Collection[str] | None = None) -> list[ColumnProfile]:
    """Count rows, nulls and distinct values of every column, or of those of some names.

    The first scan counts nulls and sketches distinct values.  Distinct counts are then
    made exact only where they can decide an attribute: few values (categorical?) or
    nearly as many as rows (a key?).  ``exact=True`` makes all of them exact.
    """
    fields = [f for f in frame.schema.fields if names is None or f.name in names]
    counted = [f for f in fields if is_profiled(f.dataType)]
    first = frame.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count(F.col(quote(f.name))).alias(f"present {i}") for i, f in enumerate(fields)),
        *(
            F.expr(_sketch(quote(f.name))).alias(f"sketch {f.name}")
            for f in counted
        ),
    ).first()
    rows = first["rows"]
    kinds = {f.name: f.dataType for f in fields}
    nulls = {f.name: rows - first[f"present {i}"] for i, f in enumerate(fields)}
    sketch = {f.name: first[f"sketch {f.name}"] for f in counted}

    few = [n for n, d in sketch.items() if d <= 4 * MAX_CATEGORIES]
    many = [n for n, d in sketch.items() if n not in few and (exact or d >= NEARLY_UNIQUE * (rows - nulls[n]))]

    distinct: dict[str, int] = {}
    if few:
        # a bounded set per column: one scan without any expansion of rows
        found = frame.agg(*(F.size(F.collect_set(F.col(quote(n)))).alias(n) for n in few)).first()
        distinct |= found.asDict()
    for start in range(0, len(many), DISTINCT_COLUMNS_PER_SCAN):
        chunk = many[start : start + DISTINCT_COLUMNS_PER_SCAN]
        found = frame.agg(*(F.expr(_distinct(n, kinds[n], exact)).alias(n) for n in chunk)).first()
        distinct |= found.asDict()

    result = []
    for field in fields:
        name = field.name
        known = distinct.get(name, sketch.get(name))
        result.append(
            ColumnProfile(
                name=name,
                rows=rows,
                nulls=nulls[name],
                distinct=None if known is None else known + (nulls[name] > 0),
                exact=name in distinct,
            ),
        )
    return result


def _sketch(x: str) -> str:
    """Approximate number of distinct non-null values, from one mergeable sketch."""
    hashed = f"CASE WHEN {x} IS NOT NULL THEN xxhash64({x}) END"
    return f"hll_sketch_estimate(hll_sketch_agg({hashed}, {SKETCH_REGISTERS_LOG2}))"


def _distinct(name: str, kind: T.DataType, exact: bool) -> str:
    """Exact distinct count.

    Long texts are told apart by 128 bits of hashes, so that the shuffle does not carry
    them.  As many distinct hashes as rows prove that the texts are distinct.
    """
    x = quote(name)
    if exact or not isinstance(kind, T.StringType):
        return f"count(DISTINCT {x})"
    return f"count(DISTINCT CASE WHEN {x} IS NOT NULL THEN struct(xxhash64({x}), xxhash64('', {x})) END)"


def attributes_of(kind: T.DataType, counts: ColumnProfile) -> frozenset[Attribute]:
    """Attributes of a column with the given type and counts."""
    found = type_attributes(kind)
    if counts.nulls == 0:
        found.add(Attribute.not_null)
    if counts.distinct is not None:
        if counts.exact and counts.distinct <= MAX_CATEGORIES:
            found.add(Attribute.categorical)
        if counts.exact and counts.distinct == counts.rows:
            found.add(Attribute.primary_key)
    return frozenset(found)


class ProfiledTable(Table):
    """A table whose columns are profiled when something asks for their attributes.

    Names, rows and narrower tables need no profile.  What was counted is kept with the frame, so
    no column of a frame is counted twice, and columns that nobody asks about never are.
    """

    def __init__(self, frame: DataFrame, name: str, names: Sequence[str], *, exact: bool) -> None:
        super().__init__(name=name, columns=[Column(name=n) for n in names], data=frame)
        for late in ("columns", "unique_on", "max_rows"):
            del self.__dict__[late]
        self._exact = exact

    @property
    def names(self) -> list[str]:
        return list(self._exprs)

    def narrow(self, names: Iterable[str]) -> Table:
        chosen = set(names)
        return ProfiledTable(self.frame, self.name, [n for n in self.names if n in chosen], exact=self._exact)

    @functools.cached_property
    def _counts(self) -> dict[str, ColumnProfile]:
        known = _known.setdefault(self.frame, {}).setdefault(self._exact, {})
        unknown = [n for n in self.names if n not in known]
        if unknown:
            known.update((c.name, c) for c in profile(self.frame, exact=self._exact, names=unknown))
        return known

    @functools.cached_property
    def columns(self) -> list[Column]:
        kinds = {f.name: f.dataType for f in self.frame.schema.fields}
        return [Column(name=n, attributes=attributes_of(kinds[n], self._counts[n])) for n in self.names]

    @functools.cached_property
    def unique_on(self) -> frozenset[str] | None:
        keys = [c.name for c in self.columns if c.is_key]
        return frozenset(keys[:1]) or None

    @functools.cached_property
    def max_rows(self) -> int | None:
        return next((c.rows for c in self._counts.values()), None)


# Counts of the columns of a frame, by exactness and name.
_known: weakref.WeakKeyDictionary[DataFrame, dict[bool, dict[str, ColumnProfile]]] = weakref.WeakKeyDictionary()


def table(frame: DataFrame, name: str, *, exact: bool = False) -> Table:
    """Wrap a frame as a table; attributes are inferred on demand."""
    return ProfiledTable(frame, name, frame.columns, exact=exact)


def profile_frame(frame: DataFrame) -> DataFrame:
    """The exact profile as a DataFrame: one row per column.

    Only the counts pass through the driver: one row per column of the input.
    """
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    rows = []
    for counts in profile(frame, exact=True):
        found = attributes_of(kinds[counts.name], counts)
        rows.append(
            (
                counts.name,
                counts.rows,
                counts.nulls,
                counts.distinct,
                *(attribute in found for attribute in Attribute),
            ),
        )
    schema = "column_name string, row_count long, null_count long, distinct_count long, " + ", ".join(
        f"is_{attribute.name} boolean" for attribute in Attribute
    )
    return frame.sparkSession.createDataFrame(rows, schema)
