"""Statistics of many small groups and slices at a time, on Arrow batches sorted by key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.functions import quote

# Rows that a task aggregates at a time.
CHUNK = 1 << 19

# Bits of a limb of a wide sum.
LIMB_BITS = 21

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_KEYS = (*_WHOLE, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def scannable(frame: DataFrame, keys: Sequence[str], kinds: Sequence[T.DataType]) -> bool:
    """Whether all values are plain numbers, and keys are equal if they are the same."""
    types = [frame.schema[k].dataType for k in keys]
    plain = all(isinstance(t, _KEYS) and (not isinstance(t, T.StringType) or type(t) is T.StringType and t.collation == "UTF8_BINARY") for t in types)
    return bool(keys) and plain and all(isinstance(k, (*_WHOLE, T.FloatType, T.DoubleType)) for k in kinds)


def scan_groups(
    frame: DataFrame, keys: Sequence[str], kinds: Sequence[T.DataType], slices: Sequence[str | None], *, chunk: int = CHUNK,
) -> DataFrame:
    """Row count ``rows j`` of each slice and, per column ``value i``, what statistics follow from:
    ``n j i``, ``sum``, ``max``, ``min``, ``var`` and ``median``.

    Rows are shuffled and sorted by key.  A task orders each column once inside the groups of a chunk;
    a slice keeps that order, so its extremes and medians are read at their places.

    :param slices: Boolean column per slice, or None for all rows.
    :param chunk: Rows that a task aggregates at a time; a group is never cut.
    """
    columns = range(len(kinds))
    whole = [isinstance(k, _WHOLE) for k in kinds]
    wide = [isinstance(k, T.LongType) for k in kinds]
    flags = list(dict.fromkeys(s for s in slices if s is not None))
    fields = [T.StructField(k, frame.schema[k].dataType) for k in keys]
    for j in range(len(slices)):
        fields.append(T.StructField(f"rows {j}", T.LongType()))
        for i in columns:
            total = T.LongType() if whole[i] else T.DoubleType()
            parts = {"n": T.LongType(), **({f"limb {k}": total for k in range(3)} if wide[i] else {"sum": total})}
            parts |= {"max": kinds[i], "min": kinds[i], "var": T.DoubleType(), "median": T.DoubleType()}
            fields += [T.StructField(f"{part} {j} {i}", kind) for part, kind in parts.items()]
    schema = T.StructType(fields)
    width = len(keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows, enough = 0, chunk
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                rows += batch.num_rows
            if rows >= enough:
                table = pa.Table.from_batches(waiting).combine_chunks()
                starts = _starts(table, width)
                whole_groups = int(starts[-1])
                if whole_groups:
                    yield from aggregate(table.slice(0, whole_groups), starts[:-1])
                waiting = table.slice(whole_groups).to_batches()
                rows = table.num_rows - whole_groups
                enough = rows + chunk
        if rows:
            table = pa.Table.from_batches(waiting).combine_chunks()
            yield from aggregate(table, _starts(table, width))

    def aggregate(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        groups, n = len(starts), table.num_rows
        group = np.repeat(np.arange(groups), np.diff(np.append(starts, n)))
        taken = {s: _flag(table.column(s)) for s in flags}
        sorted_columns = []
        for i in columns:
            column = table.column(f"value {i}")
            given = np.flatnonzero(column.is_valid().to_numpy())
            value = column.drop_null().to_numpy()
            own = group[given]
            order = np.lexsort((value.astype(np.float64) if not whole[i] else value, own))
            sorted_columns.append((given[order], value[order], own[order]))
        out = [table.column(k).take(pa.array(starts)) for k in keys]
        for s in slices:
            here = None if s is None else taken[s]
            out.append(np.bincount(group if here is None else group[here], minlength=groups))
            for i, (row, value, own) in enumerate(sorted_columns):
                if here is not None:
                    chosen = here[row]
                    value, own = value[chosen], own[chosen]
                out += _statistics(value, own, groups, whole[i], wide[i])
        arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in out]
        arrays = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for a in arrays]
        yield from pa.table(arrays, names=schema.names).to_batches(max_chunksize=max(1, 2_000_000 // len(arrays)))

    named = frame.select(*(F.col(quote(k)) for k in keys), *(f"value {i}" for i in columns), *(F.col(quote(s)) for s in flags))
    by = [F.col(quote(k)) for k in keys]
    found = named.repartition(*by).sortWithinPartitions(*by).mapInArrow(scan, schema)
    if not any(wide):
        return found
    listed = []
    for f in fields:
        part, *tag = f.name.split(" ", 2) if f.name not in keys else (f.name,)
        if part != "limb":
            listed.append(quote(f.name))
        elif tag[0] == "0":
            sums = (f"CAST({quote(f'limb {k} {tag[1]}')} AS DECIMAL(38, 0)) * {1 << LIMB_BITS * k}BD" for k in range(3))
            listed.append(f"{' + '.join(sums)} AS {quote(f'sum {tag[1]}')}")
    return found.selectExpr(*listed)


def _flag(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, False).to_numpy()


def _starts(chunk: pa.Table, keys: int) -> np.ndarray:
    """First rows of the groups of sorted rows; null is a key."""
    new = np.zeros(chunk.num_rows, dtype=bool)
    new[0] = True
    for column in chunk.columns[:keys]:
        codes = column.combine_chunks().dictionary_encode("encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _statistics(value: np.ndarray, own: np.ndarray, groups: int, whole: bool, wide: bool) -> list[pa.Array]:
    """Statistics of values in ascending order inside their groups, NaN last."""
    n = np.bincount(own, minlength=groups)
    none = n == 0
    last = np.cumsum(n)
    first = last - n

    def present(values: np.ndarray, absent: np.ndarray) -> pa.Array:
        return pa.array(values, mask=absent)

    def at(places: np.ndarray) -> np.ndarray:
        return value[np.clip(places, 0, max(0, len(value) - 1))] if len(value) else np.zeros(groups, value.dtype)

    def summed(values: np.ndarray) -> np.ndarray:
        running = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
        return running[last] - running[first]

    number = value.astype(np.float64)
    nans = np.zeros(groups, np.int64) if whole else np.bincount(own[np.isnan(number)], minlength=groups)
    with np.errstate(all="ignore"):
        total = np.bincount(own, weights=number, minlength=groups)
        away = number - (total / n)[own]
        var = np.bincount(own, weights=away * away, minlength=groups) / (n - 1)
        low, high = at(first + (n - 1) // 2).astype(np.float64), at(first + n // 2).astype(np.float64)
        median = np.where((low == high) | (np.isnan(low) & np.isnan(high)), low, 0.5 * low + 0.5 * high)
    if wide:
        mask = (1 << LIMB_BITS) - 1
        limbs = (value & mask, (value >> LIMB_BITS) & mask, value >> 2 * LIMB_BITS)
        sums = [present(summed(limb), none) for limb in limbs]
    else:
        sums = [present(summed(value) if whole else total, none)]
    real = n - nans
    return [
        pa.array(n), *sums,
        present(at(first + real - 1), real == 0), present(at(first), real == 0),
        present(var, n < 2), present(median, none),
    ]
