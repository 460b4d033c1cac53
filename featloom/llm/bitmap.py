"""A filter of fixed size that tells tasks which hashed keys are of interest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 2 MB in every task, whatever the input.
BITS = 1 << 24


def build(keys: DataFrame, name: str) -> np.ndarray:
    """Set the bits of a column of 64-bit keys.

    Tasks and the shuffle OR the bits; at most ``BITS`` / 64 numbers reach the driver.  A full
    filter would let all rows pass and change no result, as rows are joined exactly later.
    """
    bit = f"CAST(pmod(`{name}`, {BITS}) AS INT)"  # also the remainder of the unsigned key
    parts = keys.select(F.expr(f"shiftright({bit}, 6)").alias("word"), F.expr(f"shiftleft(1L, {bit} % 64)").alias("bit"))
    found = parts.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def hits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Indices of the unsigned keys whose bit is set."""
    bit = (keys % np.uint64(BITS)).astype(np.int64)
    return np.flatnonzero((bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1))
