"""Words, lines and shingles of whole texts, vectorised over the bytes of Arrow batches.

A word is a run of ``[^\\x20\\x09-\\x0D]`` characters.  All separators are single bytes in
UTF-8, so words are found on the bytes, without decoding.  Words are compared by 64-bit
hashes: a polynomial over random values of the bytes, mixed with the length.

Batches are cut into chunks of whole texts (``CHUNK`` bytes, or one longer text), so the
memory of a task follows the longest text and never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
#: Rows whose texts are copied at a time, so that a batch is never held several times.
ROWS = 1 << 12
_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_SLOT = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (the splitmix64 finaliser)."""
    x = values + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i below ``count``."""
    known = _powers.get(base)
    if known is None or len(known) < count:
        known = np.full(max(count, 1024), base % (1 << 64), np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if count <= 2 * CHUNK:
            _powers[base] = known
    return known[:count]


def segment_hash(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Position-dependent hash of the values from each start up to the next one."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    sums = np.add.reduceat(values * powers(_BASE, len(values)), starts)
    return sums * powers(inverse, len(values))[starts]


@dataclass
class Chunk:
    """Whole texts, end to end; ``first`` is the row of the first of them in its batch."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, for work that holds whole texts as Python strings."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


@dataclass
class Words:
    """Words of a chunk, in order."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # index of the text of each word
    hash: np.ndarray
    count: np.ndarray  # words of each text
    first: np.ndarray  # index of the first word of each text


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of a column of texts; null is empty."""
    for first in range(0, len(column), ROWS):
        part = column.slice(first, ROWS)
        if isinstance(part, pa.ChunkedArray):
            part = part.combine_chunks()
        part = pc.fill_null(part.cast(pa.large_string()), "")
        _, offsets, data = part.buffers()
        bounds = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        low = 0
        while low < len(part):
            high = int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1
            high = min(max(high, low + 1), len(part))
            yield Chunk(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], first + low)
            low = high


def words(chunk: Chunk, *, lower: bool = False, apart: bytes = b"") -> Words:
    """All words; ``lower`` compares A-Z as a-z, ``apart`` are further ASCII separators."""
    space = _SPACE
    if apart:
        space = _SPACE.copy()
        space[list(apart)] = True
    solid = ~space[chunk.data]
    filled = np.flatnonzero(np.diff(chunk.offsets) > 0)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = chunk.offsets[:-1][filled]
    begins[heads] = solid[heads]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    tails = chunk.offsets[1:][filled] - 1
    ends[tails] = solid[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, chunk.offsets)
    values = (_LOWER if lower else _BYTE)[chunk.data]
    values[~solid] = 0
    hashed = mix(segment_hash(values, start) ^ (end - start).astype(np.uint64))
    count = np.diff(first)
    return Words(start, end, np.repeat(np.arange(len(chunk)), count), hashed, count, first[:-1])


def windows(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of ``width`` words inside one text."""
    total = len(found.hash)
    if total < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(found.text[: total - width + 1] == found.text[width - 1 :])
    hashed = np.zeros(len(at), np.uint64)
    for i in range(width):
        hashed += found.hash[at + i] * _SLOT[i]
    return at, mix(hashed)


def shingles(found: Words, width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; with fewer words, the whole sequence as one."""
    at, hashed = windows(found, width)
    bounds = np.searchsorted(at, np.append(found.first, len(found.hash)))
    sets = []
    for text, count in enumerate(found.count):
        if count >= width:
            sets.append(np.unique(hashed[bounds[text] : bounds[text + 1]]))
        elif count:
            own = found.hash[found.first[text] : found.first[text] + count] * _SLOT[width : width + count]
            sets.append(mix(np.array([own.sum() ^ np.uint64(count)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def lines(chunk: Chunk, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines that hold a word: text of each, number of each in its text, its first word.

    Lines are what ``\\n`` separates, numbered from 0 and empty ones included.
    """
    breaks = np.concatenate([[0], np.cumsum(chunk.data == 10)])
    number = breaks[found.start] - breaks[chunk.offsets[:-1]][found.text]
    new = np.ones(len(found.start), bool)
    new[1:] = (found.text[1:] != found.text[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    return found.text[first], number[first], first


def line_hash(found: Words, first: np.ndarray) -> np.ndarray:
    """Hash of each line as a sequence of words, so white space does not count."""
    lengths = np.diff(np.append(first, len(found.hash))).astype(np.uint64)
    return mix(segment_hash(found.hash, first) ^ lengths)


def raw_line_hash(chunk: Chunk, found: Words, first: np.ndarray) -> np.ndarray:
    """Hash of each line with all its bytes."""
    breaks = np.flatnonzero(chunk.data == 10)
    filled = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
    starts = np.union1d(filled, breaks[breaks + 1 < len(chunk.data)] + 1)
    values = _BYTE[chunk.data]
    values[breaks] = 0
    lengths = np.diff(np.append(starts, len(chunk.data)))
    ends = np.append(starts[1:], len(chunk.data)) - 1
    lengths = lengths - (chunk.data[ends] == 10) if len(starts) else lengths
    hashed = mix(segment_hash(values, starts) ^ lengths.astype(np.uint64))
    return hashed[np.searchsorted(starts, found.start[first], "right") - 1]


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's ``long``."""
    return values.view(np.int64)


def per_text(values: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    """Sum of values by text."""
    return np.bincount(text, weights=values, minlength=count).astype(np.int64)


def code_points(data: np.ndarray) -> np.ndarray:
    """True for each byte that begins a code point."""
    return (data & 0xC0) != 0x80
