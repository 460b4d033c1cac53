"""Source divergence audit: how far the word frequencies of the sources of a language lie apart.

Gustavson row accumulation: the kept terms form a term-major index (term to sources and counts).
For each group, the postings of its terms are scattered into a dense accumulator with a cell per
peer, so pairs of postings never leave a task.  Terms that a group or its peer lacks have a
probability of their own; their part is a baseline over distinct prices (zero counts included),
which the scattered cells correct where both groups hold the term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featloom.llm.words import CHUNK, chunks, words
from featloom.plans.storage import materialise, release

#: ASCII characters that part terms, besides white space: all but letters.
APART = bytes(c for c in range(128) if not chr(c).isalpha())
#: Probabilities are integers of this unit.
UNIT = 1_000_000_000
#: Above this, a count times UNIT leaves 64 bits.
WIDE = 9_000_000_000
#: Postings of one block of the index, about: what a task holds at a time.
BLOCK = 500_000
#: Postings that are scattered in one step.
STEP = 1 << 18
#: Counted terms that a task gathers before it hands them on.
GATHER = 1 << 19

_COUNTS = "lang string, source string, term string, n long, df long"


class _Counts:
    """Terms of a task by group, merged as they come: group, 64-bit hash, count, documents, term."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.pieces: list[tuple[np.ndarray, ...]] = []
        self.terms: list[pa.Array] = []
        self.size = self.merged = 0

    def add(self, group, hashed, n, df, terms) -> None:
        self.pieces.append((group, hashed, n, df))
        self.terms.append(terms)
        self.size += len(hashed)
        if self.size > self.merged + GATHER:
            self.merge()

    def merge(self) -> None:
        if not self.pieces:
            return
        group, hashed, n, df = (np.concatenate(c) for c in zip(*self.pieces))
        terms = pa.concat_arrays(self.terms)
        order = np.lexsort((hashed, group))
        group, hashed, n, df = group[order], hashed[order], n[order], df[order]
        first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (hashed[1:] != hashed[:-1]))) if len(order) else order
        total = (lambda c: np.add.reduceat(c, first)) if len(first) else (lambda c: c)
        self.pieces = [(group[first], hashed[first], total(n), total(df))]
        self.terms = [terms.take(pa.array(order[first]))]
        self.size = self.merged = len(first)

    def tell(self) -> pa.RecordBatch:
        self.merge()
        group, _, n, df = self.pieces[0] if self.pieces else (np.zeros(0, np.int64),) * 4
        names = list(self.groups)
        langs, sources = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
        at = pa.array(group)
        terms = self.terms[0] if self.terms else pa.array([], pa.string())
        batch = pa.RecordBatch.from_arrays(
            [langs.take(at), sources.take(at), terms, pa.array(n, pa.int64()), pa.array(df, pa.int64())],
            ["lang", "source", "term", "n", "df"],
        )
        self.clear()
        return batch


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term by group, and every group once with a null term."""
    state = _Counts()
    for batch in batches:
        lang, source = (pc.fill_null(batch.column(c).cast(pa.string()), "").to_pylist() for c in ("lang", "source"))
        code = np.array([state.groups.setdefault(g, len(state.groups)) for g in zip(lang, source)], np.int64)
        for chunk in chunks(batch.column("text"), 2 * CHUNK):
            found = words(chunk, lower=True, apart=APART)
            if not len(found.hash):
                continue
            hashed, first, number = np.unique(found.hash, return_index=True, return_inverse=True)
            held, n = np.unique(found.text * len(hashed) + number, return_counts=True)
            group, number = code[chunk.first + held // len(hashed)], held % len(hashed)
            order = np.lexsort((number, group))
            group, number, n = group[order], number[order], n[order]
            new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (number[1:] != number[:-1])))
            terms = _spelled(chunk.data, found.start[first], found.end[first])
            state.add(
                group[new],
                hashed[number[new]],
                np.add.reduceat(n, new),
                np.diff(np.append(new, len(n))),
                terms.take(pa.array(number[new])),
            )
            if state.merged > 2 * GATHER:
                yield state.tell()
    yield state.tell()
    names = list(state.groups)
    columns = [[g[0] for g in names], [g[1] for g in names], [None] * len(names), [0] * len(names), [0] * len(names)]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "source", "term", "n", "df"])


def _spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The terms at some places, in lower-case ASCII letters."""
    lengths = end - start
    offsets = np.append(0, np.cumsum(lengths))
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], lengths)
    letters = data[at].copy()
    letters[(letters >= 65) & (letters <= 90)] += 32
    return pa.Array.from_buffers(
        pa.string(), len(start), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes())]
    )


def _price(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Probability of a term in units, never 0: exact for counts of any size."""
    if len(count) and count.max() >= WIDE:
        return np.array([1 + UNIT * (int(c) + 1) // int(t) for c, t in zip(count, total)], np.int64)
    return 1 + UNIT * (count + 1) // total


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // q


def _scatter(key: tuple, index: pa.Table, peers: pa.Table) -> pa.Table:
    """Sums of one block of terms for each group and peer of a language."""
    lang, block = key[0].as_py(), key[1].as_py()
    names = peers.column("source").combine_chunks()
    size = len(names)
    total = peers.column("total").to_numpy()
    zero = _price(np.zeros(size, np.int64), total) if size and total.min() > 0 else np.ones(size, np.int64)
    told: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if block == 0:  # as if no group held any term
        absent = peers.column("kept_terms").to_numpy()[:, None] - peers.column("terms").to_numpy()[:, None]
        empty = (absent - peers.column("terms").to_numpy()[None, :]) * _gap(zero[:, None], zero[None, :])
        one, other = (a.ravel() for a in np.indices((size, size)))
        told.append((one, other, empty.ravel()))
    if index.num_rows:
        told += _rows(index, names, total, zero)
    one, other, value = (np.concatenate(c) for c in zip(*told)) if told else (np.zeros(0, np.int64),) * 3
    kept = one != other
    return pa.table(
        {
            "lang": pa.array([lang] * int(kept.sum()), pa.string()),
            "source": names.take(pa.array(one[kept])),
            "item": names.take(pa.array(other[kept])),
            "value": pa.array(value[kept], pa.int64()),
        }
    )


def _rows(index: pa.Table, names: pa.Array, total: np.ndarray, zero: np.ndarray) -> list[tuple]:
    postings = index.column("postings").combine_chunks()
    flat = postings.flatten()
    holder = pc.index_in(flat.field("source"), value_set=names).to_numpy().astype(np.int64)
    bounds = postings.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    price = _price(flat.field("n").to_numpy(), total[holder])
    term = np.repeat(np.arange(len(postings)), np.diff(bounds))
    by_group = np.argsort(holder, kind="stable")
    group_bounds = np.searchsorted(holder[by_group], np.arange(len(names) + 1))
    everyone = np.arange(len(names))
    told = []
    for group in everyone:
        mine = by_group[group_bounds[group] : group_bounds[group + 1]]
        if not len(mine):
            continue
        cells = np.zeros(len(names), np.int64)  # peers, with this group first
        columns = np.zeros(len(names), np.int64)  # the others, with this group as their peer
        worth, times = np.unique(price[mine], return_counts=True)
        for low in range(0, len(worth), max(1, STEP // len(names))):
            part = slice(low, low + max(1, STEP // len(names)))
            cells += (times[part, None] * _gap(worth[part, None], zero[None, :])).sum(0)
            columns += (times[part, None] * _gap(zero[None, :], worth[part, None])).sum(0)
        width = np.cumsum(np.diff(bounds)[term[mine]])
        low = 0
        while low < len(mine):
            done = width[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(width, done + STEP, "right")))
            some = mine[low:high]
            lengths = np.diff(bounds)[term[some]]
            ends = np.cumsum(lengths)
            at = np.arange(ends[-1]) + np.repeat(bounds[term[some]] - (ends - lengths), lengths)
            p, q, peer = np.repeat(price[some], lengths), price[at], holder[at]
            own = np.full(1, zero[group])
            right = _gap(p, q) - _gap(p, zero[peer]) - _gap(own, q) + _gap(own, zero[peer])
            np.add.at(cells, peer, right)
            low = high
        told += [(np.full(len(names), group), everyone, cells), (everyone, np.full(len(names), group), columns)]
    return told


def _priced(count: Column, total: Column) -> Column:
    """``_price`` in SQL."""
    one = F.lit(1).cast("long")
    narrow = F.call_function("div", (count + one) * F.lit(UNIT).cast("long"), total)
    wide = F.call_function("div", (count + one).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), total.cast("decimal(20,0)"))
    return one + F.when(count < WIDE, narrow).otherwise(wide)


def source_divergence(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = 3, top: int = 200
) -> DataFrame:
    """Divergence of every source from its peers, and the terms that stand out in it.

    A term is a run of letters and characters beyond ASCII, in lower-case ASCII.  Each language
    keeps the terms of at least ``least`` of its documents.  A group (language and source) gives a
    kept term the probability ``p`` of its smoothed count in billionths; a divergence is the sum of
    ``(p - q)**2 / q``, rounded down term by term, all in integers.

    Returns rows (lang, source, part, item, value, rank).  ``pair``: ``item`` is each other source
    of the language and the value is the sum over all kept terms, terms with count 0 included.
    ``term``: the ``top`` kept terms that the group uses more than the language does.

    One pass counts terms in Arrow batches, and merged counts are shuffled.  A row of the index
    holds one number per source, as the result does per pair; the index is cut into blocks of
    terms, so no task holds a language.  Null text, language and source are ``''``; groups without
    terms are groups; an empty table gives an empty result; other columns are not read.
    """
    name = lambda column, alias: F.col(f"`{column}`").cast("string").alias(alias)
    read = docs.select(name(text, "text"), name(lang, "lang"), name(source, "source"))
    counted = read.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term")
    counts = materialise(counted.agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "term-counts")
    index = counts.where("term IS NOT NULL").groupBy("lang", "term")
    index = index.agg(F.sum("n").alias("count"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("postings"))
    index = materialise(index.where(F.col("df") >= least).drop("df"), "term-index")

    held = index.select("lang", "term", "count", F.explode("postings").alias("p")).select("lang", "term", "count", "p.source", "p.n")
    sizes = held.groupBy("lang", "source").agg(F.count("*").alias("terms"), F.sum("n").alias("words"))
    langs = index.groupBy("lang").agg(F.count("*").alias("kept_terms"), F.sum("count").alias("lang_words"))
    groups = counts.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["terms", "words", "kept_terms", "lang_words"])
    groups = groups.withColumn("total", F.col("words") + F.col("kept_terms"))
    groups = materialise(groups.withColumn("lang_total", F.col("lang_words") + F.col("kept_terms")), "term-groups")

    blocks = 1 + (groups.agg(F.sum("terms")).first()[0] or 0) // BLOCK
    numbered = index.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), "postings")
    peers = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(int(blocks) - 1))))
    peers = peers.select("lang", "block", "source", "total", "terms", "kept_terms")
    sums = numbered.groupBy("lang", "block").cogroup(peers.groupBy("lang", "block"))
    sums = sums.applyInArrow(_scatter, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    result = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    p, q = _priced(F.col("n"), F.col("total")), _priced(F.col("count"), F.col("lang_total"))
    terms = held.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    terms = terms.select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    value = F.expr("(p - q) * (p - q) div q").alias("value")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value)

    rank = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    best = terms.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)
    result = materialise(result.withColumn("rank", F.row_number().over(rank)).unionByName(best), "divergence")
    release(counts, index, groups)
    return result
