"""Line dedup: deletion-neighbourhood join of lines, verified, the earliest of them kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm import bitmap
from featloom.llm import words as W
from featloom.plans.storage import materialise, release

#: Lines of fewer words only count as duplicates if they are equal.
MIN_WORDS = 8
#: Blocks that a line is cut into for the second, narrower join.
BLOCKS = 8

_LINES = "doc_id long, content long, line int, h1 long, h2 long, keys array<long>"


class Spans:
    """Hashes of any span of words, each in constant time."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes) + 1
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * W.powers(W._BASE, n)[:-1])])
        self.inverse = W.powers(pow(W._BASE, -1, 1 << 64), n)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return W.mix(((self.sums[end] - self.sums[start]) * self.inverse[start]) ^ (end - start).astype(np.uint64))


def _tag(hashes: np.ndarray, *labels: np.ndarray | int) -> np.ndarray:
    for i, label in enumerate(labels):
        hashes = hashes + np.asarray(label).astype(np.uint64) * W._SLOT[20 + i]
    return W.mix(hashes)


def _read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line that holds a word, with the keys of its halves.

    Lines of n and n or n - 1 words that differ by one word share the words before the middle
    or after it.  The middle is that of the shorter one, so a line has keys for both lengths.
    """
    for batch in batches:
        for chunk in W.chunks(batch.column("text")):
            found = W.words(chunk, lower=True)
            text, number, first = W.lines(chunk, found)
            last = np.append(first[1:], len(found.hash))
            n = last - first
            span = Spans(found.hash)
            whole = span(first, last)
            long_enough = np.flatnonzero(n >= MIN_WORDS)
            f, e, m = first[long_enough], last[long_enough], n[long_enough]
            low, high = (m - 1) // 2, m // 2  # of the halves before the middle; one side has one length only
            before = _tag(span(f, f + low), 1)
            after = _tag(span(e - high, e), 2)
            odd = m % 2 == 1
            other = np.where(odd, _tag(span(e - high - 1, e), 2), _tag(span(f, f + high), 1))
            keys = np.stack([before, after, other], axis=1)
            bounds = np.concatenate([[0], np.cumsum(3 * (n >= MIN_WORDS))]).astype(np.int32)
            rows = pa.array(chunk.first + text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows),
                    batch.column("content").take(rows),
                    pa.array(number.astype(np.int32)),
                    pa.array(W.signed(whole)),
                    pa.array(W.signed(_tag(whole ^ W.mix(found.hash[first]), 3))),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(W.signed(keys.reshape(-1)))),
                ],
                [part.split()[0] for part in _LINES.split(", ")],
            )


def _read_words(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Hashed words of the lines that pass the filter."""
    for batch in batches:
        for chunk in W.chunks(batch.column("text")):
            found = W.words(chunk, lower=True)
            _, _, first = W.lines(chunk, found)
            last = np.append(first[1:], len(found.hash))
            whole = Spans(found.hash)(first, last)
            picked = bitmap.hits(bits, whole)
            picked = picked[np.unique(whole[picked], return_index=True)[1]]
            ids = pa.array([found.hash[first[i] : last[i]].tobytes() for i in picked], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(whole[picked])), ids], ["h1", "words"])


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = [np.frombuffer(x.as_py(), np.uint64) for x in column]
    n = np.array([len(t) for t in texts], np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *texts]), np.cumsum(n) - n, n


def _block_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of a line: the words before it and after it, for lengths n and n - 1."""
    for batch in batches:
        hashes, first, n = _unpack(batch.column("words"))
        span = Spans(hashes)
        out = []
        for shorter in (0, 1):
            length = n - shorter
            for block in range(BLOCKS):
                low, high = block * length // BLOCKS, (block + 1) * length // BLOCKS
                at = np.flatnonzero(high > low)
                head = span(first[at], first[at] + low[at])
                tail = span(first[at] + high[at] + shorter, first[at] + n[at])
                out.append((at, _tag(head ^ W.mix(tail), length[at], block), np.full(len(at), shorter), np.full(len(at), block)))
        at, key, shorter, block = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("h1").take(pa.array(at)),
                pa.array(W.signed(key)),
                pa.array(shorter.astype(np.int32)),
                pa.array(block.astype(np.int32)),
            ],
            ["h1", "key", "shorter", "block"],
        )


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deletion neighbourhood inside the blocks that a line shares.

    Role 2: a word taken out, its place remembered; lines with equal variants differ by that
    word at most.  Role 1: a word taken out, role 0: the whole line; a variant of role 1 equal
    to one of role 0 is one deletion away.
    """
    for batch in batches:
        hashes, first, n = _unpack(batch.column("words"))
        span = Spans(hashes)
        shorter = batch.column("shorter").to_numpy()
        block = batch.column("block").to_numpy().astype(np.int64)
        length = n - shorter
        low, high = block * length // BLOCKS, (block + 1) * length // BLOCKS + shorter
        at = np.repeat(np.arange(len(n)), high - low)
        place = np.arange(len(at)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[at]
        head = span(first[at], first[at] + place)
        tail = span(first[at] + place + 1, first[at] + n[at])
        # a deletion is named by its result: the words before and after it as one sequence
        joined = span.sums[first[at] + place] - span.sums[first[at]]
        after = span.sums[first[at] + n[at]] - span.sums[first[at] + place + 1]
        base = W.powers(pow(W._BASE, -1, 1 << 64), 2)[1]
        gone = W.mix(((joined + after * base) * span.inverse[first[at]]) ^ (n[at] - 1).astype(np.uint64))
        replaced = shorter[at] == 0
        key = np.where(replaced, _tag(head ^ W.mix(tail), n[at], place, 5), _tag(gone, 6))
        own = np.flatnonzero(shorter == 0)
        whole = _tag(span(first[own], first[own] + n[own]), 6)
        role = np.concatenate([np.where(replaced, 2, 1), np.zeros(len(own), np.int64)])
        kept = batch.select(["h1", "at"]).take(pa.array(np.concatenate([at, own])))
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(W.signed(np.concatenate([key, whole]))), pa.array(role.astype(np.int32))],
            ["h1", "at", "key", "role"],
        )


def _within_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose word edit distance is at most one."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for row, (x, y) in enumerate(zip(batch.column("words"), batch.column("other_words"))):
            a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            if abs(len(a) - len(b)) <= 1:
                m = min(len(a), len(b))
                unlike = np.flatnonzero(a[:m] != b[:m])
                same = unlike[0] if len(unlike) else m
                skip_a, skip_b = same + (len(a) >= len(b)), same + (len(b) >= len(a))
                keep[row] = np.array_equal(a[skip_a:], b[skip_b:])
        yield batch.select(["h1"]).filter(pa.array(keep))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose key is that of another line too."""
    several = rows.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high")
    return rows.join(several.select("key"), "key")


def _near_lines(spark: SparkSession, docs: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """``h1`` of the lines that are within one word of an earlier line."""
    halves = lines.select("h1", F.explode("keys").alias("key"))
    active = materialise(_shared(halves).select("h1").distinct(), "active")
    bits = spark.sparkContext.broadcast(bitmap.build(active, "h1"))
    read = docs.mapInArrow(lambda batches: _read_words(batches, bits.value), "h1 long, words binary")
    read = read.groupBy("h1").agg(F.any_value("words").alias("words"))
    # rows of lines that only passed the filter by chance end here
    known = firsts.groupBy("h1").agg(F.min("at").alias("at")).join(active, "h1", "left_semi")
    known = materialise(known.join(read, "h1"), "active-lines")

    blocks = known.select("h1", "words").mapInArrow(_block_keys, "h1 long, key long, shorter int, block int")
    blocks = _shared(blocks).select("h1", "shorter", "block").distinct()
    rows = known.join(blocks, "h1")
    kind = known.schema["at"].dataType.simpleString()
    rows = rows.mapInArrow(_variants, f"h1 long, at {kind}, key long, role int")
    rows = materialise(_shared(rows).distinct(), "variants")
    first = [F.min(F.when(F.col("role") == r, F.struct("at", "h1"))).alias(f"first{r}") for r in (0, 1, 2)]
    partner = F.when(F.col("role") == 0, F.col("first1")).when(F.col("role") == 1, F.col("first0"))
    rows = rows.join(rows.groupBy("key").agg(*first), "key")
    rows = rows.withColumn("partner", partner.otherwise(F.col("first2")))
    pairs = rows.where(F.col("partner.at") < F.col("at"))
    pairs = pairs.groupBy("h1").agg(F.min("partner").alias("partner")).select("h1", F.col("partner.h1").alias("other"))
    texts = known.select("h1", "words")
    others = texts.withColumnsRenamed({"h1": "other", "words": "other_words"})
    pairs = pairs.join(texts, "h1").join(others, "other").select("h1", "words", "other_words")
    near = materialise(pairs.mapInArrow(_within_one, "h1 long"), "near-lines")
    release(active, known)
    return near


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("content"),
        F.col(f"`{text}`").alias("text"),
    )


def duplicate_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Numbers of the lines to remove, for each document that has any: ``doc_id``, ``content``
    (hash of the text) and ``lines`` (from 0, split at ``\\n``).

    Lines are compared as sequences of words, A-Z as a-z.  A line goes if an equal one stands
    earlier, or, with ``MIN_WORDS`` words or more in both, one that is a single inserted,
    deleted or replaced word away.  Earlier means a smaller ``doc_id`` (null is last), then
    the hash of the text, then the line number.

    All variants with one word deleted would be a row per word of the corpus.  So equal halves
    are joined first, then equal surroundings of an eighth, and only inside the eighths that a
    line shares are its variants emitted; every pair within the bound passes all three.  Lines
    with equal variants are within the bound of their earliest, so groups need a minimum and
    no pairs.  Lines without words stay.  Rows equal in id and text are one document.
    """
    spark = docs.sparkSession
    source = _keyed(docs, doc_id, text)
    lines = materialise(source.mapInArrow(_read_lines, _LINES), "lines")
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "content", "line").alias("at")
    lines = lines.withColumn("at", at)
    firsts = lines.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.max("at").alias("latest"))
    firsts = materialise(firsts, "first-lines")
    near = _near_lines(spark, source, lines, firsts)
    known = firsts.join(near.withColumn("near", F.lit(True)), "h1", "left")
    known = known.where("near OR at < latest").select("h1", "h2", F.col("at").alias("first"), "near")
    gone = lines.join(known, ["h1", "h2"]).where(F.coalesce("near", F.lit(False)) | (F.col("first") < F.col("at")))
    return gone.groupBy("doc_id", "content").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches):
        texts = []
        for body, gone in zip(batch.column("text"), batch.column("removed_lines")):
            value, drop = body.as_py(), set(gone.as_py())
            if drop and value is not None:
                value = "\n".join(x for i, x in enumerate(value.split("\n")) if i not in drop)
            texts.append(value)
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All documents without their duplicate lines, and ``removed_lines``, their numbers.

    ``n_chars`` follows the new text where ``docs`` has it.  No document goes: one that only
    repeats others is left without words.  A null text stays null, an empty table gives an
    empty result, other columns are kept.
    """
    names = docs.columns
    gone = duplicate_lines(docs).select(
        F.col("doc_id").alias("id of lines"),
        F.col("content").alias("content of lines"),
        F.col("lines").alias("lines of text"),
    )
    gone = materialise(gone, "removed-lines")
    rows = docs.withColumn("content of row", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("id of lines")) & (F.col("content of row") == F.col("content of lines"))
    rows = rows.join(gone, same, "left").select(
        *(F.col(f"`{c}`") for c in names),
        F.coalesce("lines of text", F.array().cast("array<int>")).alias("removed_lines"),
    )
    rows = rows.mapInArrow(_cut, rows.schema)
    if "n_chars" in names:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(F.size("removed_lines") > 0, length).otherwise(F.col("n_chars")))
    return rows
