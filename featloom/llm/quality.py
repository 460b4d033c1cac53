"""Quality rules: frequency of lines across the documents of a host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.llm import words as W
from featloom.plans.storage import materialise, release

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Width of the windows whose repetition is measured.
WINDOW = 5

_SCHEMA = (
    "row long, doc_id long, host string, content string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, line array<long>, words array<int>"
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules.

    A line is boilerplate in a host if more than ``max_docs`` different documents of the host and
    more than ``max_share`` of them hold it.  Copies of a text are one document, and a document
    counts only if at least ``min_own`` of its words are outside lines that are so frequent:
    near copies of one document, which repeat its lines, are the work of deduplication.  A
    document is depleted if less than ``min_left`` of its words are outside boilerplate lines.
    """

    max_docs: int = 20
    max_share: float = 0.01
    min_words: int = 10
    min_left: float = 0.2
    min_own: float = 0.25
    max_repeat: float = 0.2


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    for batch in batches:
        for chunk in W.chunks(batch.column("text")):
            n = len(chunk)
            found = W.words(chunk)
            lowered = W.words(chunk, lower=True)
            letters = W.code_points(chunk.data)
            before = np.concatenate([[0], np.cumsum(letters)])
            word_chars = W.per_text(before[found.end] - before[found.start], found.text, n)
            marks = np.concatenate([[0], np.cumsum(symbol[chunk.data])])
            n_symbols = np.diff(marks[chunk.offsets])

            text, _, first = W.lines(chunk, found)
            raw = W.raw_line_hash(chunk, found, first)
            distinct = np.unique(W.mix(raw + W.mix(text.astype(np.uint64))), return_index=True)[1]
            per_text = np.bincount(text, minlength=n)
            n_dup = per_text - np.bincount(text[distinct], minlength=n)

            at, hashed = W.windows(found, WINDOW)
            keyed = W.mix(hashed + W.mix(found.text[at].astype(np.uint64)))
            _, inverse, counts = np.unique(keyed, return_inverse=True, return_counts=True)
            again = at[counts[inverse] > 1]
            cover = np.zeros(len(found.hash) + 1, np.int64)
            np.add.at(cover, again, 1)
            np.add.at(cover, again + WINDOW, -1)
            covered = np.cumsum(cover)[:-1] > 0
            n_repeat = W.per_text(covered, found.text, n)

            # each different line once per document
            hashes = W.line_hash(lowered, first)
            sizes = np.diff(np.append(first, len(found.hash)))
            keyed = W.mix(hashes + W.mix(text.astype(np.uint64)))
            _, keep, inverse = np.unique(keyed, return_index=True, return_inverse=True)
            total = np.bincount(inverse, weights=sizes, minlength=len(keep)).astype(np.int32)
            order = np.argsort(keep)
            keep, total = keep[order], total[order]
            bounds = pa.array(np.searchsorted(text[keep], np.arange(n + 1)).astype(np.int32))

            own = slice(chunk.first, chunk.first + n)
            columns = [
                batch.column("row").slice(own.start, n),
                batch.column("doc_id").slice(own.start, n),
                batch.column("host").slice(own.start, n),
                batch.column("content").slice(own.start, n),
                *(pa.array(x.astype(np.int64)) for x in (found.count, word_chars, n_symbols, n_dup, n_repeat)),
                pa.ListArray.from_arrays(bounds, pa.array(W.signed(hashes[keep]))),
                pa.ListArray.from_arrays(bounds, pa.array(total)),
            ]
            names = [part.split()[0] for part in _SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names)


def _lines(measured: DataFrame) -> DataFrame:
    lines = measured.select("row", "host", "n_words", F.explode(F.arrays_zip("line", "words")).alias("l"))
    return lines.select("row", "host", "n_words", "l.line", "l.words")


def _boilerplate(measured: DataFrame, rules: LineRules) -> DataFrame:
    """Host and line of all lines above the limits."""
    first = measured.groupBy("host", "content").agg(F.min("row").alias("row"))
    different = measured.join(first.select("row"), "row", "left_semi").select("row", "host", "n_words", "line", "words")
    different = materialise(different, "different-documents")
    sizes = different.groupBy("host").agg(F.count("*").alias("of_host"))

    def above(lines: DataFrame) -> DataFrame:
        counts = lines.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > rules.max_docs)
        return counts.join(sizes, "host").where(F.col("docs") > rules.max_share * F.col("of_host")).select("host", "line")

    frequent = materialise(above(_lines(different)), "frequent-lines")
    held = _lines(different).join(frequent, ["host", "line"])
    held = held.groupBy("row").agg(
        F.first("host").alias("host"),
        F.first("n_words").alias("n_words"),
        F.sum("words").alias("shared"),
        F.collect_list("line").alias("line"),
    )
    own = held.where(F.col("n_words") - F.col("shared") >= rules.min_own * F.col("n_words"))
    bad = materialise(above(own.select("host", F.explode("line").alias("line"))), "boilerplate")
    release(different, frequent)
    return bad


def line_frequency_rules(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    rules: LineRules = LineRules(),
) -> DataFrame:
    """Measure documents and reject those that hold little beside boilerplate lines.

    Lines are compared without case of A-Z and white space.  Returns one row per document:
    ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed`` (under ``min_words`` words, or more than
    ``max_repeat`` of the words in windows that repeat), ``boilerplate_words``,
    ``boilerplate`` (hashes of the lines to remove) and ``kept``.

    Lines are counted by partial sums, so a line that every document holds costs one row per
    task; counts cover all documents.  A null or empty text has no words and fails; a null
    host is one host; equal texts of a host count as one document, so they never make
    boilerplate; an empty table gives an empty result; other columns are not read.
    """
    return _judge(_measured(docs, doc_id, text, host), rules).drop("host", "content")


def _measured(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"),
        F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("content"),
        F.col(f"`{text}`").alias("text"),
    )
    return materialise(rows.mapInArrow(_measure, _SCHEMA), "lines")


def _judge(measured: DataFrame, rules: LineRules) -> DataFrame:
    """Verdicts of measured documents."""
    bad = _boilerplate(measured, rules)
    lost = (
        _lines(measured)
        .join(bad, ["host", "line"])
        .groupBy("row")
        .agg(F.sum("words").alias("boilerplate_words"), F.collect_set("line").alias("boilerplate"))
    )
    n, lost_words = F.col("n_words"), F.coalesce("boilerplate_words", F.lit(0))
    failed = (n < rules.min_words) | (100 * F.col("n_repeat_words") > F.lit(100 * rules.max_repeat) * n)
    depleted = n - lost_words < rules.min_left * n
    return measured.drop("line", "words").join(lost, "row", "left").select(
        "doc_id",
        "host",
        "content",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        lost_words.cast("long").alias("boilerplate_words"),
        F.coalesce("boilerplate", F.array().cast("array<long>")).alias("boilerplate"),
        (~failed & ~depleted).alias("kept"),
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches):
        texts, remove = batch.column("text"), batch.column("lines to remove")
        out: list[str | None] = texts.to_pylist()
        touched = set(np.flatnonzero(pa.compute.list_value_length(remove).to_numpy(zero_copy_only=False) > 0).tolist())
        if touched:
            for chunk in W.chunks(texts):
                found = W.words(chunk, lower=True)
                text, number, first = W.lines(chunk, found)
                hashes = W.signed(W.line_hash(found, first))
                bounds = np.searchsorted(text, np.arange(len(chunk) + 1))
                for i in range(len(chunk)):
                    row = chunk.first + i
                    if row in touched:
                        span = slice(bounds[i], bounds[i + 1])
                        gone = np.isin(hashes[span], remove[row].values.to_numpy())
                        drop = set(number[span][gone].tolist())
                        kept = [x for k, x in enumerate(out[row].split("\n")) if k not in drop]
                        out[row] = "\n".join(kept)
        index = batch.schema.get_field_index("text")
        yield batch.set_column(index, batch.schema.field(index), pa.array(out, texts.type))


def clean_documents(docs: DataFrame, *, rules: LineRules = LineRules()) -> DataFrame:
    """Documents that pass, without their boilerplate lines, with the columns of ``docs``.

    ``n_chars`` follows the new text where ``docs`` has it.  A verdict depends on host and text
    alone, so verdicts meet their documents by the hash of the text.
    """
    names = docs.columns
    verdicts = _judge(_measured(docs, "doc_id", "text", "source"), rules).where("kept")
    verdicts = verdicts.select(
        F.col("host").alias("host of verdict"),
        F.col("content").alias("content of verdict"),
        F.col("boilerplate").alias("lines to remove"),
    ).dropDuplicates(["host of verdict", "content of verdict"])
    rows = docs.select(
        "*",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host of verdict"),
        F.md5(F.coalesce("text", F.lit(""))).alias("content of verdict"),
    )
    kept = rows.join(verdicts, ["host of verdict", "content of verdict"])
    kept = kept.select(*(F.col(f"`{c}`") for c in names), "lines to remove")
    cut = kept.mapInArrow(_cut, kept.schema)
    if "n_chars" in names:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.size("lines to remove") > 0, length).otherwise(F.col("n_chars")))
    return cut.drop("lines to remove")
