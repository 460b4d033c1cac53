"""Personal data: patterns, and terms that reveal whom they stand beside."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.llm import bitmap
from featloom.llm import words as W
from featloom.plans.storage import materialise

#: Kinds of personal data, in the order of spans; terms come last.
KINDS = ("email", "ip", "card", "phone")
#: Punctuation that ends a term, besides white space.
PUNCTUATION = b"!\"'(),.:;?[]{}<>|"

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match always begins where a run of digits does; saying so keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_FOUND = (
    "doc_id long, content long, n_email long, n_ip long, n_card long, n_phone long, base string, "
    "spans array<struct<kind:int,start:int,end:int>>, beside array<struct<entity:long,context:long>>, terms array<long>"
)


@dataclass(frozen=True)
class Disclosure:
    """When a term gives an entity away.

    Entities are the values of personal data and its kinds; a term is seen with those of all
    documents that hold it.  It discloses an entity if little uncertainty is left where it
    occurs: -log2 P(entity | term) of at most ``remove_bits`` (the term is removed) or
    ``generalise_bits`` (it is replaced by a placeholder), and at least ``gain_bits`` less than
    -log2 P(entity).  P(entity | term) is the share of the documents with the term, smoothed by
    P(entity) with the weight ``prior`` against the number of different contexts (``reach``
    words on both sides of the entity): copies of one text are one context.  Pairs of fewer than ``support`` contexts are left out:
    two are the least, since every rare word of a single context would disclose.
    """

    reach: int = 6
    support: int = 2
    remove_bits: float = 0.25
    generalise_bits: float = 0.5
    prior: float = 0.5
    gain_bits: float = 1.0


def _emails(text: str) -> list[tuple[int, int]]:
    spans, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            spans.append((start, last))
        at = text.find("@", max(last, at + 1))
    return spans


def _luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind, start and end (code points) of the personal data of a text, by kind and start."""
    spans = [(0, *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            spans.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                spans.append((3, *m.span()))
    return spans


def _entity(kind: int, value: str) -> int:
    plain = value.lower() if kind == 0 else value if kind == 1 else re.sub(r"[^0-9]", "", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def _contexts(texts: list[str], spans: list[list], reach: int) -> list[tuple[list[dict], np.ndarray]]:
    """Entities of each text with a hash of the context of one place, and its different terms."""
    out: list[tuple[list[dict], np.ndarray]] = []
    for chunk in W.chunks(pa.array(texts, pa.string())):
        found = W.words(chunk, lower=True, apart=PUNCTUATION)
        for i in range(len(chunk)):
            row = chunk.first + i
            own = slice(found.first[i], found.first[i] + found.count[i])
            starts, ends, hashes = found.start[own] - chunk.offsets[i], found.end[own] - chunk.offsets[i], found.hash[own]
            own_bytes = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]]
            byte_of = np.append(np.flatnonzero(W.code_points(own_bytes)), len(own_bytes))
            places = [(byte_of[s[1]], byte_of[s[2]]) for s in spans[row]]
            free = np.ones(len(starts), bool)
            for low, high in places:
                free[np.searchsorted(ends, low, "right") : np.searchsorted(starts, high)] = False
            left = np.flatnonzero(free)
            places_of: dict[int, int] = {}
            for (kind, a, b), (low, high) in zip(spans[row], places):
                upto = np.searchsorted(left, np.searchsorted(ends, low, "right"))
                before = left[max(0, upto - reach) : upto]
                behind = np.searchsorted(starts, high)
                after = behind + np.flatnonzero(free[behind : behind + 4 * reach])[:reach]
                terms = hashes[np.concatenate([before, after])]
                context = W.signed(W.mix(np.array([(terms * W._SLOT[: len(terms)]).sum()], np.uint64)))[0] if len(terms) else 0
                for entity in (_entity(kind, texts[row][a:b]), _entity(kind, "")):
                    places_of[entity] = min(places_of.get(entity, int(context)), int(context))
            own = [{"entity": e, "context": c} for e, c in places_of.items()]
            out.append((own, W.signed(np.unique(hashes[free]))))
    return out


def _detect(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    wanted = np.zeros(256, bool)
    wanted[[*range(48, 58), ord("@")]] = True
    fields = [part.split(" ", 1)[0] for part in re.split(r", (?![^<]*>)", _FOUND)]
    kinds = [pa.int64()] * 6 + [
        pa.string(),
        pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])),
        pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64())])),
        pa.list_(pa.int64()),
    ]
    for batch in W.slices(batches):
        n = batch.num_rows
        spans: list[list] = [[] for _ in range(n)]
        beside: list[list] = [[] for _ in range(n)]
        terms: list = [[] for _ in range(n)]
        column = batch.column("text")
        for chunk in W.chunks(column):
            marks = np.concatenate([[0], np.cumsum(wanted[chunk.data])])
            rows = np.flatnonzero(np.diff(marks[chunk.offsets]) > 0) + chunk.first
            texts = column.take(pa.array(rows)).to_pylist()
            found = [find_spans(t) for t in texts]
            for row, own in zip(rows, found):
                spans[row] = own
            some = [k for k, own in enumerate(found) if own]
            for k, own in zip(some, _contexts([texts[k] for k in some], [found[k] for k in some], reach)):
                beside[rows[k]], terms[rows[k]] = own
        counts = np.zeros((n, 4), np.int64)
        for row, own in enumerate(spans):
            for kind, _, _ in own:
                counts[row, kind] += 1
        base = [",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in own) for own in spans]
        structs = [[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in spans]
        columns = [batch.column("doc_id"), batch.column("content"), *counts.T, base, structs, beside, terms]
        yield pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)],
            fields,
        )


def _count_terms(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents of each term that passes the filter, summed per chunk."""
    for batch in batches:
        for chunk in W.chunks(batch.column("text")):
            found = W.words(chunk, lower=True, apart=PUNCTUATION)
            at = bitmap.hits(bits, found.hash)
            once = np.unique(W.mix(found.hash[at] + W.mix(found.text[at].astype(np.uint64))), return_index=True)[1]
            terms, docs = np.unique(found.hash[at][once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(terms)), pa.array(docs.astype(np.int64))], ["term", "docs"])


def _place_terms(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Document, term and span (code points) of the terms that pass the filter."""
    for batch in batches:
        for chunk in W.chunks(batch.column("text")):
            found = W.words(chunk, lower=True, apart=PUNCTUATION)
            at = bitmap.hits(bits, found.hash)
            before = np.concatenate([[0], np.cumsum(W.code_points(chunk.data))])
            rows = pa.array(chunk.first + found.text[at])
            base = before[chunk.offsets[:-1]][found.text[at]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows),
                    batch.column("content").take(rows),
                    pa.array(W.signed(found.hash[at])),
                    pa.array((before[found.start[at]] - base).astype(np.int32)),
                    pa.array((before[found.end[at]] - base).astype(np.int32)),
                ],
                ["doc_id", "content", "term", "start", "end"],
            )


def _disclosing(docs: DataFrame, found: DataFrame, rules: Disclosure) -> DataFrame:
    """``term`` and ``removed`` (else generalised) of all terms above a threshold."""
    spark = docs.sparkSession
    beside = found.where(F.size("beside") > 0).select("terms", F.explode("beside").alias("b")).select("b.*", "terms")
    entities = beside.groupBy("entity").agg((F.count("*") / F.lit(max(found.count(), 1))).alias("before"))
    contexts = beside.select("entity", "context", F.explode("terms").alias("term"))
    contexts = contexts.groupBy("entity", "term", "context").agg(F.count("*").alias("docs"))
    pairs = contexts.groupBy("entity", "term").agg(F.sum("docs").alias("together"), F.count("*").alias("contexts"))
    pairs = pairs.where(F.col("contexts") >= rules.support).join(entities, "entity")

    def smoothed(share: Column) -> Column:
        return (share * F.col("contexts") + rules.prior * F.col("before")) / (F.col("contexts") + rules.prior)

    # no other pair can pass, in however few documents the term is
    gained = -F.log2("before") - rules.gain_bits
    possible = -F.log2(smoothed(F.lit(1.0))) <= F.least(F.lit(rules.generalise_bits), gained)
    pairs = materialise(pairs.where(possible), "term-pairs")
    bits = spark.sparkContext.broadcast(bitmap.build(pairs, "term"))
    counts = docs.mapInArrow(lambda batches: _count_terms(batches, bits.value), "term long, docs long")
    counts = counts.groupBy("term").agg(F.sum("docs").alias("docs"))
    left = -F.log2(smoothed(F.least(F.col("together") / F.col("docs"), F.lit(1.0))))
    flagged = pairs.join(counts, "term").where(left <= F.least(F.lit(rules.generalise_bits), gained))
    flagged = flagged.groupBy("term").agg(F.max(left <= rules.remove_bits).alias("removed"))
    return materialise(flagged, "disclosing-terms")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("content"),
        F.col(f"`{text}`").alias("text"),
    )


def personal_data(
    docs: DataFrame,
    *,
    rules: Disclosure = Disclosure(),
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Spans of personal data and of disclosing terms in every whole text.

    Returns one row per document: ``doc_id``, ``content`` (hash of the text), ``n_email``,
    ``n_ip``, ``n_card``, ``n_phone``, ``base`` (the spans of these kinds as
    ``kind:start:end``, in code points), ``spans`` (struct of kind, start, end; kind 4 and 5
    are terms to generalise and to remove).

    The terms of documents with personal data are counted with it, per context; the pairs that
    can reach a threshold are counted in all texts through a filter of fixed size, and only
    terms above the threshold are looked up again.  Texts are never shuffled.  Terms
    inside personal data add no span.  A null or empty text has no spans; rows equal in id and
    text have equal spans; an empty table gives an empty result; other columns are not read.
    """
    source = _keyed(docs, doc_id, text)
    found = materialise(source.mapInArrow(lambda batches: _detect(batches, rules.reach), _FOUND), "personal-data")
    flagged = _disclosing(source, found, rules)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap.build(flagged, "term"))
    places = source.mapInArrow(
        lambda batches: _place_terms(batches, bits.value),
        "doc_id long, content long, term long, start int, end int",
    )
    kind = F.when(F.col("removed"), 5).otherwise(4).alias("kind")
    terms = places.join(flagged, "term").select("doc_id", "content", F.struct(kind, "start", "end").alias("span"))
    terms = terms.groupBy(F.col("doc_id").alias("id of terms"), F.col("content").alias("content of terms")).agg(
        F.collect_set("span").alias("terms"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("id of terms")) & (F.col("content") == F.col("content of terms"))
    free = "filter(terms, t -> NOT exists(spans, s -> s.start < t.end AND t.start < s.end))"
    spans = F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.concat("spans", F.array_sort(F.expr(free))))
    return found.drop("beside", "terms").join(terms, same, "left").select(
        "doc_id",
        "content",
        *(f"n_{k}" for k in KINDS),
        "base",
        spans.alias("spans"),
    )


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = [*(f"<{k.upper()}>" for k in KINDS), "<TERM>", ""]
    for batch in W.slices(batches):
        texts = []
        for body, spans in zip(batch.column("text"), batch.column("spans")):
            value, own = body.as_py(), spans.as_py()
            if value is not None and own:
                parts, last = [], 0
                for span in sorted(own, key=lambda s: (s["start"], s["kind"])):
                    if span["start"] >= last:
                        parts += [value[last : span["start"]], marks[span["kind"]]]
                    last = max(last, span["end"])
                value = "".join([*parts, value[last:]])
            texts.append(value)
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def sanitise(docs: DataFrame, *, rules: Disclosure = Disclosure()) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced or removed in ``text``."""
    found = personal_data(docs, rules=rules).where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("id of spans"), F.col("content").alias("content of spans"), "spans")
    found = found.withColumnRenamed("spans", "spans of row").dropDuplicates(["id of spans", "content of spans"])
    rows = docs.withColumn("content of row", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("id of spans")) & (F.col("content of row") == F.col("content of spans"))
    joined = rows.join(found, same, "left")
    carried = [c for c in docs.columns if c != "text"]
    work = joined.select("text", F.col("spans of row").alias("spans"), F.struct(*(f"`{c}`" for c in carried)).alias("row"))
    work = work.mapInArrow(_replace, work.schema)
    return work.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
