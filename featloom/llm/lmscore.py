"""LM scoring: cross-entropy difference of matched target and background bigram models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.llm import words as W
from featloom.plans.storage import materialise, release

#: Tokens of one bucket of the count tables, on average; the number of buckets follows the corpus.
BUCKET = 1 << 19
#: Words that make up more than one in so many tokens are broadcast.
HOT_WORDS = 1 << 16
#: Bytes of text whose entries travel together, when they are counted and when they are scored.
COUNT_BYTES, SCORE_BYTES = 8 << 20, 4 << 20
#: Words and bigrams that make up more than one in so many tokens have numbers and are broadcast,
#: where a corpus is scored against its own counts.
FREQUENT_WORDS, FREQUENT_PAIRS = 1 << 18, 1 << 16
#: Losses are added as whole numbers of this fraction of a bit, so sums do not depend on the layout.
STEP = 2.0**-20
#: Stands for every word outside a limited vocabulary.
UNKNOWN = np.uint64(0x5851F42D4C957F2D)
#: Counts of all tokens travel under this name beside those of frequent words.
ALL = np.uint64(0x14057B7EF767814F)

_ENTRIES = "bucket int, entries binary"
_TABLE = "bucket int, counts binary, hot binary"
_SCORED = "bucket int, block long, entries binary, doc_id array<long>, base binary"
_SUMS = "bucket int, block long, sums binary, doc_id array<long>, base binary"
_FREQUENT = "word int, pair long, start boolean, background long, target long"
_ANSWERS = "bucket int, block long, sums binary, doc_id array<long>, base binary"
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


@dataclass(frozen=True)
class Models:
    """Vocabulary and smoothing, the same for both models.

    All words and bigrams are counted exactly, in tables that grow with the corpus.  With a
    ``vocabulary``, only so many most frequent words are told apart and every other word is
    one unknown word.  Bigrams that make up more than one in ``cells`` tokens are broadcast,
    so at most ``cells`` of them; all others are looked up in the tables.  Bigrams fall back
    on words with the weight ``prior``, words on the uniform distribution with ``alpha``.
    """

    vocabulary: int | None = None
    cells: int = 1 << 18
    prior: float = 8.0
    alpha: float = 0.1


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, column by column."""
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    head = np.array([len(arrays[0]), len(body)], np.int64).tobytes()
    return head + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(payload: bytes, *kinds: type) -> list[np.ndarray]:
    n, size = np.frombuffer(payload, np.int64, 2)
    body = pa.decompress(payload[16:], int(size), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(body, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _join(payloads: pa.ChunkedArray, *kinds: type) -> list[np.ndarray]:
    parts = [_unpack(p.as_py(), *kinds) for p in payloads if p.is_valid]
    return [np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds)]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for chunk in W.chunks(batch.column("text")):
            found, counts = np.unique(W.words(chunk, lower=True).hash, return_counts=True)
            known, place = np.unique(np.concatenate([known, found]), return_inverse=True)
            sums = np.bincount(place, np.concatenate([sums, counts]), len(known)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(W.signed(known)), pa.array(sums)], ["word", "count"])


@dataclass
class Cache:
    """What all tasks know: frequent words and bigrams with their counts, and the sizes."""

    models: Models
    buckets: int
    size: int  # words that are told apart
    totals: np.ndarray
    vocabulary: np.ndarray | None
    words: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pair_counts: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))

    def tokens(self, chunk: W.Chunk) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
        """Words, each as it is told apart, the bigram it ends, and whether it begins a text."""
        found = W.words(chunk, lower=True)
        word = found.hash
        if self.vocabulary is not None:
            word = np.where(_find(self.vocabulary, word)[1], word, UNKNOWN)
        start = np.ones(len(word), bool)
        start[1:] = found.text[1:] != found.text[:-1]
        pair = np.roll(word, 1) * W._SLOT[0] + word * W._SLOT[1]
        pair = W.mix(np.where(start, word * W._SLOT[2], pair))
        return found, word, pair, start

    def bucket(self, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Bigrams are kept with the word they end, those of frequent words by themselves."""
        key = np.where(_find(self.words, word)[1], pair, W.mix(word))
        return (key % np.uint64(self.buckets)).astype(np.int32)

    def bits(self, pair: np.ndarray, word: np.ndarray, start: np.ndarray, n: np.ndarray, follow: np.ndarray) -> np.ndarray:
        """Losses of entries under both models, from the counts of bigram and word.

        The share of a word as the context of the next one is told by its own entry.
        """
        single = (word + self.models.alpha) / (self.totals + self.models.alpha * (self.size + 1))
        chance = np.where(start[:, None], single, pair + self.models.prior * single)
        return follow[:, None] * np.log2(word + self.models.prior) - n[:, None] * np.log2(chance)


def _split(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0)) if len(order) else []
    for low, high in zip(bounds, [*bounds[1:], len(order)]):
        yield int(bucket[order[low]]), _pack(*(c[order[low:high]] for c in columns))


def _count_pairs(batches: Iterator[pa.RecordBatch], cache: Cache) -> Iterator[pa.RecordBatch]:
    """Bigrams of stretches of text with the word they end and counts, background and target."""

    def entries(parts: list[tuple]) -> pa.RecordBatch:
        pair, word, own = (np.concatenate(p) for p in zip(*parts))
        pair, first, place = np.unique(pair, return_index=True, return_inverse=True)
        counts = [np.bincount(place, w, len(pair)).astype(np.int64) for w in (None, own)]
        rows = list(_split(cache.bucket(word[first], pair), pair, word[first], *counts))
        at, hot = _find(cache.words, word[first])
        sums = [np.bincount(at[hot], c[hot], len(cache.words)).astype(np.int64) for c in counts]
        names, sums = np.append(cache.words, ALL), [np.append(t, c.sum()) for t, c in zip(sums, counts)]
        rows += _split(-1 - (names % np.uint64(cache.buckets)).astype(np.int32), names, names, *sums)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
            _names(_ENTRIES),
        )

    parts, size = [], 0
    for batch in batches:
        target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
        for chunk in W.chunks(batch.column("text")):
            found, word, pair, _ = cache.tokens(chunk)
            parts.append((pair, word, target[chunk.first + found.text]))
            size += len(chunk.data)
            if size >= COUNT_BYTES:
                yield entries(parts)
                parts, size = [], 0
    if parts:
        yield entries(parts)


def _sum_pairs(table: pa.Table, cache: Cache) -> pa.Table:
    """Exact counts of the bigrams of a bucket; the frequent ones once more, with the counts of
    their words as far as those are in the bucket."""
    pair, word, background, target = _join(table.column("entries"), np.uint64, np.uint64, np.int64, np.int64)
    pair, first, place = np.unique(pair, return_index=True, return_inverse=True)
    counts = np.stack([np.bincount(place, w, len(pair)) for w in (background, target)], axis=1).astype(np.int64)
    word = word[first]
    if table.column("bucket")[0].as_py() < 0:  # words, not bigrams
        hot, beside = np.arange(len(word)), counts
    else:
        hot = np.flatnonzero(counts[:, 0] * cache.models.cells > cache.totals[0])
        known, place = np.unique(word, return_inverse=True)
        beside = np.stack([np.bincount(place, counts[:, i], len(known)) for i in (0, 1)], axis=1)[place[hot]]
    return pa.table(
        {
            "bucket": table.column("bucket").slice(0, 1),
            "counts": pa.array([_pack(pair, word, *counts.T)], pa.binary()),
            "hot": pa.array([_pack(pair[hot], word[hot], *counts[hot].T, *beside.T.astype(np.int64))], pa.binary()),
        },
    )


class Losses:
    """Both models: exact counts of all bigrams, as a table of buckets, and what is broadcast.

    ``vocabulary`` and ``words`` (counts, the unknown word last) are kept for a limited
    vocabulary only.
    """

    def __init__(self, table: DataFrame, cache: Cache, words: np.ndarray | None):
        self.table, self.cache, self.vocabulary, self.words = table, cache, cache.vocabulary, words


def _entries(batches: Iterator[pa.RecordBatch], cache: Cache) -> Iterator[pa.RecordBatch]:
    """Losses of frequent bigrams, and the other bigrams of each text on their way to the counts."""
    block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

    def rows(ids: list[pa.Array], counts: list[np.ndarray], base: list[np.ndarray], parts: list[tuple]) -> pa.RecordBatch:
        text, pair, word, start, n, follow = (np.concatenate(p) for p in zip(*parts))
        bucket = cache.bucket(word, pair)
        at, known = _find(cache.words, word)
        # frequent words by number, which takes less room
        word, kind = np.where(known, at.astype(np.uint64), word), start + 2 * known.astype(np.uint8)
        out = list(_split(bucket, text, pair, word, kind, n, follow))
        own = _pack(np.concatenate(counts), *np.concatenate(base).T)
        columns = [
            pa.array([*(r[0] for r in out), block % cache.buckets], pa.int32()),
            pa.array([block] * (len(out) + 1), pa.int64()),
            pa.array([*(r[1] for r in out), None], pa.binary()),
            pa.array([*([None] * len(out)), pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())),
            pa.array([*([None] * len(out)), own], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, _names(_SCORED))

    ids, counts, base, parts, size, texts = [], [], [], [], 0, 0
    for batch in batches:
        for chunk in W.chunks(batch.column("text")):
            found, word, pair, start = cache.tokens(chunk)
            follow = np.append(~start[1:], False)[: len(start)]
            keyed = W.mix(pair + W.mix(found.text.astype(np.uint64)))
            _, first, place = np.unique(keyed, return_index=True, return_inverse=True)
            n, follow = np.bincount(place, None, len(first)), np.bincount(place, follow, len(first))
            text, word, pair, start = found.text[first], word[first], pair[first], start[first]
            sums = np.zeros((len(chunk), 2))
            rest = np.ones(len(first), bool)
            at, hot = _find(cache.pairs, pair)
            if hot.any():
                seen = cache.pair_counts[at[hot]]
                bits = cache.bits(seen[:, :2], seen[:, 2:], start[hot], n[hot], follow[hot])
                sums = np.stack([np.bincount(text[hot], bits[:, i], len(chunk)) for i in (0, 1)], axis=1)
                rest = ~hot
            ids.append(batch.column("doc_id").slice(chunk.first, len(chunk)))
            counts.append(found.count.astype(np.int64))
            base.append(sums)
            kinds = (np.uint32, np.uint64, np.uint64, np.uint8, np.uint32, np.uint32)
            columns = (text + texts, pair, word, start, n, follow)
            parts.append(tuple(c[rest].astype(k) for c, k in zip(columns, kinds)))
            size, texts = size + len(chunk.data), texts + len(chunk)
            if size >= SCORE_BYTES:
                yield rows(ids, counts, base, parts)
                ids, counts, base, parts, size, texts, block = [], [], [], [], 0, 0, block + 1
    if parts:
        yield rows(ids, counts, base, parts)


def _lookup(entries: pa.Table, table: pa.Table, cache: Cache) -> pa.Table:
    """Losses of the entries of a bucket, summed by text, block by block."""
    pair, word, *counts = _join(table.column("counts"), np.uint64, np.uint64, np.int64, np.int64)
    counts = np.stack(counts, axis=1)
    known, place = np.unique(word, return_inverse=True)
    sums = np.stack([np.bincount(place, counts[:, i], len(known)) for i in (0, 1)], axis=1)
    out = []
    for payload in entries.column("entries"):
        if not payload.is_valid:
            out.append(None)
            continue
        kinds = (np.uint32, np.uint64, np.uint64, np.uint8, np.uint32, np.uint32)
        text, wanted, words, kind, n, follow = _unpack(payload.as_py(), *kinds)
        seen, beside = np.zeros((len(text), 2)), np.zeros((len(text), 2))
        for keys, values, key, into in ((pair, counts, wanted, seen), (known, sums, words, beside)):
            at, there = _find(keys, key)
            into[there] = values[at[there]]
        numbered = kind >= 2
        beside[numbered] = cache.word_counts[words[numbered].astype(np.int64)]
        bits = cache.bits(seen, beside, kind % 2 > 0, n.astype(np.float64), follow.astype(np.float64))
        texts, place = np.unique(text, return_inverse=True)
        out.append(_pack(texts, *(np.bincount(place, bits[:, i], len(texts)).astype(np.float32) for i in (0, 1))))
    names = _names(_SUMS)
    return pa.table([*(entries.column(c) for c in names[:2]), pa.array(out, pa.binary()), *(entries.column(c) for c in names[3:])], names)


def _finish(table: pa.Table) -> pa.Table:
    """Scores of the texts of a block."""
    table = table.sort_by("bucket")
    (row,) = [r for r in zip(table.column("doc_id"), table.column("base")) if r[1].is_valid]
    tokens, background, target = _unpack(row[1].as_py(), np.int64, np.float64, np.float64)
    sums = [background.copy(), target.copy()]
    text, *more = _join(table.column("sums"), np.uint32, np.float32, np.float32)
    for model in (0, 1):
        sums[model] += np.bincount(text, more[model], len(tokens))
    none = tokens == 0
    means = [s / np.maximum(tokens, 1) for s in sums]
    columns = [row[0].values, pa.array(tokens), *(pa.array(m, mask=none) for m in (means[1], means[0], means[1] - means[0]))]
    return pa.table(columns, _names(_SCORES))


def _sizes(texts: DataFrame, models: Models, share: int) -> Cache:
    """Count all words: the total, and which words make up more than one in ``share`` tokens."""
    counted = texts.mapInArrow(_count_words, "word long, count long")
    counted = materialise(counted.groupBy("word").agg(F.sum("count").alias("count")), "word-counts")
    size, total = counted.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    vocabulary = None
    if models.vocabulary is None:
        hot = counted.where(F.col("count") * share > total).select("word").toArrow()
        hot = np.sort(hot.column("word").to_numpy().view(np.uint64))
    else:
        top = counted.orderBy(F.desc("count"), "word").limit(models.vocabulary).select("word").toArrow()
        vocabulary = np.sort(top.column("word").to_numpy().view(np.uint64))
        size, hot = len(vocabulary), np.sort(np.append(vocabulary, UNKNOWN))
    release(counted)
    totals = np.array([total, 0], np.float64)
    return Cache(models, max(1, -(-total // BUCKET)), size, totals, vocabulary, hot, np.zeros((len(hot), 2)))


def train(
    docs: DataFrame,
    *,
    target: str,
    text: str = "text",
    models: Models = Models(),
    unflagged: DataFrame | None = None,
) -> Losses:
    """Count both models: the background over all documents, the target over those whose
    boolean column ``target`` is true.  ``unflagged`` are the same documents, if they are
    cheaper to read without ``target``.

    The counts of all bigrams are a table in the shared folder, in buckets whose number follows
    the corpus; those of a word are the sum of the bigrams it ends.
    """
    body = F.col(f"`{text}`").alias("text")
    own = F.coalesce(F.col(f"`{target}`").cast("boolean"), F.lit(False)).alias("target")
    cache = _sizes((docs if unflagged is None else unflagged).select(body), models, HOT_WORDS)
    hot, vocabulary = cache.words, cache.vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(cache)
    entries = docs.select(body, own).mapInArrow(lambda batches: _count_pairs(batches, shared.value), _ENTRIES)
    table = entries.groupBy("bucket").applyInArrow(lambda own: _sum_pairs(own, shared.value), _TABLE)
    table = materialise(table, "bigram-counts")

    kinds = (np.uint64, np.uint64, *[np.int64] * 4)
    keys, _, *counts = _join(table.where("bucket < 0").select("hot").toArrow().column("hot"), *kinds)
    counts = np.stack(counts[:2], axis=1).astype(np.float64)
    at, there = _find(hot, keys)
    cache.word_counts[at[there]] = counts[there]
    cache.totals = counts[keys == ALL].sum(axis=0)
    pairs, words, *counts = _join(table.where("bucket >= 0").select("hot").toArrow().column("hot"), *kinds)
    counts = np.stack(counts, axis=1).astype(np.float64)
    at, there = _find(hot, words)
    counts[there, 2:] = cache.word_counts[at[there]]
    order = np.argsort(pairs)
    cache.pairs, cache.pair_counts = pairs[order], counts[order]
    words = None
    if vocabulary is not None:
        words = cache.word_counts[[*np.searchsorted(hot, vocabulary), np.searchsorted(hot, UNKNOWN)]]
    return Losses(table.where("bucket >= 0").select("bucket", "counts"), cache, words)


def score_documents(
    docs: DataFrame,
    losses: Losses,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Cross-entropy difference of every document: ``doc_id``, ``n_tokens``, ``target_loss`` and
    ``background_loss`` in bits per token, and ``score``, target minus background (low is like
    the target).

    Tokens are words, A-Z as a-z.  Bigrams that are not broadcast go, once per text, to the
    bucket that holds their counts and those of their last word; sums come back.  A null, empty
    or blank text has no tokens and null losses; repeated rows get equal scores; an empty table
    gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(losses.cache)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    entries = rows.mapInArrow(lambda batches: _entries(batches, shared.value), _SCORED)
    sums = entries.groupBy("bucket").cogroup(losses.table.groupBy("bucket"))
    sums = sums.applyInArrow(lambda own, table: _lookup(own, table, shared.value), _SUMS)
    return sums.groupBy("block").applyInArrow(_finish, _SCORES)


def _store(*arrays: np.ndarray) -> bytes:
    """Whole numbers, none below zero, in as many bytes as the largest needs, byte plane by byte plane."""
    sizes, body = [], []
    for a in arrays:
        raw = np.ascontiguousarray(a).astype("<u8")
        width = (int(raw.max()).bit_length() + 7) // 8 if len(raw) else 0
        sizes += [len(raw), width]
        body.append(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    data = b"".join(body)
    return np.array([len(arrays), len(data), *sizes], np.int64).tobytes() + pa.compress(data, codec="zstd", asbytes=True)


def _load(payload: bytes) -> list[np.ndarray]:
    count, size = (int(x) for x in np.frombuffer(payload, np.int64, 2))
    sizes = np.frombuffer(payload, np.int64, 2 * count, 16).reshape(-1, 2)
    data = np.frombuffer(pa.decompress(payload[16 + 16 * count :], size, codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for n, width in sizes.tolist():
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :width] = data[at : at + n * width].reshape(width, n).T
        out.append(raw.reshape(-1).view("<u8"))
        at += n * width
    return out


def _zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _unzigzag(x: np.ndarray) -> np.ndarray:
    x = x.view(np.int64)
    return (x >> 1) ^ -(x & 1)


def _bigram(previous: np.ndarray, word: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The same hashes of bigrams as those of ``Cache.tokens``."""
    return W.mix(np.where(start, word * W._SLOT[2], previous * W._SLOT[0] + word * W._SLOT[1]))


def _frequent(batches: Iterator[pa.RecordBatch], cache: Cache) -> Iterator[pa.RecordBatch]:
    """Counts of frequent words and, as word -1, of all tokens; bigrams that may be frequent.

    A bigram above a share of all tokens is above half of it in stretches that hold more than
    half of its occurrences, so those with a lower share need not be told.
    """

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        word, pair, start, own = (np.concatenate(p) for p in zip(*parts))
        at, hot = _find(cache.words, word)
        counts = np.stack([np.bincount(at[hot], w, len(cache.words)) for w in (None, own[hot])], axis=1)
        seen = np.flatnonzero(counts[:, 0])
        pairs, first, n = np.unique(pair[hot], return_index=True, return_counts=True)
        likely = n * 2 * FREQUENT_PAIRS > len(word)
        pairs, first, n = pairs[likely], np.flatnonzero(hot)[first[likely]], n[likely]
        counts = np.concatenate([[[len(word), own.sum()]], counts[seen]]).astype(np.int64)
        none = np.zeros(len(pairs), np.int64)
        columns = [
            pa.array(np.concatenate([[-1], seen, at[first]]).astype(np.int32)),
            pa.concat_arrays([pa.nulls(len(counts), pa.int64()), pa.array(W.signed(pairs))]),
            pa.concat_arrays([pa.nulls(len(counts), pa.bool_()), pa.array(start[first])]),
            pa.array(np.concatenate([counts[:, 0], n])),
            pa.array(np.concatenate([counts[:, 1], none])),
        ]
        return pa.RecordBatch.from_arrays(columns, _names(_FREQUENT))

    parts, size = [], 0
    for batch in batches:
        target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
        for chunk in W.chunks(batch.column("text")):
            found, word, pair, start = cache.tokens(chunk)
            parts.append((word, pair, start, target[chunk.first + found.text]))
            size += len(chunk.data)
            if size >= COUNT_BYTES:
                yield rows(parts)
                parts, size = [], 0
    if parts:
        yield rows(parts)


def _travel(batches: Iterator[pa.RecordBatch], cache: Cache) -> Iterator[pa.RecordBatch]:
    """The bigrams of a stretch of text on their way to the bucket that counts and scores them.

    An entry names a bigram once, by number as far as its words are frequent, with the texts
    that hold it.  Frequent bigrams stay with the stretch, only their counts travel.
    """
    block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

    def payload(word: np.ndarray, previous: np.ndarray, start: np.ndarray, pair: np.ndarray, text: np.ndarray, n: np.ndarray, follow: np.ndarray, own: np.ndarray) -> bytes:
        """Entries sorted by word and bigram."""
        new_pair = np.append(True, pair[1:] != pair[:-1])
        new_word = np.append(True, word[1:] != word[:-1])
        at_word, at_pair = np.flatnonzero(new_word), np.flatnonzero(new_pair)
        number, numbered = _find(cache.words, word[at_word])
        before, frequent = _find(cache.words, previous[at_pair])
        kind = np.where(start[at_pair], 0, np.where(frequent, 1, 2))
        return _store(
            np.where(numbered, number.astype(np.uint64), word[at_word]),
            numbered,
            np.diff(np.searchsorted(at_pair, np.append(at_word, len(pair)))),
            kind,
            before[kind == 1],
            previous[at_pair][kind == 2],
            np.diff(np.append(at_pair, len(pair))),
            text,
            n - 1,
            n - follow,
            own,
        )

    def rows(ids: list[pa.Array], tokens: list[np.ndarray], own: list[np.ndarray], parts: list[tuple]) -> pa.RecordBatch:
        text, pair, word, previous, start, n, follow = (np.concatenate(p) for p in zip(*parts))
        own = np.concatenate(own)
        at, hot = _find(cache.pairs, pair)
        out: list[tuple[int, bytes]] = []
        if hot.any():
            counts = [np.bincount(at[hot], w, len(cache.pairs)).astype(np.int64) for w in (n[hot], (n * own[text])[hot])]
            seen = np.flatnonzero(counts[0])
            place = seen % cache.buckets
            for i in np.unique(place).tolist():
                mine = seen[place == i]
                out.append((-1 - i, _store(mine, counts[0][mine], counts[1][mine])))
        base = _store(np.concatenate(tokens), text[hot], at[hot], n[hot], follow[hot])
        rest = ~hot
        text, pair, word, previous, start, n, follow = (c[rest] for c in (text, pair, word, previous, start, n, follow))
        bucket = cache.bucket(word, pair)
        order = np.lexsort((pair, word, bucket))
        bucket, columns = bucket[order], [c[order] for c in (word, previous, start, pair, text, n, follow)]
        bounds = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() if len(bucket) else []
        for low, high in zip(bounds, [*bounds[1:], len(bucket)]):
            out.append((int(bucket[low]), payload(*(c[low:high] for c in columns), own)))
        columns = [
            pa.array([*(r[0] for r in out), block % cache.buckets], pa.int32()),
            pa.array([block] * (len(out) + 1), pa.int64()),
            pa.array([*(r[1] for r in out), None], pa.binary()),
            pa.array([*([None] * len(out)), pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())),
            pa.array([*([None] * len(out)), base], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, _names(_SCORED))

    ids, tokens, own, parts, size, texts = [], [], [], [], 0, 0
    for batch in batches:
        target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
        for chunk in W.chunks(batch.column("text")):
            found, word, pair, start = cache.tokens(chunk)
            follow = np.append(~start[1:], False)[: len(start)]
            keyed = W.mix(pair + W.mix(found.text.astype(np.uint64)))
            _, first, place = np.unique(keyed, return_index=True, return_inverse=True)
            n = np.bincount(place, None, len(first))
            follow = np.bincount(place, follow, len(first)).astype(np.int64)
            columns = (pair, word, np.roll(word, 1), start)
            parts.append((found.text[first] + texts, *(c[first] for c in columns), n, follow))
            ids.append(batch.column("doc_id").slice(chunk.first, len(chunk)))
            tokens.append(found.count.astype(np.int64))
            own.append(target[chunk.first : chunk.first + len(chunk)])
            size, texts = size + len(chunk.data), texts + len(chunk)
            if size >= COUNT_BYTES:
                yield rows(ids, tokens, own, parts)
                ids, tokens, own, parts, size, texts, block = [], [], [], [], 0, 0, block + 1
    if parts:
        yield rows(ids, tokens, own, parts)


def _answer(table: pa.Table, cache: Cache) -> pa.Table:
    """Exact counts of the bigrams of a bucket, and the losses of its entries, summed by text."""
    names = _names(_ANSWERS)
    if table.column("bucket")[0].as_py() < 0:  # counts of frequent bigrams
        parts = [_load(p.as_py()) for p in table.column("entries")]
        number, *counts = (np.concatenate(c).astype(np.int64) for c in zip(*parts))
        number, place = np.unique(number, return_inverse=True)
        sums = _store(number, *(np.bincount(place, c, len(number)) for c in counts))
        own = [table.column("bucket").slice(0, 1), table.column("block").slice(0, 1), pa.array([sums], pa.binary())]
        return pa.table([*own, *(table.column(c).slice(0, 1) for c in names[3:])], names)

    def entries(payload: bytes) -> tuple[np.ndarray, ...]:
        code, numbered, pairs, kind, before, previous, repeats, text, n, short, own = _load(payload)
        if len(cache.words):
            code = np.where(numbered > 0, cache.words[np.where(numbered > 0, code, 0)], code)
        word = np.repeat(code, pairs.astype(np.int64))
        first = np.zeros(len(word), np.uint64)
        first[kind == 1], first[kind == 2] = cache.words[before], previous
        start = kind == 0
        text, n = text.astype(np.int64), n.astype(np.int64) + 1
        place = np.repeat(np.arange(len(word)), repeats.astype(np.int64))
        return _bigram(first, word, start), word, start, place, text, n, n - short.astype(np.int64), own > 0

    pairs, words, counts = [], [], []
    for payload in table.column("entries"):
        if payload.is_valid:
            pair, word, _, place, text, n, _, own = entries(payload.as_py())
            pairs.append(pair)
            words.append(word)
            counts.append(np.stack([np.bincount(place, w, len(pair)) for w in (n, n * own[text])], axis=1))
    out = []
    if pairs:
        pair, first, place = np.unique(np.concatenate(pairs), return_index=True, return_inverse=True)
        counts, word = np.concatenate(counts), np.concatenate(words)[first]
        counts = np.stack([np.bincount(place, counts[:, i], len(pair)) for i in (0, 1)], axis=1)
        known, place = np.unique(word, return_inverse=True)
        sums = np.stack([np.bincount(place, counts[:, i], len(known)) for i in (0, 1)], axis=1)
        at, hot = _find(cache.words, known)
        sums[hot] = cache.word_counts[at[hot]]
    for payload in table.column("entries"):
        if not payload.is_valid:
            out.append(None)
            continue
        wanted, word, start, place, text, n, follow, _ = entries(payload.as_py())
        seen, beside = counts[np.searchsorted(pair, wanted)][place], sums[np.searchsorted(known, word)][place]
        out.append(_sums_of_texts(text, cache.bits(seen, beside, start[place], n.astype(float), follow.astype(float))))
    return pa.table(
        [table.column("bucket"), table.column("block"), pa.array(out, pa.binary()), *(table.column(c) for c in names[3:])],
        names,
    )


def _sums_of_texts(text: np.ndarray, bits: np.ndarray) -> bytes:
    steps = np.rint(bits / STEP)
    texts, place = np.unique(text, return_inverse=True)
    sums = [np.bincount(place, steps[:, i], len(texts)).astype(np.int64) for i in (0, 1)]
    return _store(np.diff(texts, prepend=0), *(_zigzag(s) for s in sums))


def _conclude(table: pa.Table, cache: Cache) -> pa.Table:
    """Scores of the texts of a stretch, from the answers and its frequent bigrams."""
    (row,) = [r for r in zip(table.column("doc_id"), table.column("base")) if r[1].is_valid]
    tokens, text, at, n, follow = (x.astype(np.int64) for x in _load(row[1].as_py()))
    seen, beside = cache.pair_counts[at, :2], cache.pair_counts[at, 2:4]
    start = cache.pair_counts[at, 4] > 0
    own = _sums_of_texts(text, cache.bits(seen, beside, start, n.astype(float), follow.astype(float)))
    sums = np.zeros((len(tokens), 2), np.int64)
    for payload in [own, *(p.as_py() for p in table.column("sums") if p.is_valid)]:
        texts, *values = _load(payload)
        texts = np.cumsum(texts.astype(np.int64))
        for model in (0, 1):
            sums[texts, model] += _unzigzag(values[model])
    none = tokens == 0
    means = [sums[:, i] * STEP / np.maximum(tokens, 1) for i in (0, 1)]
    columns = [row[0].values, pa.array(tokens), *(pa.array(m, mask=none) for m in (means[1], means[0], means[1] - means[0]))]
    return pa.table(columns, _names(_SCORES))


def score_corpus(
    docs: DataFrame,
    *,
    target: str,
    doc_id: str = "doc_id",
    text: str = "text",
    models: Models = Models(),
) -> DataFrame:
    """Cross-entropy difference of every document under models counted over the same documents:
    the rows and columns of ``score_documents(docs, train(docs, target=target))``, with one
    shuffle of bigrams instead of two and no table of counts.

    The bigrams of a stretch of text travel once, to the bucket that holds all bigrams of their
    last word (of a frequent word: to the bucket of the bigram); it counts them and answers with
    losses by text.  Bigrams above a share of 1 / ``FREQUENT_PAIRS`` are counted by partial sums
    and broadcast (``cells`` is not used).  Sums are whole numbers, so results do not depend on
    how the input is split.  Null, empty and blank texts have no tokens and null losses; a null
    flag is false; without target documents the target model is uniform; repeated rows get equal
    scores; an empty table gives an empty result; other columns are not read.
    """
    flagged = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.col(f"`{text}`").alias("text"),
        F.coalesce(F.col(f"`{target}`").cast("boolean"), F.lit(False)).alias("target"),
    )
    context = docs.sparkSession.sparkContext
    cache = _sizes(flagged.select("text"), models, FREQUENT_WORDS)
    shared = context.broadcast(cache)
    frequent = flagged.select("text", "target").mapInArrow(lambda batches: _frequent(batches, shared.value), _FREQUENT)
    frequent = frequent.groupBy("word", "pair", "start").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))
    frequent = frequent.where(F.col("pair").isNull() | (F.col("background") * 2 * FREQUENT_PAIRS > float(cache.totals[0])))
    found = frequent.toArrow()  # at most FREQUENT_WORDS + 2 * FREQUENT_PAIRS rows
    pair = found.column("pair").combine_chunks()
    single = pair.is_null().to_numpy(zero_copy_only=False)
    word = found.column("word").to_numpy()
    counts = np.stack([found.column(c).to_numpy() for c in ("background", "target")], axis=1).astype(np.float64)
    cache.word_counts[word[single & (word >= 0)]] = counts[single & (word >= 0)]
    if (word < 0).any():
        cache.totals = counts[word < 0][0]
    pairs = pair.filter(pa.array(~single)).to_numpy(zero_copy_only=False).view(np.uint64)
    order = np.argsort(pairs)
    start = found.column("start").combine_chunks().filter(pa.array(~single)).to_numpy(zero_copy_only=False).astype(bool)
    cache.pairs, start, last = pairs[order], start[order], word[~single][order]

    known = context.broadcast(cache)
    answers = flagged.mapInArrow(lambda batches: _travel(batches, known.value), _SCORED)
    answers = answers.groupBy("bucket").applyInArrow(lambda own: _answer(own, known.value), _ANSWERS)
    answers = materialise(answers, "answers")
    seen = np.zeros((len(cache.pairs), 2))
    for sums in answers.where("bucket < 0").select("sums").toArrow().column("sums"):
        number, *values = _load(sums.as_py())
        seen[number.astype(np.int64)] = np.stack(values, axis=1)
    cache.pair_counts = np.column_stack([seen, cache.word_counts[last], start]) if len(last) else np.zeros((0, 5))
    final = context.broadcast(cache)
    answers = answers.where("bucket >= 0").select("block", "sums", "doc_id", "base")
    return answers.groupBy("block").applyInArrow(lambda own: _conclude(own, final.value), _SCORES)
