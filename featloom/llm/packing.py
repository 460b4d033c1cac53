"""Lexical retrieval packing: neighbours of each seed document fill its window."""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.plans.storage import materialise

#: Fixed value: how byte-level vocabularies cut texts before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of texts whose words are encoded together.
SLICE = 8 << 20
#: No word, or one with white space at an end.
ODD = r"\A\z|\A[\t-\r\x1c- \x{85}\pZ]|[\t-\r\x1c- \x{85}\pZ]\z"
#: Usual constants of BM25.
K1, B = 1.2, 0.75

_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@functools.cache
def ranks(vocabulary: str) -> dict[bytes, int] | None:
    """Ids by their bytes, for a byte-level BPE file that numbers them in the order of the merges."""
    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    vocab, merges = model["vocab"], model["merges"]
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges]
    if any(vocab.get(m) != 256 + i for i, m in enumerate(joined)):
        return None
    names = [t for t in vocab if vocab[t] < 256 + len(joined)]
    return {bytes(to_byte[c] for c in t): vocab[t] for t in names}


@functools.cache
def encoder(vocabulary: str):
    """Function from a text to its ids, for a byte-level BPE file of the tokenizers library.

    Where ids are numbered in the order of the merges, a rank encoder gives the same ids
    several times faster; otherwise the library itself encodes.
    """
    if ranks(vocabulary) is None:
        return library(vocabulary)
    import tiktoken

    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks(vocabulary), special_tokens={})

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # a run of white space is too long for its search
            return library(vocabulary)(text)

    return encode


@functools.cache
def widths(vocabulary: str) -> np.ndarray:
    """Number of bytes of each id of a rank encoder."""
    found = np.zeros(max(ranks(vocabulary).values()) + 1, np.int64)
    for piece, i in ranks(vocabulary).items():
        found[i] = len(piece)
    return found


def encode_texts(texts: pa.Array, vocabulary: str) -> Iterator[np.ndarray]:
    """Ids of each text.  A rank encoder sees every word once for ``SLICE`` bytes of texts."""
    encode, first, before = encoder(vocabulary), 0, 0
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        part = texts.slice(first, stop - first)
        if ranks(vocabulary) is None or ends[stop - 1] - before > SLICE:
            yield from map(encode, part.to_pylist())
        else:
            yield from _by_words(part.cast(pa.string()), encode, widths(vocabulary))
        first, before = stop, ends[stop - 1]


def _by_words(texts: pa.Array, encode, width: np.ndarray) -> Iterator[np.ndarray]:
    """Ids of each text, put together from those of its words with the blank before them.

    ``SPLIT`` looks at nothing before a token, and past its end only in white space.  So texts may
    be cut before any blank, unless it lies inside a run of white space and does not end it;
    a text with such a run is encoded as a whole.  Words without white space at their ends
    are encoded as one text, and the bytes of its ids tell where each one ends.
    """
    parts = pc.split_pattern(texts, " ")
    words = parts.flatten().dictionary_encode()
    known, codes = words.dictionary, words.indices.to_numpy().copy()
    bounds = np.cumsum(np.append(0, pc.list_value_length(parts).to_numpy()))
    odd = pc.or_(pc.match_substring_regex(known, ODD), pc.greater(pc.binary_length(known), 256))
    plain, odd = known.filter(pc.invert(odd)), odd.to_numpy(zero_copy_only=False)
    alone = [" " + word for word in known.filter(pa.array(odd)).to_pylist()]
    opening = known.take(pa.array(codes[bounds[:-1]])).to_pylist()  # no blank before them
    codes[bounds[:-1]] = np.arange(len(known), len(known) + len(opening))

    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), " ")
    ids = encode(" " + joined[0].as_py())
    own = pc.binary_length(plain).to_numpy().astype(np.int64) + 1
    cuts = np.append(0, np.searchsorted(np.cumsum(width[ids]), np.cumsum(own)) + 1)
    others = [encode(text) for text in alone + opening]
    ids = np.concatenate([ids[: cuts[-1]], *others])
    lengths = np.append(np.diff(cuts), [len(o) for o in others]).astype(np.int32)
    order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd), np.arange(len(known), len(lengths))])
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    codes = place[codes]

    runs = np.zeros((2, len(lengths)), bool)  # of white space, after the blank and at the end
    runs[0, len(plain) :] = [text[1:2].isspace() or text == " " for text in alone] + [False] * len(opening)
    runs[1, len(plain) :] = [text[-1:].isspace() for text in alone + opening]
    inside = np.flatnonzero(runs[1, codes[:-1]] & runs[0, codes[1:]])
    whole = set((np.searchsorted(bounds, inside, side="right") - 1).tolist())

    sizes = lengths[codes]
    ends = np.cumsum(sizes, dtype=np.int32)
    starts = np.cumsum(lengths, dtype=np.int32) - lengths
    found = ids[np.repeat(starts[codes] - ends + sizes, sizes) + np.arange(ends[-1], dtype=np.int32)]
    for i, own in enumerate(np.split(found, ends[bounds[1:-1] - 1])):
        yield encode(texts[i].as_py()) if i in whole else own


@functools.cache
def library(vocabulary: str):
    """The same by the tokenizers library."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    slow.encode_special_tokens = True
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def vocabulary_size(vocabulary: str) -> int:
    """One more than the largest id of a file of the tokenizers library."""
    with open(vocabulary, encoding="utf-8") as file:
        content = json.load(file)
    added = [token["id"] for token in content.get("added_tokens") or []]
    return 1 + max([*content["model"]["vocab"].values(), *added])


@dataclass
class Rest:
    """What is left of a document: ids from ``start`` on."""

    doc_id: int | None
    ids: np.ndarray
    start: int
    total: int


class Index:
    """BM25 inverted index over the documents of one shard; terms are token ids.

    ``idf`` by term and the ``mean`` length are those of the corpus.  Postings of terms that a
    quarter of the shard holds are rows of a matrix, so that a query adds them up by rows.
    """

    def __init__(self, rests: list[Rest], idf: np.ndarray, mean: float):
        lengths = np.array([len(r.ids) for r in rests], np.int64)
        n = self.n = len(rests)
        terms = np.concatenate([r.ids for r in rests]).astype(np.int64)
        keys, counts = np.unique(terms * n + np.repeat(np.arange(n), lengths), return_counts=True)
        term, self.docs = np.divmod(keys, n)
        self.terms, self.first, self.frequency = np.unique(term, return_index=True, return_counts=True)
        norm = K1 * (1 - B + B * lengths / mean)
        self.weight = idf[term] * counts * (K1 + 1) / (counts + norm[self.docs])
        common = self.frequency * 4 > n
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        place = np.repeat(self.row, self.frequency)
        self.dense = np.zeros((int(common.sum()), n))
        self.dense[place[place >= 0], self.docs[place >= 0]] = self.weight[place >= 0]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Score of every document of the shard for all terms of a seed."""
        at = np.searchsorted(self.terms, np.unique(ids))
        rows = self.row[at]
        rare = at[(rows < 0) & (self.frequency[at] > 1)]
        sizes = self.frequency[rare]
        ends = np.cumsum(sizes)
        posting = np.repeat(self.first[rare] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        found = np.bincount(self.docs[posting], self.weight[posting], self.n)
        return found + self.dense[rows[rows >= 0]].sum(axis=0)


class Rows:
    """Pieces on their way to an Arrow batch."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, sequence: int, offset: int, rest: Rest, length: int) -> None:
        ids = rest.ids[:length].astype("<u4").tobytes()
        self.rows.append((rest.doc_id, rest.start, length, ids, rest.total, sequence, offset))

    def batch(self) -> pa.RecordBatch:
        names = [part.split()[0] for part in _SCHEMA.split(", ")]
        columns = list(zip(*self.rows)) or [()] * len(names)
        self.rows = []
        kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


class Packer:
    """Packs one group of shards, shard after shard."""

    def __init__(self, rows: Rows, group: int, window: int, idf: np.ndarray, mean: float):
        self.rows, self.window, self.idf, self.mean = rows, window, idf, mean
        self.sequence = group << 33  # even numbers; those of full windows are odd

    def _emit(self, pieces: list[tuple[Rest, int]]) -> None:
        offset = 0
        for rest, length in pieces:
            self.rows.add(self.sequence, offset, rest, length)
            offset += length
        self.sequence += 2

    def pack(self, rests: list[Rest], *, last: bool) -> list[Rest]:
        """Fill windows.  Without ``last``, the documents of an open window are returned."""
        if not rests:
            return []
        rests = list(rests)
        index = Index(rests, self.idf, self.mean)
        left = np.array([len(r.ids) for r in rests], np.int64)
        for seed in range(len(rests)):
            if not left[seed]:
                continue
            pieces, free = [(rests[seed], int(left[seed]))], self.window - int(left[seed])
            left[seed] = 0
            if free:
                unused = np.flatnonzero(left)
                scores = index.scores(rests[seed].ids)[unused]
                ranked = unused[np.argsort(-scores, kind="stable")]
                ends = np.cumsum(left[ranked])
                whole = int(np.searchsorted(ends, free, side="right"))
                pieces += [(rests[i], int(left[i])) for i in ranked[:whole]]
                free -= int(ends[whole - 1]) if whole else 0
                left[ranked[:whole]] = 0
                if free and whole < len(ranked):  # the next one is cut
                    i = ranked[whole]
                    rest = rests[i]
                    pieces.append((rest, free))
                    rests[i] = Rest(rest.doc_id, rest.ids[free:], rest.start + free, rest.total)
                    left[i] -= free
                    free = 0
            if free and not last:
                return [rest for rest, _ in pieces]
            self._emit(pieces)
        return []


def _mixed(values: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly over all others."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _partition() -> int:
    return TaskContext.get().partitionId() if TaskContext.get() else 0


def _encode(docs: DataFrame, vocabulary: str, window: int, end_id: int, kind: str) -> DataFrame:
    """A row per document: ids in full windows (``head``), those left (``tail``), and their number."""
    schema = pa.schema([("doc_id", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode_texts(batch.column("text"), vocabulary)):
                ids = np.append(ids, np.uint32(end_id)).astype(kind)
                cut = len(ids) // window * window
                rows.append((key, ids[:cut].tobytes(), ids[cut:].tobytes(), len(ids)))
                size += ids.nbytes
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, head binary, tail binary, doc_tokens long")


def _full_windows(encoded: DataFrame, window: int, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sequence = Rows(), (_partition() << 33) + 1
        for batch in batches:
            for key, head, total in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "head", "doc_tokens"))):
                ids = np.frombuffer(head, kind)
                for start in range(0, len(ids), window):
                    rows.add(sequence, 0, Rest(key, ids[start:], start, total), window)
                    sequence += 2
                    if len(rows.rows) >= 2048:
                        yield rows.batch()
        yield rows.batch()

    heads = encoded.select("doc_id", "head", "doc_tokens").filter(F.length("head") > 0)
    return heads.mapInArrow(run, _SCHEMA)


def _frequencies(encoded: DataFrame, size: int, kind: str) -> tuple[np.ndarray, int, int]:
    """Documents that hold each term, documents, and ids, of all tails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 2, np.int64)
        for batch in batches:
            tails = batch.column("tail").to_pylist()
            for first in range(0, len(tails), 1024):  # ids of many documents sorted at once
                part = tails[first : first + 1024]
                ids = np.frombuffer(b"".join(part), kind)
                own = np.array([len(tail) // ids.itemsize for tail in part])
                keys = np.sort(np.repeat(np.arange(len(part)) * size, own) + ids)
                held = keys[np.diff(keys, prepend=-1) > 0]
                counts[:size] += np.bincount(held % size, minlength=size)
                counts[size] += np.count_nonzero(own)
                counts[size + 1] += len(ids)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["term", "n"])

    rows = encoded.select("tail").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(size + 2, np.int64)
    for term, n in rows.collect():  # a row per term of the vocabulary
        counts[term] = n
    return counts[:size], int(counts[size]), int(counts[size + 1])


def _routes(rank: np.ndarray, kind: str):
    """Function from batches of tails to those with their signature: the first of their terms in the order of ``rank``; and a salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.uint64(_partition() << 33)
        for batch in batches:
            tails = batch.column("tail").to_pylist()
            first = [int(rank[np.frombuffer(tail, kind)].min()) for tail in tails]
            keys = batch.column("doc_id")
            own = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            places = place + np.arange(len(tails), dtype=np.uint64)
            place += np.uint64(len(tails))
            own = np.where(keys.is_null().to_numpy(zero_copy_only=False), ~places, own)
            sums = np.array([zlib.crc32(tail) for tail in tails], np.uint64)
            salt = (_mixed(_mixed(own) ^ sums) >> np.uint64(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "tail", "doc_tokens")), pa.array(first, pa.int64()), pa.array(salt)],
                ["doc_id", "tail", "doc_tokens", "signature", "salt"],
            )

    return run


def _ranks(idf: np.ndarray) -> np.ndarray:
    """Order of the terms in which one comes before others with a chance like its weight."""
    draws = np.random.default_rng(9).exponential(size=len(idf))
    with np.errstate(divide="ignore"):
        order = np.argsort(draws / idf, kind="stable")
    rank = np.empty(len(idf), np.int64)
    rank[order] = np.arange(len(idf))
    return rank


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    *,
    window: int = 1024,
    end_id: int = 0,
    shard_tokens: int = 1 << 18,
    group_tokens: int = 1 << 22,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of ``window`` ids.

    Every document is encoded and ends with ``end_id``.  Its full windows become sequences; what
    is left of it takes part in retrieval.  Documents are routed to shards by a lexical signature:
    the first of their terms in an order of the vocabulary drawn by the weights (idf over the whole
    corpus), so that two documents share it with a chance like their weighted overlap.  The
    signatures lie one behind the other on a line as long as all that is left, each as long as its
    documents; a hash of its key and ids puts a document somewhere on the stretch of its
    signature, and a shard is ``shard_tokens`` of that line.  So shards are nearly equal, and
    a frequent signature, or thousands of copies, are spread over as many shards as they need.

    Each shard has a BM25 inverted index.  Each document in turn seeds a window, all of its terms
    score all unused documents of the shard, and the best fill the window, the last one cut; its
    remainder stays in the pool.  An open window is carried to the next shard, within a group of
    shards (``group_tokens`` of the line), which is what a task works through; so every sequence is
    full but one per group.  Which documents meet does not depend on how the input is split (but
    for documents without id, whose place stands for it).  What reaches the driver is a row per term of
    the vocabulary.  A task holds one shard at a time; rows that agree in id and text lie on
    one point, and four shards of them are packed at once.

    Returns one row per piece: ``doc_id``, ``start`` (ids of its document before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and
    ``offset``.  A null or empty text is the one id ``end_id``; repeated rows and rows without
    id are documents of their own; an empty table gives an empty result; other columns are
    not read.
    """
    size = max(vocabulary_size(vocabulary), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    encoded = materialise(_encode(rows, vocabulary, window, end_id, kind), "encoded")
    holders, n, tokens = _frequencies(encoded, size, kind)
    idf = np.where(holders > 1, np.log1p((n - holders + 0.5) / (holders + 0.5)), 0.0)
    mean = tokens / max(n, 1)

    routes = _routes(_ranks(idf), kind)
    tails = encoded.select("doc_id", "tail", "doc_tokens").filter(F.length("tail") > 0)
    routed = tails.mapInArrow(routes, "doc_id long, tail binary, doc_tokens long, signature long, salt long")
    sizes = np.zeros(size, np.int64)
    width = int(np.dtype(kind).itemsize)
    ids = (F.length("tail") / width).cast("long")
    for signature, total in routed.groupBy("signature").agg(F.sum(ids)).collect():  # as many at most
        sizes[signature] = total
    starts = np.cumsum(sizes) - sizes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in routes(batches):
            signature = batch.column("signature").to_numpy()
            point = starts[signature] + batch.column("salt").to_numpy() % sizes[signature]
            columns = [batch.column(c) for c in ("doc_id", "tail", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(point), pa.array(point // group_tokens)],
                ["doc_id", "tail", "doc_tokens", "point", "group"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, packer, current = Rows(), None, None
        rests: list[Rest] = []
        held = 0
        for batch in batches:
            names = ("doc_id", "tail", "doc_tokens", "point", "group")
            for key, tail, total, point, group in zip(*(batch.column(c).to_pylist() for c in names)):
                shard = (group, point // shard_tokens)
                if shard != current or held >= 4 * shard_tokens:
                    if packer is not None:
                        rests = packer.pack(rests, last=shard[0] != current[0])
                        held = sum(len(r.ids) for r in rests)
                    if current is None or group != current[0]:
                        packer = Packer(out, group, window, idf, mean)
                    current = shard
                ids = np.frombuffer(tail, kind)
                rests.append(Rest(key, ids, total - len(ids), total))
                held += len(ids)
                if len(out.rows) >= 2048:
                    yield out.batch()
        if packer is not None:
            packer.pack(rests, last=True)
        yield out.batch()

    tasks = min(4 * (1 + tokens // group_tokens), 1 << 14)  # four times as many as groups, as hashes collide
    # routed once more, so that a task has one Python worker and not two in a row
    placed = tails.mapInArrow(place, "doc_id long, tail binary, doc_tokens long, point long, group long")
    shards = placed.repartition(tasks, "group").sortWithinPartitions("point", "doc_id", "doc_tokens", "tail")
    return _full_windows(encoded, window, kind).unionByName(shards.mapInArrow(run, _SCHEMA))
