from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures import FOLDER, awkward, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from featloom.llm import packing
from featloom.llm.packing import Index, Rest, encoder, pack_documents
from featloom.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    loaded = Tokenizer.from_file(VOCABULARY)
    loaded.encode_special_tokens = True
    return loaded


def check(docs, pieces, tokenizer):
    """Documents come back whole from their pieces, and sequences are gapless and full."""
    rows = docs.collect()
    encoded = tokenizer.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    wanted = Counter((r.doc_id, np.array([*e.ids, 0], "<u4").tobytes()) for r, e in zip(rows, encoded))
    by_sequence, found = defaultdict(list), Counter()
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    own = defaultdict(list)
    for p in pieces:
        own[p.doc_id].append((p.start, bytes(p.ids), p.doc_tokens))
    for key, parts in own.items():
        if max(Counter(start for start, _, _ in parts).values()) > 1:  # documents with one id
            assert sum(len(i) for _, i, _ in parts) == sum(len(b) * n for (k, b), n in wanted.items() if k == key)
            found += Counter({w: n for w, n in wanted.items() if w[0] == key})
            continue
        parts.sort()
        ids = b"".join(i for _, i, _ in parts)
        assert [s for s, _, _ in parts] == np.cumsum([0, *(len(i) // 4 for _, i, _ in parts)])[:-1].tolist()
        assert {t for _, _, t in parts} == {len(ids) // 4}
        found[key, ids] += 1
    assert found == wanted
    lengths = []
    for parts in by_sequence.values():
        parts.sort()
        ends = np.cumsum([length for _, length in parts])
        assert [o for o, _ in parts] == [0, *ends[:-1]]
        lengths.append(int(ends[-1]))
    assert max(lengths, default=0) <= 1024
    return lengths


def test_long_runs_of_white_space(spark, tokenizer):
    """A million blanks, tabs or line breaks, alone and before a word."""
    texts = [c * 1_000_000 + end for c in " \t\n" for end in ("", "word")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs, pack_documents(docs, VOCABULARY).collect(), tokenizer)


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lengths = check(docs, pack_documents(docs, VOCABULARY).collect(), tokenizer)
    assert sum(n < 1024 for n in lengths) <= docs.rdd.getNumPartitions()


def test_small_shards_carry_open_windows_over(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").coalesce(1)
    lengths = check(docs, pack_documents(docs, VOCABULARY, shard_tokens=8_000).collect(), tokenizer)
    assert sum(n < 1024 for n in lengths) <= 1


def test_digest(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    pieces = {(p.doc_id, p.start): p for p in pack_documents(docs, VOCABULARY).collect()}
    rows = QUERIES["op9_retrieval_packing"](spark, FOLDER).collect()
    assert len(rows) == len(pieces)
    assert all(r.ids_crc32 == zlib.crc32(pieces[r.doc_id, r.start].ids) for r in rows)


def test_awkward_rows(spark, tokenizer):
    check(awkward(spark), pack_documents(awkward(spark), VOCABULARY).collect(), tokenizer)
    assert pack_documents(empty(spark), VOCABULARY).count() == 0


def test_ids_of_special_strings_and_odd_texts(tokenizer):
    texts = ["<|endoftext|> x", "a　b\x00c", "don't  stop\n\n\n now", "é" * 3000, "🙂🙃 𝒳", " " * 5000, "1" * 999]
    texts += ["we'll they've I'm he's you'd we're 'tis '", " \n a \t\u00a0\u2003b  ", "a\n", "a \n\n", "\r\n\r\nx", "--- '' 's", "a1b2 3c", ""]
    for text in texts:
        assert encoder(VOCABULARY)(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


ATOMS = [*" " * 8, *"\n\t\r\x0b\x0c\x1c\x1f\x00\x85\u00a0\u1680\u2003\u2028\u3000\u200b\ufeff\u0301", "a", "word", "é", "'s", "'", "''"]
ATOMS += ["don't", "12", "Ⅷ", "²", "一", "🙂", "-", "...", "<|endoftext|>", "x" * 300, "\n" * 300]


@pytest.mark.parametrize("size", [1, 100, 1 << 20])
def test_ids_of_texts_encoded_together(tokenizer, monkeypatch, size):
    """Blanks in runs of white space and at both ends; slices of one text and of many."""
    monkeypatch.setattr(packing, "SLICE", size)
    draw = random.Random(3)
    texts = ["".join(draw.choice(ATOMS) for _ in range(draw.randrange(14))) for _ in range(10_000)]
    texts += [None, "", " ", "  ", "   ", "\n \n", " \n ", "a  ", "  a", "a \n  b"]
    wanted = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for column in (pa.array(texts, pa.string()), pa.array(["-", *texts], pa.large_string())[1:]):
        assert [ids.tolist() for ids in packing.encode_texts(column, VOCABULARY)] == wanted
    assert list(packing.encode_texts(pa.array([], pa.string()), VOCABULARY)) == []


def test_each_word_is_encoded_once(monkeypatch):
    """The encoder sees a word once, however many documents hold it."""
    seen = []
    encode = encoder(VOCABULARY)
    monkeypatch.setattr(packing, "encoder", lambda _: lambda text: seen.append(text) or encode(text))
    texts = [f"{i % 7} " + " ".join(f"word{(i + j) % 50}," for j in range(100)) for i in range(500)]
    found = list(packing.encode_texts(pa.array(texts), VOCABULARY))
    assert [ids.tolist() for ids in found] == [encode(text).tolist() for text in texts]
    assert sum(map(len, seen)) < sum(map(len, texts)) / 100


def test_frequencies_of_terms(spark):
    """More documents than are sorted at once, some without ids."""
    draw = np.random.default_rng(2)
    tails = [draw.integers(0, 300, n).astype("<u2") for n in draw.integers(0, 40, 3000)]
    rows = spark.createDataFrame([(bytearray(t.tobytes()),) for t in tails], "tail binary").coalesce(1)
    counts, n, tokens = packing._frequencies(rows, 300, "<u2")
    assert counts.tolist() == np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=300).tolist()
    assert (n, tokens) == (sum(len(t) > 0 for t in tails), sum(map(len, tails)))


def test_neighbours_share_rare_terms():
    draw = np.random.default_rng(1)
    groups = [draw.integers(1000 * g, 1000 * g + 300, (20, 60)) for g in range(5)]
    rests = [Rest(i, np.append(row, draw.integers(9000, 9050, 40)), 0, 100) for i, row in enumerate(np.concatenate(groups))]
    held = np.bincount(np.concatenate([np.unique(r.ids) for r in rests]), minlength=9050)
    scores = Index(rests, np.log1p((100.5 - held) / (held + 0.5)), 100.0).scores(rests[0].ids)
    assert sum(5 <= i < 20 for i in [i for i in np.argsort(-scores) if i >= 5][:8]) >= 6


def windows(pieces):
    """Sequences as sets of pieces, whatever their numbers."""
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.doc_id, p.start, p.length))
    return Counter(tuple(sorted(parts)) for parts in by_sequence.values())


def test_split_of_the_input_does_not_matter(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = {"shard_tokens": 20_000, "group_tokens": 100_000}
    one, eight = (windows(pack_documents(docs.repartition(n), VOCABULARY, **sizes).collect()) for n in (1, 8))
    assert one == eight


def test_copies_spread_over_shards(spark, tokenizer):
    """A third of all documents agree; no group of shards takes more than its part."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    copies = spark.range(10_000, 10_500).select(F.col("id").alias("doc_id"), F.lit("one and the same text " * 100).alias("text"))
    both = docs.union(copies)
    pieces = pack_documents(both, VOCABULARY, shard_tokens=8_000, group_tokens=40_000).collect()
    check(both, pieces, tokenizer)
    sizes = Counter()
    for p in pieces:
        if p.sequence_id % 2 == 0:
            sizes[p.sequence_id >> 33] += p.length
    assert len(sizes) > 10 and max(sizes.values()) < 2 * 40_000


def test_best_neighbours_fill_each_window(spark, tokenizer):
    """Replay of one shard with plain dictionaries: no unused document scores above a chosen one."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300).select("doc_id", "text").collect()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    encoded = tokenizer.encode_batch([r.text or "" for r in docs], add_special_tokens=False)
    tails = {}
    for r, e in zip(docs, encoded):
        ids = [*e.ids, 0]
        if len(ids) % 1024:
            tails[r.doc_id] = ids[len(ids) // 1024 * 1024 :]
    n, mean = len(tails), sum(map(len, tails.values())) / len(tails)
    held = Counter(t for ids in tails.values() for t in set(ids))
    idf = {t: math.log1p((n - d + 0.5) / (d + 0.5)) if d > 1 else 0.0 for t, d in held.items()}
    counts = {d: Counter(ids) for d, ids in tails.items()}

    def score(terms, d):
        norm = 1.2 * (0.25 + 0.75 * len(tails[d]) / mean)
        return sum(idf[t] * counts[d][t] * 2.2 / (counts[d][t] + norm) for t in terms if t in counts[d])

    sequences = defaultdict(list)
    for p in pack_documents(frame, VOCABULARY, shard_tokens=1 << 30, group_tokens=1 << 30).collect():
        if p.sequence_id % 2 == 0:
            sequences[p.sequence_id].append((p.offset, p.doc_id, p.length))
    left = {d: len(ids) for d, ids in tails.items()}
    for _, pieces in sorted(sequences.items()):
        pieces.sort()
        _, seed, length = pieces[0]
        terms = set(tails[seed][-left[seed] :])
        assert length == left.pop(seed)
        chosen = []
        for _, d, length in pieces[1:]:
            chosen.append(score(terms, d))
            left[d] -= length
            if not left[d]:
                del left[d]
        assert all(a >= b - 1e-9 for a, b in zip(chosen, chosen[1:]))
        cut = pieces[-1][1]
        others = [score(terms, d) for d in left if d != cut]
        if chosen and others:
            assert max(others) <= chosen[-1] + 1e-9
        assert sum(length for _, _, length in pieces) == 1024 or not left
    assert not left


def test_one_python_worker_per_task(spark):
    """Two Python operators in a row hold two workers with their memory, idle ones long after the stage."""
    pieces = pack_documents(spark.read.parquet(f"{FOLDER}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3  # full windows, places, shards
