from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from fixtures import FOLDER, awkward, empty, words
from pyspark.sql import functions as F

from featloom.llm.lmscore import Models, score_corpus, score_documents, train


def tokens(text):
    return words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, models, vocabulary):
    """Losses of all texts, from exact counts; ``vocabulary`` is a set of words."""
    texts = [[t if t in vocabulary else None for t in tokens(r.text)] for r in rows]
    out = []
    counts = []
    for own in ([True] * len(rows), [bool(r.target) for r in rows]):
        used = [t for t, u in zip(texts, own) if u]
        counts.append((Counter(w for t in used for w in t), Counter(p for t in used for p in zip(t, t[1:]))))
    for r, text in zip(rows, texts):
        losses = []
        for single, pairs in counts:
            bits = 0.0
            for i, w in enumerate(text):
                p = (single[w] + models.alpha) / (sum(single.values()) + models.alpha * (len(vocabulary) + 1))
                if i:
                    seen = single[text[i - 1]]
                    p = (min(pairs[text[i - 1], w], seen) + models.prior * p) / (seen + models.prior)
                bits -= math.log2(p)
            losses.append(bits / len(text) if text else None)
        out.append((r.doc_id, len(text), losses[1], losses[0]))
    return out


def test_losses_of_exact_counts(spark):
    models = Models(vocabulary=10_000)  # holds all words, and cells enough for few collisions
    docs = awkward(spark).where("length(text) < 60000 OR text IS NULL").withColumn("target", F.col("source") == "a")
    got = score_documents(docs, train(docs, target="target", models=models)).collect()
    rows = docs.collect()
    wanted = brute(rows, models, {w for r in rows for w in tokens(r.text)})
    got = sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens))
    for r, (doc_id, n, target, background) in zip(got, sorted(wanted, key=lambda x: (str(x[0]), x[1]))):
        assert (r.doc_id, r.n_tokens) == (doc_id, n)
        if n == 0:
            assert r.target_loss is r.background_loss is r.score is None
        else:
            assert (r.target_loss, r.background_loss) == pytest.approx((target, background), rel=1e-5)
            assert r.score == pytest.approx(target - background, abs=1e-4)


def test_vocabulary_holds_the_most_frequent_words(spark):
    docs = spark.createDataFrame([(1, "a a a b b c", True), (2, "a b d", False)], "doc_id long, text string, target boolean")
    losses = train(docs, target="target", models=Models(vocabulary=2, cells=1 << 12))
    assert len(losses.vocabulary) == 2 and sorted(losses.words[:, 0]) == [2, 3, 4]


def test_held_out_accuracy(spark):
    """Trained on one half of the labelled documents, the score tells prose from junk in the other."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = docs.join(labels, "doc_id", "left").withColumn("target", (F.col("quality") == 1) & (F.xxhash64("doc_id") % 2 == 0))
    scores = score_documents(docs, train(rows, target="target"))
    held = scores.join(labels, "doc_id").where("xxhash64(doc_id) % 2 != 0 AND n_tokens > 20").select("score", "quality").collect()
    good = np.array([r.score for r in held if r.quality == 1])
    junk = np.array([r.score for r in held if r.quality == 0])
    assert len(good) > 50 and len(junk) > 5
    assert (good[:, None] < junk[None, :]).mean() > 0.7


def test_empty_table(spark):
    docs = empty(spark).withColumn("target", F.lit(True))
    assert score_documents(docs, train(docs, target="target", models=Models(cells=1 << 12))).count() == 0


def test_default_models_keep_every_word_and_bigram(spark, monkeypatch):
    """More distinct words and bigrams than any fixed table would tell apart, in several buckets and blocks."""
    from featloom.llm import lmscore

    monkeypatch.setattr(lmscore, "BUCKET", 1 << 15)
    random = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{w}" for w in random.integers(0, 1 << 30, 1000)) + " and so on", i % 3 == 0) for i in range(120)]
    rows += [(i, rows[i - 500][1], False) for i in range(500, 510)] + [(600, "and so on", True), (601, None, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, target boolean")
    models = Models(cells=1 << 10)
    losses = train(docs, target="target", models=models)
    assert losses.cache.size > 1 << 16 and losses.cache.buckets > 1
    got = {r.doc_id: r for r in score_documents(docs, losses).collect()}
    assert len(got) == len(rows)
    texts = {r[0]: tokens(r[1]) for r in rows}
    single = Counter(w for t in texts.values() for w in t)
    pairs = Counter(p for t in texts.values() for p in zip(t, t[1:]))
    total = sum(single.values())
    for doc_id, text in texts.items():
        bits = 0.0
        for i, w in enumerate(text):
            p = (single[w] + models.alpha) / (total + models.alpha * (len(single) + 1))
            if i:
                p = (pairs[text[i - 1], w] + models.prior * p) / (single[text[i - 1]] + models.prior)
            bits -= math.log2(p)
        assert got[doc_id].n_tokens == len(text)
        if text:
            assert got[doc_id].background_loss == pytest.approx(bits / len(text), rel=1e-6)


def test_unseen_words_and_bigrams(spark):
    docs = spark.createDataFrame([(1, "a b a b c", True), (2, "a c", False)], "doc_id long, text string, target boolean")
    models = Models()
    losses = train(docs, target="target", models=models)
    other = spark.createDataFrame([(9, "c a z b")], "doc_id long, text string")
    (r,) = score_documents(other, losses).collect()
    single = {"a": 3, "b": 2, "c": 2, "z": 0}
    p = {w: (n + models.alpha) / (7 + models.alpha * 4) for w, n in single.items()}
    chances = [p["c"], models.prior * p["a"] / (2 + models.prior), models.prior * p["z"] / (3 + models.prior), p["b"]]
    assert r.background_loss == pytest.approx(-sum(map(math.log2, chances)) / 4, rel=1e-5)


def agree(got, wanted):
    got = sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens))
    wanted = sorted(wanted, key=lambda x: (str(x[0]), x[1]))
    assert len(got) == len(wanted)
    for r, (doc_id, n, target, background) in zip(got, wanted):
        assert (r.doc_id, r.n_tokens) == (doc_id, n)
        if n == 0:
            assert r.target_loss is r.background_loss is r.score is None
        else:
            assert (r.target_loss, r.background_loss) == pytest.approx((target, background), rel=1e-6, abs=1e-6)
            assert r.score == pytest.approx(target - background, abs=1e-5)


@pytest.mark.parametrize("share", [1, 1 << 8, 1 << 16])
@pytest.mark.parametrize("vocabulary", [None, 40])
def test_corpus_of_awkward_rows(spark, monkeypatch, share, vocabulary):
    """Long texts included, with no, some and most words and bigrams frequent, in several buckets and stretches."""
    from featloom.llm import lmscore

    monkeypatch.setattr(lmscore, "BUCKET", 1 << 9)
    monkeypatch.setattr(lmscore, "FREQUENT_WORDS", share)
    monkeypatch.setattr(lmscore, "FREQUENT_PAIRS", share)
    docs = awkward(spark).withColumn("target", F.col("source") == "a")
    rows = docs.collect()
    single = Counter(w for r in rows for w in tokens(r.text))
    if vocabulary is None:
        known = set(single)
    else:  # ties go by hash, so take those that are certain
        ranked = sorted(single.values(), reverse=True)
        vocabulary = next(n for n in range(vocabulary, 0, -1) if n >= len(ranked) or ranked[n - 1] > ranked[n])
        known = {w for w, _ in single.most_common(vocabulary)}
    models = Models(vocabulary=vocabulary)
    agree(score_corpus(docs, target="target", models=models).collect(), brute(rows, models, known))


def test_corpus_does_not_depend_on_its_layout(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("target", F.col("doc_id") % 3 == 0)
    one, many = (sorted(score_corpus(docs.repartition(n, "doc_id"), target="target").collect()) for n in (1, 7))
    assert one == many
    both = {r.doc_id: r for r in score_documents(docs, train(docs, target="target")).collect()}
    assert len(both) == len(one)
    for r in one:
        if r.n_tokens:
            assert (r.target_loss, r.background_loss) == pytest.approx((both[r.doc_id].target_loss, both[r.doc_id].background_loss), rel=1e-5)


def test_corpus_without_rows_or_target(spark):
    assert score_corpus(empty(spark).withColumn("target", F.lit(True)), target="target").count() == 0
    docs = spark.createDataFrame([(1, "a b", None), (2, None, True)], "doc_id long, text string, target boolean")
    agree(score_corpus(docs, target="target").collect(), brute(docs.collect(), Models(), {"a", "b"}))


def test_query_joins_labels_alike_however_many(spark, monkeypatch, tmp_path):
    """Broadcast or shuffled ids, repeated ids and labels, columns with the names that the query uses."""
    from featloom.llm import queries

    docs = [(1, "a b a", 0), (1, "c d", 0), (2, None, 0), (3, "a b e", 0), (None, "a", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, good int").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1, 0, "x"), (1, 1, 1, "y"), (2, 1, 0, "z"), (3, 0, 0, "x"), (None, 1, 0, "x")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    few = queries.op1_cross_entropy_difference(spark, str(tmp_path)).collect()
    monkeypatch.setattr(queries, "BROADCAST_IDS", 0)
    many = queries.op1_cross_entropy_difference(spark, str(tmp_path)).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens)
    assert sorted(few, key=key) == sorted(many, key=key)
    rows = spark.createDataFrame([(*d[:2], d[0] in (1, 2)) for d in docs], "doc_id long, text string, target boolean").collect()
    agree(few, brute(rows, Models(), {"a", "b", "c", "d", "e"}))
