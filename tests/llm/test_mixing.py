from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from fixtures import FOLDER, awkward, empty, words

from featloom.llm.mixing import mix_sources, mixing_plan


def targets(sizes, weights, budget, cap):
    """Reshare by weight until no source is above its cap."""
    left, fixed = dict(weights), {}
    while left:
        level = (budget * sum(sizes.values()) - sum(fixed.values())) / sum(left.values())
        above = [s for s in left if level * left[s] >= cap * sizes[s]]
        if not above:
            return fixed | {s: level * w for s, w in left.items()}
        for s in above:
            fixed[s] = cap * sizes[s]
            del left[s]
    return fixed


def check(docs, weights=(3.0, 1.0, 2.0), budget=1.5):
    got = mixing_plan(docs, list(weights), budget=budget).collect()
    rows = docs.collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, len(words(r.text))) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, budget, 2.0)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(wanted[r.source])
        assert r.taken in (r["size"] * int(r.rate), r["size"] * (int(r.rate) + 1)) and r.taken <= 2 * r["size"]
    return got


def test_targets_and_taken_words(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = check(docs)
    again = mixing_plan(docs.repartition(3), [3.0, 1.0, 2.0]).collect()
    assert sorted(got) == sorted(again)
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), rel=0.05)


def test_taken_words_come_near_every_target(spark):
    docs = spark.range(60_000).selectExpr(
        "id AS doc_id", "repeat('word ', cast(5 + id % 90 AS int)) AS text", "concat('s', cast(sqrt(id) AS int) div 50) AS source",
    )
    taken, target = defaultdict(int), {}
    for r in check(docs, weights=(1.0, 5.0)):
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) < 0.05 * t + 100 for s, t in target.items())


def test_awkward_rows(spark):
    check(awkward(spark))
    assert mixing_plan(empty(spark), [1.0]).count() == 0
    assert mix_sources(empty(spark), [1.0]).columns == empty(spark).columns


def test_rows_are_repeated_as_planned(spark):
    docs = awkward(spark)
    copies = Counter()
    for r in mixing_plan(docs, [3.0, 1.0, 2.0]).collect():
        copies[r.doc_id, r.source, r["size"]] += r.copies
    mixed = Counter((r.doc_id, r.source, len(words(r.text))) for r in mix_sources(docs, [3.0, 1.0, 2.0]).collect())
    assert mixed == +copies
