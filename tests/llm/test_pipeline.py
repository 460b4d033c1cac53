from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import FOLDER, awkward, empty, words
from test_linededup import brute as brute_lines
from test_linededup import kept_text
from test_minhash import brute as brute_groups
from test_quality import base
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from featloom.plans.storage import materialise


@pytest.fixture(scope="module")
def steps(spark):
    """The input and the result of each stage."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], FOLDER), "step"))
    return out


def test_stages_return_documents(steps):
    assert [name for name, _ in pipeline.STAGES] == [
        "quality rules", "line dedup", "minhash near-dedup", "mixing sources", "packing",
    ]
    assert all(s.schema.simpleString() == steps[0].schema.simpleString() for s in steps[1:-1])


def test_quality(steps):
    kept = {r.doc_id: r for r in steps[1].collect()}
    for r in steps[0].collect():
        if base(r.text)[-1]:
            assert r.doc_id not in kept
        elif r.doc_id in kept:
            lines = Counter(r.text.split("\n"))
            assert not Counter(kept[r.doc_id].text.split("\n")) - lines
    good = [r for r in steps[0].collect() if not base(r.text)[-1]]
    assert sum(r.doc_id in kept for r in good) > 0.98 * len(good)


def test_lines(steps):
    rows = steps[1].collect()
    gone = brute_lines(rows)
    wanted = {r.doc_id: kept_text(r, gone[False, r.doc_id, r.text]) for r in rows}
    got = {r.doc_id: r for r in steps[2].collect()}
    assert {k: r.text for k, r in got.items()} == wanted
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_near_duplicates(steps):
    rows = steps[2].collect()
    _, roots = brute_groups(rows, 80)
    groups = defaultdict(list)
    for r, root in zip(rows, roots):
        groups[root].append(r.doc_id)
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(min(g) for g in groups.values())


def test_mixing(steps):
    before = {r.doc_id: r for r in steps[3].collect()}
    copies = Counter(r.doc_id for r in steps[4].collect())
    assert set(copies.values()) <= {1, 2} and copies.keys() <= before.keys()
    size = {k: len(words(r.text)) for k, r in before.items()}
    assert sum(size[k] * n for k, n in copies.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.05)


def test_packing(steps):
    tokenizer = Tokenizer.from_file(pipeline.vocabulary())
    tokenizer.encode_special_tokens = True
    total = Counter()
    for r in steps[4].collect():
        total.update([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0])
    got = Counter()
    for p in steps[5].collect():
        got.update(np.frombuffer(p.ids, "<u4").tolist())
        assert p.length * 4 == len(p.ids)
    assert got == total


def test_run_and_odd_tables(spark, tmp_path):
    for number, docs in enumerate((awkward(spark), empty(spark))):
        folder = f"{tmp_path}/{number}"
        docs.write.parquet(f"{folder}/documents.parquet")
        rows = pipeline.run(spark, folder).collect()
        assert bool(rows) == (number == 0)
