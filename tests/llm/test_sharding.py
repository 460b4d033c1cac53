from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from fixtures import FOLDER, awkward, empty

from featloom.llm.sharding import shard_records


def check(docs, rows):
    expected = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = shard_records(docs, [1.0] * 8, grown=[1.0] * 9).collect()
    check(docs, rows)
    assert {r.shard for r in rows} == set(range(8))
    assert all(r.grown_shard in (r.shard, 8) for r in rows), "a new shard takes rows only into itself"
    assert 0.06 < sum(r.grown_shard == 8 for r in rows) / len(rows) < 0.17
    again = shard_records(docs.repartition(5), [1.0] * 8, grown=[1.0] * 9).collect()
    assert sorted(again) == sorted(rows), "shards and slots do not depend on the layout"


def test_weights(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    counts = Counter(r.shard for r in shard_records(docs, [1, 2, 0, 3]).collect())
    assert counts[2] == 0
    assert all(abs(counts[i] / 6000 - w / 6) < 0.03 for i, w in enumerate([1, 2, 0, 3]))
    lighter = {r.doc_id: r.shard for r in shard_records(docs, [1, 1, 0, 3]).collect()}
    heavier = {r.doc_id: r.shard for r in shard_records(docs, [1, 2, 0, 3]).collect()}
    assert all(b == 1 for k, b in heavier.items() if lighter[k] != b), "more weight only draws rows in"


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = shard_records(docs, [1.0] * 8).collect()
    check(docs, rows)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert shard_records(empty(spark), [1.0]).count() == 0
    with pytest.raises(ValueError, match="weights"):
        shard_records(docs, [0.0])


def test_many_equal_rows(spark):
    docs = spark.range(150_000).selectExpr("cast(null AS long) AS doc_id", "'same' AS text")
    shards = shard_records(docs, [1.0] * 8)
    assert shards.selectExpr("count(distinct slot) n", "max(slot) m").first() == (150_000, 149_999)
