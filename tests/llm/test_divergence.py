from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from fixtures import FOLDER, awkward, empty

from featloom.llm import divergence
from featloom.llm.divergence import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=3, top=200):
    """The definition, term by term and pair by pair."""
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(found)
        df[lang or ""].update(set(found))
    result = []
    for lang in {g[0] for g in counts}:
        kept = {t for t, n in df[lang].items() if n >= least}
        sources = sorted(s for x, s in counts if x == lang)
        whole = Counter()
        for s in sources:
            whole.update({t: n for t, n in counts[lang, s].items() if t in kept})

        def prices(held):
            total = sum(held[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (held[t] + 1) // total for t in kept}

        p = {s: prices(counts[lang, s]) for s in sources}
        q = prices(whole)
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                result += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(items[:limit], 1)]
    return sorted(result)


def check(docs, **options):
    found = sorted(tuple(r) for r in source_divergence(docs, **options).collect())
    assert found == brute([(r.text, r.lang, r.source) for r in docs.collect()], **options)
    return found


def test_whole_table(spark):
    rows = check(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert {r[2] for r in rows} == {"pair", "term"}


def test_awkward_rows(spark):
    docs = awkward(spark)
    check(docs, least=1)
    check(docs.union(docs).union(docs))
    assert source_divergence(empty(spark)).count() == 0
    texts = ["Ünïcode ÉÀ é x A_b-C1d", "KK kk K İ", "a" * 300_000, "\x00\x01", None]
    rows = [(t, lang, s) for t in texts for lang in ("de", None) for s in ("s", "", None, "t")]
    check(spark.createDataFrame(rows, "text string, lang string, source string"), least=2, top=2)


def test_blocks_and_merges_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang = 'de'")
    expected = sorted(map(tuple, source_divergence(docs).collect()))
    monkeypatch.setattr(divergence, "BLOCK", 700)
    assert sorted(map(tuple, source_divergence(docs.repartition(7)).collect())) == expected
    texts = divergence.pa.array([r.text for r in docs.collect()])
    batch = divergence.pa.RecordBatch.from_arrays([texts, divergence.pa.array(["x"] * len(texts)), texts.slice(0)], ["text", "lang", "source"])
    batch = batch.set_column(2, "source", divergence.pa.array([str(i % 3) for i in range(len(texts))]))

    def total():
        counted = Counter()
        for part in divergence._count(iter([batch])):
            for row in part.to_pylist():
                counted[row["source"], row["term"]] += row["n"] * 1_000_000 + row["df"]
        return counted

    whole = total()
    monkeypatch.setattr(divergence, "GATHER", 50)
    monkeypatch.setattr(divergence, "CHUNK", 1000)
    assert total() == whole


def test_counts_beyond_64_bits():
    counts, total = np.array([5, 10**12]), np.array([10**13, 10**13])
    assert divergence._price(counts, total).tolist() == [1 + 10**9 * 6 // 10**13, 1 + 10**9 * (10**12 + 1) // 10**13]


def test_one_source_with_a_third_of_the_rows(spark):
    docs = spark.range(3000).selectExpr(
        "concat('common words of every page ', substring(md5(cast(id % 40 AS string)), 1, 4)) AS text",
        "'en' AS lang",
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 30) END AS source",
    )
    check(docs)
