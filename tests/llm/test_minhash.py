from __future__ import annotations

import random

import numpy as np
import pytest
from fixtures import FOLDER, awkward, empty, words

from featloom.llm.components import connected_components
from featloom.llm.minhash import SIZE, drop_near_duplicates, minhash_groups, superminhash
from featloom.llm.words import mix


def shingles(text):
    found = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute(rows, percent):
    """Component of each row, by comparing all sets that share a shingle."""
    sets = [shingles(r.text) for r in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = list(range(len(rows)))
    seen = set()
    for group in holders.values():
        for n, i in enumerate(group):
            for j in group[:n]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                        parent[find(parent, i)] = find(parent, j)
    return sets, [find(parent, i) for i in range(len(rows))]


def check(docs, percent):
    rows = docs.collect()
    sets, roots = brute(rows, percent)
    least = {}
    for r, root in zip(rows, roots):
        if r.doc_id is not None:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    wanted = sorted(
        (str(r.doc_id), len(s), str(c := least.get(root)), r.doc_id == c) for r, s, root in zip(rows, sets, roots)
    )
    got = minhash_groups(docs, percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == wanted
    return got


@pytest.mark.parametrize("percent", [80, 85])
def test_whole_table(spark, percent):
    got = check(spark.read.parquet(f"{FOLDER}/documents.parquet"), percent)
    assert sum(not r.kept for r in got) > 10


def test_awkward_rows(spark):
    check(awkward(spark), 85)
    assert minhash_groups(empty(spark)).count() == 0
    assert drop_near_duplicates(empty(spark)).columns == empty(spark).columns
    kept = drop_near_duplicates(awkward(spark)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "4", "5", "6", "7", "8", "9", "10", "None", "None", "3"])


def test_chains_and_groups_with_a_common_base(spark):
    """Chains whose ends are not similar, and two families of near copies of one template."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**6)}" for _ in range(200)]
    rows = []
    for step in range(30):  # each differs from the next in a few words
        rows.append((step, " ".join(base)))
        base = base[4:] + [f"c{draw.randrange(10**6)}" for _ in range(4)]
    stem = [f"t{i}" for i in range(300)]
    for family in range(3):
        own = stem[: 255 + family] + [f"f{family}x{i}" for i in range(45)]
        for copy in range(40):
            text = list(own)
            text[draw.randrange(300)] = f"e{family}y{copy}"
            rows.append((1000 + 100 * family + copy, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, 85)


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(3)
    errors = []
    for n in (1, 3, 40, 600):
        for share in (0.0, 0.5, 0.9, 1.0):
            common = mix(draw.integers(0, 2**63, n, dtype=np.uint64))
            a, b = common.copy(), common.copy()
            changed = int(round((1 - share) * n / (1 + share)))
            b[:changed] = mix(draw.integers(0, 2**63, changed, dtype=np.uint64))
            signature = superminhash(np.concatenate([a, b]), np.repeat([0, 1], n), 2)
            true = (n - changed) / (n + changed)
            errors.append((signature[0] == signature[1]).mean() - true)
    assert max(map(abs, errors)) < 5 * 0.5 / SIZE**0.5


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7), (300, 300), (100, 200)]
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
