from __future__ import annotations

import itertools

import numpy as np
import pytest
from fixtures import FOLDER

from featloom.llm.lattice import Lattice, cells, embedding_groups, nearest_e8

SCHEMA = "vec_id long, embedding array<double>, label int, component_id string, n_links int"


def usable(r):
    e = r.embedding
    return bool(e) and r.label is not None and None not in e and np.isfinite(e).all() and np.any(e)


def brute(rows, least=0.98):
    links = {i: set() for i in range(len(rows))}
    some = [i for i, r in enumerate(rows) if usable(r)]
    units = {i: np.array(rows[i].embedding, float) / np.linalg.norm(rows[i].embedding) for i in some}
    for i, j in itertools.combinations(some, 2):
        if rows[i].label == rows[j].label and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
            links[i].add(j)
            links[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, stack = {i}, [i]
        while stack:
            fresh = links[stack.pop()] - seen
            seen |= fresh
            stack += fresh
        ids = [rows[k].vec_id for k in seen if rows[k].vec_id is not None]
        component = min(ids, default=None)
        out.append((str(r.vec_id), len(links[i]), str(component), r.vec_id == component))
    return sorted(out)


def found(frame, **options):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_groups(frame, **options).collect())


def test_whole_table(spark):
    frame = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    assert found(frame) == brute(frame.collect())


def test_groups_chains_and_copies(spark, monkeypatch):
    """Dense groups over several parts, a chain, copies, and pairs on both sides of the bound."""
    monkeypatch.setattr("featloom.llm.lattice.PART", 40)
    draw = np.random.default_rng(4)
    vectors = []
    for _ in range(3):
        centre = draw.normal(size=32)
        vectors += [centre + 0.1 * draw.normal(size=32) for _ in range(110)]
    step = draw.normal(size=32)
    for _ in range(40):
        vectors.append(step)
        step = step + 0.18 * draw.normal(size=32)
    vectors += [7.5 * vectors[5], vectors[5], vectors[5], -vectors[5]]
    rows = [(int(i), [float(x) for x in v], int(i % 2), "x", 1) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, SCHEMA)
    wanted, got = brute(frame.collect()), found(frame)
    total = sum(n for _, n, _, _ in wanted)
    assert total > 3000
    assert sum(min(a[1], b[1]) for a, b in zip(wanted, got)) >= 0.999 * total
    assert all(b[1] <= a[1] for a, b in zip(wanted, got)), "no link below the bound, none twice"


def test_awkward_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 1), (2, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [], 1), (7, [0.0] * 3, 1),
        (8, [1.0, None, 3.0], 1), (9, [1.0, float("nan"), 3.0], 1), (10, [float("inf"), 0.0, 0.0], 1), (11, [1.0, 2.0], 1),
        (None, [2.0, 4.0, 6.0], 1), (None, [-1.0, 0.0, 0.0], 1), (12, [-0.0, 0.0, 1.0], 1), (13, [0.0, 0.0, 1.0], 1),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert found(frame) == brute(frame.collect())
    assert embedding_groups(frame.limit(0)).count() == 0


def test_decoder_finds_the_nearest_point():
    x = np.random.default_rng(0).normal(size=(300, 8)) * 2
    near = nearest_e8(x)
    grid = np.array(list(itertools.product((-1, 0, 1), repeat=8)))
    for row, point in zip(x[:40], near[:40]):
        whole = np.rint(row) + grid
        half = np.floor(row) + 0.5 + grid
        every = np.concatenate([whole, half])
        every = every[every.sum(axis=1) % 2 == 0]
        assert np.isclose(((row - every) ** 2).sum(axis=1).min(), ((row - point) ** 2).sum())


@pytest.mark.parametrize("cosine", [0.98, 0.99])
def test_recall_of_the_hashing(cosine):
    draw = np.random.default_rng(0)
    a, b = draw.normal(size=(2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x, y = cells(a, Lattice()), cells(cosine * a + (1 - cosine**2) ** 0.5 * b, Lattice())
    met = (x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)
    assert met.any(axis=1).mean() > 0.999
