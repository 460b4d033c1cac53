"""Embedding near-dedup: E8 lattice hashing, neighbouring cells probed, cosine verified."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.llm import words as W
from featloom.llm.components import connected_components, spanning_trees
from featloom.plans.storage import materialise, release


@dataclass(frozen=True)
class Lattice:
    """Parameters of the hashing.

    Every table projects a unit vector to eight dimensions by its own random matrix, divides
    by ``scale``, shifts at random and takes the nearest point of E8 as the cell.  A vector
    is filed under its cell and also looks into the ``probes`` nearest neighbouring cells.
    """

    tables: int = 6
    probes: int = 4
    scale: float = 1.1
    seed: int = 11


#: Members of a bucket that are compared in one group; larger buckets are compared part by part.
PART = 1024


@functools.cache
def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: the neighbouring cells of a cell."""
    pairs = []
    for i in range(8):
        for j in range(i):
            for a in (-1.0, 1.0):
                for b in (-1.0, 1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    pairs.append(v)
    signs = np.array([[1 - 2 * (n >> k & 1) for k in range(8)] for n in range(256)]) / 2
    return np.concatenate([pairs, signs[signs.prod(axis=1) > 0]])


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: round, and if the sum is odd, round the worst
    coordinate the other way."""
    near = np.rint(x)
    rest = x - near
    worst = np.abs(rest).argmax(axis=1)
    rows = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    near[rows, worst[rows]] += np.where(rest[rows, worst[rows]] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the union of D8 and D8 shifted by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@functools.lru_cache(8)
def _projections(size: int, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng([lattice.seed, size])
    return draw.normal(size=(lattice.tables, size, 8)) / lattice.scale, draw.random((lattice.tables, 8))


def cells(units: np.ndarray, lattice: Lattice) -> np.ndarray:
    """Cell keys of unit vectors, [vector, table, own cell and probed cells]."""
    matrices, shifts = _projections(units.shape[1], lattice)
    out = np.empty((len(units), lattice.tables, 1 + lattice.probes), np.uint64)
    neighbours = _minimal_vectors()
    for t in range(lattice.tables):
        x = units @ matrices[t] + shifts[t]
        home = nearest_e8(x)
        closest = np.argsort(-((x - home) @ neighbours.T), axis=1, kind="stable")[:, : lattice.probes]
        points = np.concatenate([home[:, None, :], home[:, None, :] + neighbours[closest]], axis=1)
        hashed = np.full(points.shape[:2], (t + 1) * 1_000_003 + units.shape[1], np.uint64)
        for k in range(8):
            hashed += (2 * points[:, :, k]).astype(np.int64).view(np.uint64) * W._SLOT[k]
        out[:, t] = W.mix(hashed)
    return out


def _units(column: pa.Array) -> np.ndarray:
    rows = np.stack([np.frombuffer(x.as_py(), np.float64) for x in column])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes with their hash; null where a vector cannot be compared."""
    for batch in batches:
        values, hashes = [], []
        for vector, label in zip(batch.column("vector"), batch.column("label")):
            kept = None
            if vector.is_valid and label.is_valid and len(vector) and vector.values.null_count == 0:
                row = pc.cast(vector.values, pa.float64()).to_numpy() + 0.0  # no negative zeros
                if np.isfinite(row).all() and 0 < np.linalg.norm(row) < np.inf:
                    kept = row.tobytes()
            values.append(kept)
            hashes.append(kept and hashlib.blake2b(kept, digest_size=16).digest())
        columns = [batch.column("vec_id"), batch.column("label"), pa.array(values, pa.binary()), pa.array(hashes, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vector", "hash"])


def _file(batches: Iterator[pa.RecordBatch], lattice: Lattice) -> Iterator[pa.RecordBatch]:
    """A row for each cell that a vector is filed under or looks into."""
    width = lattice.tables * (1 + lattice.probes)
    table = np.repeat(np.arange(lattice.tables), 1 + lattice.probes)
    filed = np.tile(np.arange(1 + lattice.probes) == 0, lattice.tables)
    for batch in batches:
        sizes = pc.binary_length(batch.column("vector")).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            keys = cells(_units(batch.column("vector").take(pa.array(rows))), lattice)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node").take(pa.array(np.repeat(rows, width))),
                    batch.column("label").take(pa.array(np.repeat(rows, width))),
                    pa.array(W.signed(keys.reshape(-1))),
                    pa.array(np.tile(table, len(rows)).astype(np.int32)),
                    pa.array(np.tile(filed, len(rows))),
                ],
                ["node", "label", "cell", "table", "filed"],
            )


def _compare(table: pa.Table, lattice: Lattice, least: float) -> pa.Table:
    """Links found in one part of a bucket, each counted in one bucket only.

    A pair may meet in several tables and in two cells of one table.  The first table counts,
    and in it the cell of the member with the smaller node if the other looks into it.
    """
    node = table.column("node").to_numpy()
    filed = table.column("filed").to_numpy(zero_copy_only=False)
    part, copies = table.column("part").to_numpy(), table.column("copies").to_numpy()
    units = _units(table.column("vector").combine_chunks())
    cell, at = np.uint64(table.column("cell")[0].as_py() & (2**64 - 1)), table.column("table")[0].as_py()
    near = units @ units.T >= least
    near &= filed[:, None] | filed[None, :]
    if table.column("low")[0].as_py() != table.column("high")[0].as_py():
        near &= part[:, None] != part[None, :]
    near &= node[:, None] < node[None, :]
    x, y = np.nonzero(near)
    if not len(x):
        return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
    used = np.unique(np.concatenate([x, y]))
    keys = cells(units[used], lattice)
    rank = np.zeros(len(node), np.int64)
    rank[used] = np.arange(len(used))
    mine = np.zeros(len(x), bool)
    for low in range(0, len(x), 50_000):
        a, b = keys[rank[x[low : low + 50_000]]], keys[rank[y[low : low + 50_000]]]
        into_a = (a[:, :, :1] == b).any(axis=2)
        into_b = (b[:, :, :1] == a).any(axis=2)
        first = (into_a | into_b).argmax(axis=1)
        pick = np.arange(len(a))
        own = np.where(into_a[pick, first], a[pick, first, 0], b[pick, first, 0])
        mine[low : low + 50_000] = (first == at) & (own == cell)
    x, y = x[mine], y[mine]
    links = np.bincount(x, copies[y], len(node)) + np.bincount(y, copies[x], len(node))
    linked = np.zeros(near.shape, bool)
    linked[x, y] = linked[y, x] = True
    edges = np.array(spanning_trees(linked), np.int64).reshape(-1, 2)
    some = np.flatnonzero(links)
    return pa.table(
        {
            "node": np.concatenate([node[some], node[edges[:, 0]]]),
            "links": np.concatenate([links[some].astype(np.int64), np.zeros(len(edges), np.int64)]),
            "other": pa.array([None] * len(some) + node[edges[:, 1]].tolist(), pa.int64()),
        },
    )


def embedding_groups(
    vectors: DataFrame,
    *,
    least: float = 0.98,
    lattice: Lattice = Lattice(),
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Link vectors of one label whose cosine (in double precision) is at least ``least``.

    Returns one row per vector: ``vec_id``, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest ``vec_id`` that links reach) and ``kept``.

    Equal vectors are one class with a count, found by a pre-aggregated minimum.  Classes are
    compared inside tasks, bucket by bucket and large buckets part by part; counts and
    spanning trees leave a task, never all pairs.  Every link is verified; a pair is missed if
    no table brings it together (see the README for measured recall).  A vector that is null,
    empty or zero, that holds null or non-finite components or has a null label links with
    nothing; vectors of different lengths do not link.  Null ids take the smallest id that they
    reach; repeated rows are copies; an empty table gives an empty result; other columns are
    not read.
    """
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{label}`").cast("string").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    )
    rows = rows.mapInArrow(_read, "vec_id long, label string, vector binary, hash binary")
    rows = materialise(rows, "vectors")
    classes = rows.where("hash IS NOT NULL").groupBy("label", "hash").agg(
        F.min("vec_id").alias("least_id"),
        F.count("*").alias("copies"),
        F.any_value("vector").alias("vector"),
    )
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    filed = classes.select("node", "label", "vector").mapInArrow(
        lambda batches: _file(batches, lattice),
        "node long, label string, cell long, table int, filed boolean",
    )
    filed = materialise(filed, "cells")
    sizes = filed.groupBy("label", "table", "cell").agg(F.count("*").alias("size"), F.max("filed").alias("any_filed"))
    sizes = sizes.where("size > 1 AND any_filed")
    sizes = sizes.select("label", "table", "cell", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    members = filed.join(sizes, ["label", "table", "cell"])
    members = members.withColumn("part", F.expr("CAST(pmod(xxhash64(node), parts) AS INT)"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select(
        "label", "table", "cell", "node", "filed", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    )
    members = members.join(classes.select("node", "vector", "copies"), "node")
    found = members.groupBy("label", "table", "cell", "low", "high").applyInArrow(
        lambda t: _compare(t, lattice, least),
        "node long, links long, other long",
    )
    found = materialise(found, "links")
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.drop("vector").join(counts, "node", "left").join(components, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(ids, "component").select("label", "hash", "copies", "links", "component_id")
    release(filed)
    joined = rows.select("vec_id", "label", "hash").join(named, ["label", "hash"], "left")
    compared = F.col("hash").isNotNull()
    links = F.when(compared, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0))
    return joined.select(
        "vec_id",
        links.cast("long").alias("n_links"),
        F.when(compared, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
