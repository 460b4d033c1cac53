"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.llm import words as W
from featloom.llm.components import connected_components, spanning_trees
from featloom.plans.storage import materialise, release

#: Words of a shingle.
WIDTH = 5
#: Signature values of a band, and bands.  Two texts of similarity s share no band with
#: probability (1 - s**5)**28: 7e-8 at 0.85 and 2e-5 at 0.8.
ROWS, BANDS = 5, 28
SIZE = ROWS * BANDS
_SCHEMA = "doc_id long, content string, n_shingles long, set_a long, set_b long, bands array<long>"
#: Members of a bucket that are compared in one group; larger buckets are compared part by part.
PART = 512


def superminhash(values: np.ndarray, owner: np.ndarray, count: int, size: int = SIZE) -> np.ndarray:
    """Signatures of ``count`` sets.

    Every element draws its own random permutation of the components, one step at a time
    (a Fisher-Yates shuffle seeded by the element), and offers rank + fraction to the
    component of each step; components keep the least offer.  A set is done when all its
    components hold offers below the next rank, so large sets stop after a step or two.
    Rank and fraction are 8 and 24 bits of one integer.
    """
    best = np.full((count, size), 0xFFFFFFFF, np.uint32)
    flat = best.reshape(-1)
    order = None
    for rank in range(size):
        drawn = W.mix(values ^ W.mix(np.array([rank], np.uint64)))
        pick = (rank + ((drawn >> np.uint64(32)) * np.uint64(size - rank) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        if order is None:
            chosen = pick
        else:
            index = np.arange(len(values))
            chosen = order[index, pick].astype(np.int64)
            order[index, pick] = order[:, rank]
            order[:, rank] = chosen
        offer = (drawn & np.uint64(0xFFFFFF)).astype(np.uint32) | np.uint32(rank << 24)
        np.minimum.at(flat, owner * size + chosen, offer)
        if rank + 1 == size:
            break
        open_sets = best.max(axis=1) >= np.uint32(rank + 1 << 24)
        left = open_sets[owner]
        if not left.any():
            break
        if order is None:
            order = np.broadcast_to(np.arange(size, dtype=np.uint8), (int(left.sum()), size)).copy()
            index = np.arange(len(order))
            order[index, chosen[left]] = 0
            order[:, 0] = chosen[left]
        elif not left.all():
            order = order[left]
        values, owner = values[left], owner[left]
    return best


def _band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for i in range(ROWS):
        keys += W.mix(signature[:, i::ROWS].astype(np.uint64)) * W._SLOT[i]
    return W.mix(keys + np.arange(BANDS, dtype=np.uint64) * W._SLOT[ROWS])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _SCHEMA.split(", ")]
    for batch in batches:
        for chunk in W.chunks(batch.column("text")):
            n = len(chunk)
            sets = W.shingles(W.words(chunk, lower=True), WIDTH)
            sizes = np.array([len(s) for s in sets], np.int64)
            values = np.concatenate([np.zeros(0, np.uint64), *sets])
            owner = np.repeat(np.arange(n), sizes)
            signature = superminhash(W.mix(values), owner, n)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            running = [np.concatenate([[np.uint64(0)], np.cumsum(W.mix(values * W._SLOT[k]))]) for k in (11, 12)]
            totals = [np.diff(r[bounds]) for r in running]
            empty = sizes == 0
            keys = W.signed(_band_keys(signature)).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(chunk.first, n),
                    batch.column("content").slice(chunk.first, n),
                    pa.array(sizes),
                    pa.array(W.signed(totals[0]), mask=empty),
                    pa.array(W.signed(totals[1]), mask=empty),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys)),
                ],
                names,
            )


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left = {}
        keep = np.zeros(batch.num_rows, bool)
        names = batch.column("a").to_numpy()
        for chunk in W.chunks(batch.column("text_b")):
            sets = W.shingles(W.words(chunk, lower=True), WIDTH)
            rows = range(chunk.first, chunk.first + len(chunk))
            # pairs come sorted by a, so few of its sets are needed at a time
            wanted = [r for r in rows if names[r] not in left]
            left = {name: left[name] for name in {*names[rows.start : rows.stop].tolist()} & left.keys()}
            picked = {int(names[r]): r for r in wanted if names[r] not in left}
            if picked:
                texts = batch.column("text_a").take(pa.array(list(picked.values())))
                for part in W.chunks(texts):
                    own = W.shingles(W.words(part, lower=True), WIDTH)
                    left.update(zip(list(picked)[part.first : part.first + len(part)], own))
            for r, b in zip(rows, sets):
                a = left[int(names[r])]
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep[r] = shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _compare_part(table: pa.Table, percent: int) -> pa.Table:
    """Links between different components among the members of a part, on their full sets.

    Intersections of all pairs are one matrix product over the shingles that two members have;
    only spanning trees of the links are returned.
    """
    sets: list[np.ndarray] = []
    for chunk in W.chunks(table.column("text")):
        sets += W.shingles(W.words(chunk, lower=True), WIDTH)
    n = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    rank = np.full(len(counts), -1)
    rank[shared] = np.arange(len(shared))
    column = rank[column]
    shared_mass = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, len(shared), 4096):
        own = (column >= low) & (column < low + 4096)
        block = np.zeros((len(sets), 4096), np.float32)
        block[owner[own], column[own] - low] = 1
        shared_mass += block @ block.T
    component = table.column("component").to_numpy()
    linked = (shared_mass > 0) & (100 * shared_mass >= percent * (n[:, None] + n[None, :] - shared_mass))
    linked &= component[:, None] != component[None, :]
    edges = np.array(spanning_trees(linked), np.int64).reshape(-1, 2)
    node = table.column("node").to_numpy()
    return pa.table({"a": node[edges[:, 0]], "b": node[edges[:, 1]]})


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    names = classes.select("node", "content")
    rows = pairs.join(names.withColumnsRenamed({"node": "b", "content": "content of b"}), "b")
    rows = rows.join(texts.withColumnsRenamed({"content": "content of b", "text": "text_b"}), "content of b")
    rows = rows.select("a", "b", "text_b").join(names.withColumnsRenamed({"node": "a", "content": "content of a"}), "a")
    rows = rows.join(texts.withColumnsRenamed({"content": "content of a", "text": "text_a"}), "content of a")
    rows = rows.select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(lambda batches: _confirm(batches, percent), "a long, b long")


def _class_components(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Components of linked classes.

    1. Classes that share a band key form a bucket.  Every member is compared with the first
       member of its buckets, so a bucket of copies costs one comparison per member.
    2. Buckets whose members all hang together by now are done: no further link could change
       a component.  In the others all members are compared inside tasks, ``PART`` with
       ``PART`` at a time, and only links that join components leave the task.
    """
    members = classes.select("node", "n_shingles", F.explode("bands").alias("band"))
    first = F.min(F.struct("node", "n_shingles")).alias("first")
    buckets = members.groupBy("band").agg(first, F.max("node").alias("last"))
    buckets = buckets.where(F.col("first.node") < F.col("last"))
    shared = members.join(buckets, "band").select("band", "node", "n_shingles", "first")
    shared = materialise(shared, "buckets")

    spokes = shared.where(F.col("node") != F.col("first.node"))
    spokes = spokes.where(_sizes_fit(F.col("n_shingles"), F.col("first.n_shingles"), percent))
    spokes = materialise(spokes.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")

    needed = shared.select("node").distinct().join(classes, "node").select("content").distinct()
    held = docs.select("content", "text").join(needed, "content", "left_semi")
    texts = materialise(held.groupBy("content").agg(F.any_value("text").alias("text")), "texts")

    links = materialise(_verified(spokes, classes, texts, percent), "links")
    components = connected_components(links)

    placed = shared.select("band", "node", "n_shingles").join(components, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("band").agg(
        F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    mixed = sizes.where("low < high").select("band", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    mixed = placed.join(mixed, "band").withColumn("part", F.expr("CAST(pmod(xxhash64(node), parts) AS INT)"))
    mixed = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    mixed = mixed.select(
        "band",
        F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"),
        "node",
        "component",
    )
    mixed = mixed.join(classes.select("node", "content"), "node").join(texts, "content").drop("content")
    more = mixed.groupBy("band", "low", "high").applyInArrow(lambda t: _compare_part(t, percent), "a long, b long")
    more = materialise(more.distinct(), "links")
    result = connected_components(more, known=components)
    release(shared, spokes, texts, links, components, more)
    return result


def minhash_groups(
    docs: DataFrame,
    *,
    percent: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Group documents whose sets of distinct five-word shingles have a Jaccard similarity of
    at least ``percent`` / 100; A-Z count as a-z.

    Returns one row per document: ``doc_id``, ``content`` (the MD5 of the text),
    ``n_shingles``, ``component_id`` (the smallest ``doc_id`` that can be reached by links,
    its own included) and ``kept``.

    Documents with one and the same set are one class, found by a pre-aggregated minimum, so
    copies are never paired.  A text of fewer than five words is one shingle; null, empty and
    blank texts link with nothing and are kept.  Null ids take the smallest id that they reach
    and are kept if they reach none.  Repeated rows share a class.  An empty table gives an
    empty result; other columns are not read.
    """
    source = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("content"),
        F.col(f"`{text}`").alias("text"),
    )
    rows = materialise(source.mapInArrow(_sketch, _SCHEMA), "sketches")
    classes = rows.where("n_shingles > 0").groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("least_id"),
        *(F.any_value(c).alias(c) for c in ("content", "n_shingles", "bands")),
    )
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    components = _class_components(source, classes, percent)
    named = classes.select("node", "set_a", "set_b", "least_id").join(components, "node", "left")
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component", "left").select(
        "set_a",
        "set_b",
        F.when(F.col("component").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    joined = rows.select("doc_id", "content", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "content", "n_shingles", component.alias("component_id")).withColumn(
        "kept",
        F.col("doc_id").eqNullSafe(F.col("component_id")),
    )


def drop_near_duplicates(docs: DataFrame, *, percent: int = 80) -> DataFrame:
    """One document of each group, with all columns of ``docs``; of rows that repeat both id
    and text, one stays."""
    kept = minhash_groups(docs, percent=percent).where("kept")
    kept = kept.select(F.col("doc_id").alias("id kept"), F.col("content").alias("content kept")).distinct()
    rows = docs.withColumn("content of row", F.md5(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("id kept")) & (F.col("content of row") == F.col("content kept"))
    found = rows.join(kept, same, "left_semi")
    names = [f"`{c}`" for c in docs.columns]
    first = found.groupBy(F.col("doc_id").alias("id kept"), "content of row").agg(F.any_value(F.struct(*names)).alias("row kept"))
    return first.select(*(F.col(f"`row kept`.{c}") for c in names))
