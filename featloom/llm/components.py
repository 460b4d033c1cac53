"""Connected components of a table of links, by alternating star operations.

Union-find over rows: every node is hung onto the smallest node it knows, first through its
larger neighbours and then through its smaller ones, until nothing changes.  Each round is a
pre-aggregated minimum and a join; links never reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.plans.storage import materialise, release


def _stars(links: DataFrame, *, large: bool) -> DataFrame:
    """Links (a > b) after one star operation."""
    if large:
        both = links.select("a", "b").union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low"))
        low = F.least("a", "low")
        moved = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), low.alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("low"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        moved = moved.union(least.select("a", F.col("low").alias("b")))
    return moved.where("a > b").distinct()


def connected_components(links: DataFrame, *, known: DataFrame | None = None) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of ``links`` (a, b).

    Links to oneself and repeated links do not matter; ``known`` adds the components of an
    earlier call as links.  The result is stored.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if known is not None:
        pairs = pairs.union(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
    now = materialise(pairs.where("a > b").distinct(), "links")
    state = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state or found[0] == 0:
            break
        state = found
        spread = materialise(_stars(now, large=True), "links")
        release(now)
        now = materialise(_stars(spread, large=False), "links")
        release(spread)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    result = materialise(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), "components")
    release(now)
    return result


def spanning_trees(linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning trees of a symmetric matrix of links."""
    edges, fresh = [], np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not fresh[root]:
            continue
        fresh[root] = False
        stack = [root]
        while stack:
            at = stack.pop()
            found = np.flatnonzero(linked[at] & fresh)
            fresh[found] = False
            edges += [(at, int(i)) for i in found]
            stack += found.tolist()
    return edges
