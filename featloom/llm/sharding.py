"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featloom.plans.storage import materialise

#: Runs that the slots of one shard are numbered in (three hex digits); the lengths of the
#: runs are all that is broadcast.
RUNS = 4096
#: Equal rows that one task writes out at most.
BLOCK = 65536


def uniform(key: Column, salt: str) -> Column:
    """A number of [0, 1) from the first 52 bits of the MD5 of key and salt."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard that wins for a key: the smallest ``-ln(u) / weight``, ties to the lower number.

    Key and shard alone decide a score.  A new shard therefore takes records only into
    itself, a removed one gives away only its own, and a shard holds records in proportion
    to its weight.  A shard of weight 0 takes none.
    """
    if not weights or min(weights) < 0 or not any(weights):
        raise ValueError("weights must not be negative, and one must be above 0")
    scores = [
        F.struct((-F.log(uniform(key, f"shard{i}")) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    return F.array_min(F.array(*scores)).getField("shard")


def shard_records(
    docs: DataFrame,
    weights: Sequence[float],
    *,
    key: str = "doc_id",
    text: str = "text",
    grown: Sequence[float] | None = None,
) -> DataFrame:
    """Put every record into a shard and number the records of each shard from 0 without gaps.

    Returns one row per record: the key, ``size`` (UTF-8 bytes of the text plus 1; null text
    has none), ``text_crc32``, ``shard``, ``slot``, and ``grown_shard``, the shard under the
    weights ``grown`` (null if they are not given).

    Only keys, sizes and checksums are written and shuffled, never texts.  Slots are numbered
    in ``RUNS`` runs per shard, in the order of key, size and checksum inside a run, and the
    bounded table of run lengths places the runs.  A key that a third of all rows share is
    spread over the runs by size and checksum; rows equal in all three are counted before they
    are shuffled and written out in blocks.  Null keys are one key, repeated keys share a shard
    and have slots of their own, an empty table gives an empty result; other columns are not read.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    name = F.col(f"`{key}`")
    size = (F.octet_length(body) + 1).cast("long")
    rows = docs.select(
        name.alias("key"),
        size.alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
    )
    groups = rows.groupBy("key", "size", "text_crc32").agg(F.count("*").alias("copies"))
    label = F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("null")), "size", "text_crc32")
    groups = groups.select(
        "*",
        rendezvous(F.col("key"), weights).cast("int").alias("shard"),
        (rendezvous(F.col("key"), grown).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.substring(F.md5(label), 1, 3).alias("run"),
    )
    groups = materialise(groups, "shards")  # read twice below
    lengths = groups.groupBy("shard", "run").agg(F.sum("copies").alias("length"))
    runs = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = lengths.select("shard", "run", F.coalesce(F.sum("length").over(runs), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "run").orderBy("key", "size", "text_crc32")
    earlier = F.coalesce(F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = groups.withColumn("place", earlier).join(F.broadcast(before), ["shard", "run"])
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(BLOCK))))
    spread = blocks.hint("rebalance")
    last = F.least(F.col("block") + BLOCK, F.col("copies")) - 1
    return spread.select("*", F.explode(F.sequence("block", last)).alias("copy")).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        "shard",
        (F.col("before") + F.col("place") + F.col("copy")).alias("slot"),
        "grown_shard",
    )
