"""Mixing sources to target weights: every document floor(rate) times, plus one drawn copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.llm.sharding import uniform
from featloom.plans.ordering import running_total
from featloom.plans.storage import materialise

#: Rates are broadcast up to this many sources (some 10 MB) and joined by a shuffle beyond.
BROADCAST_SOURCES = 100_000
#: What separates words.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, source: str, weights: list[float]) -> DataFrame:
    """Weights dealt to distinct sources in code point order, null last, over and over."""
    named = sources.select(F.col(f"`{source}`").alias("source"), F.lit(1).alias("one"))
    ranked = running_total(named, [F.col("source").asc_nulls_last()], "one", "rank")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    return ranked.select("source", F.element_at(cycle, (F.col("rank") % len(weights)).cast("int") + 1).alias("weight"))


def mixing_rates(
    sizes: DataFrame,
    weights: DataFrame,
    *,
    budget: float = 1.5,
    max_epochs: float = 2.0,
) -> DataFrame:
    """Target and rate of every source.

    ``sizes`` has ``source`` and ``source_size``, ``weights`` has ``source`` and ``weight``
    (missing: 0).  The budget is a multiple of all sizes.  Targets are proportional to the
    weights; none exceeds ``max_epochs`` times its source, and what is cut off goes to the
    others by weight until none is above.  The level at which this ends is found by sums over
    all sources; a source without words has target and rate 0.
    """
    same = F.col("s.source").eqNullSafe(F.col("w.source"))
    table = sizes.alias("s").join(weights.alias("w"), same, "left")
    table = table.select("s.source", F.col("s.source_size").cast("long"), F.coalesce("w.weight", F.lit(0.0)).alias("weight"))
    table = materialise(table, "sources")
    cap = F.lit(max_epochs) * F.col("source_size")
    total = table.agg(F.sum("source_size").cast("double")).first()[0] or 0.0
    level, capped = 0.0, -1
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        count, taken, weight = table.agg(
            F.count(F.when(full, 1)),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if count == capped or weight == 0:
            break
        capped, level = count, (budget * total - taken) / weight
    if weight == 0:
        level = float("inf")
    share = F.when(F.col("weight") > 0, F.least(cap, F.lit(level) * F.col("weight"))).otherwise(F.lit(0.0))
    return table.select("source", "source_size", share.alias("target")).withColumn(
        "rate",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)),
    )


def _draw(doc_id: str, text: str, seed: int) -> Column:
    """The draw of a document, from its key, its text and the seed alone."""
    key = F.concat_ws(":", F.col(f"`{doc_id}`").cast("string"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return uniform(key, f"mix{seed}")


def _copies(rates: DataFrame, rows: DataFrame, source: str) -> DataFrame:
    """Rows with their source's figures and ``copies``; ``draw of row`` decides the last one."""
    small = rates.count() <= BROADCAST_SOURCES
    figures = rates.select(*(F.col(c).alias(f"{c} of source") for c in rates.columns))
    figures = F.broadcast(figures) if small else figures
    joined = rows.join(figures, F.col(f"`{source}`").eqNullSafe(F.col("`source of source`")), "left")
    rate = F.col("`rate of source`")
    return joined.withColumn(
        "copies of row",
        F.floor(rate).cast("int") + (F.col("`draw of row`") < rate - F.floor(rate)).cast("int"),
    )


def mixing_plan(
    docs: DataFrame,
    weights: list[float],
    *,
    budget: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """How often each document is taken: ``doc_id``, ``source``, ``size`` (words),
    ``source_size``, ``target`` and ``rate`` of its source, ``copies`` and ``taken`` (words).

    Every document of a source with rate *r* is taken floor(*r*) times and once more with
    probability *r* - floor(*r*), drawn from the hash of key, text and seed, so reruns agree
    and documents that share a key draw alone.  Null is a source of its own; null and empty
    texts have no words and cost nothing; equal rows share their draw; an empty table gives
    an empty result; other columns are not read.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        _draw(doc_id, text, seed).alias("draw of row"),
    )
    rows = materialise(rows, "sizes")  # texts are read once
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = mixing_rates(sizes, cycled_weights(sizes, "source", weights), budget=budget, max_epochs=max_epochs)
    return _copies(rates, rows, "source").select(
        "doc_id",
        "source",
        "size",
        F.col("`source_size of source`").alias("source_size"),
        F.col("`target of source`").alias("target"),
        F.col("`rate of source`").alias("rate"),
        F.col("`copies of row`").alias("copies"),
        (F.col("size") * F.col("`copies of row`")).alias("taken"),
    )


def mix_sources(
    docs: DataFrame,
    weights: list[float],
    *,
    budget: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mixing_plan`` says.

    Texts are not shuffled: a row is repeated where it is read.
    """
    sizes = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(
        F.sum(word_count(F.col(f"`{text}`"))).alias("source_size"),
    )
    sizes = materialise(sizes, "source-sizes")
    rates = mixing_rates(sizes, cycled_weights(sizes, "source", weights), budget=budget, max_epochs=max_epochs)
    rows = _copies(rates, docs.withColumn("draw of row", _draw(doc_id, text, seed)), source)
    return rows.withColumn("copy of row", F.explode(F.array_repeat(F.lit(0), F.col("copies of row")))).select(
        *(F.col(f"`{c}`") for c in docs.columns),
    )
