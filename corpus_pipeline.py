"""A corpus from raw documents: STAGES in order, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featloom.llm.linededup import dedup_lines
from featloom.llm.minhash import drop_near_duplicates
from featloom.llm.mixing import mix_sources
from featloom.llm.packing import pack_documents
from featloom.llm.quality import clean_documents
from featloom.llm.queries import vocabulary
from featloom.plans.storage import materialise, release

#: Weights dealt to the sources in code point order, and the size of the mix against its input.
WEIGHTS, BUDGET = [3.0, 1.0, 2.0], 1.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: boilerplate lines go, and documents that fail or that they deplete."""
    return clean_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: equal and nearly equal lines stay where they come first."""
    return dedup_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    return drop_near_duplicates(docs, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents are repeated to the target weights of their sources."""
    return mix_sources(docs, WEIGHTS, budget=BUDGET, max_epochs=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: token sequences of neighbouring documents, one row per piece."""
    return pack_documents(docs, vocabulary(), window=1024, end_id=0)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near_duplicates),
    ("mixing sources", mixing),
    ("packing", packing),
]

#: Near duplicates and retrieval packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
