"""A training corpus from raw documents: low quality out, copies out, near copies out, sources mixed, sequences packed.

Every stage takes what the one before kept, as a table, and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltascape.llm.common import materialise, table
from deltascape.llm.exact_dedup import drop_duplicates
from deltascape.llm.near_dedup import drop_near_duplicates
from deltascape.llm.packing import pack
from deltascape.llm.quality import accepted
from deltascape.llm.source_mix import mixed_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.8."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: sources to their target words, documents as often as taken."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 1024 tokens."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("source mix", mix),
    ("packing", packing),
]
#: Learned scores and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
