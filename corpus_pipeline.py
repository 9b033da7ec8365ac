"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept:
documents of low quality go, one document of every near-duplicate group stays,
documents that hold benchmark passages go, and the rest is packed. Results are written
as Parquet between stages. SQL can't express the classifier or the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import decontaminate, jaccard_join, packing, quality_rules
from frameloom.llm.common import materialize, table
from frameloom.llm.tokens import public_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rule ensemble, fitted on the labels of ``docs``, gives 0.3 or more."""
    return quality_rules.keep_quality(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return jaccard_join.one_per_component(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a ten-word window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents left, with its sequence and offset."""
    return packing.pack_documents(docs, public_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
