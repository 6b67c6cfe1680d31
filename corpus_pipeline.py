"""Training-data pipeline: quality rules, exact dedup, SimHash near-dedup, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetdeck.llm import common as C
from assetdeck.llm import exact_dedup, packing, pii, quality_rules, simhash


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines above the limits.

    Null and empty texts have no words and go; rows that repeat one stay or go together; no rows give none.
    """
    return quality_rules.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per distinct text, the one with the largest id; a null id only where there is no other."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per component of near-duplicates, the one with the smallest id; a null id only where there is no other."""
    return simhash.deduplicate(docs, shingle=3, radius=2)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that reveal it replaced by their kind; texts without any stay as they are."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences; an empty or null text is one piece of one token."""
    return packing.pack(packing.pieces(docs))


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("simhash_near_dedup", near), ("pii", private), ("packing", packed)]
#: Fingerprints, components and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = C.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = C.written(docs, f"stage-{name}")
    return docs
