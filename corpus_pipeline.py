"""Corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

quality classifier, SimHash near-dedup, benchmark decontamination, personal data, mix to target weights.
Every stage keeps all rows that it has no reason to drop; all but the last return the columns of documents.
The last returns the documents that the mix takes, with their number of repetitions in ``times``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topolark.llm import decontaminate, mixing, neardup, pii, quality
from topolark.llm.common import Scratch, scratch_scope, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents graded as low quality go."""
    return quality.select_quality(docs, quality.grades_of(table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays; 5-word shingles with a Jaccard similarity of 0.8 or more link documents."""
    return neardup.drop_similar(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    return pii.redact(docs, length="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a mix of all sources to weights 5, 2, 1, ... takes."""
    return mixing.mix(docs).where("times > 0")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Learnt models, XXH64 and edit distances are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What they wrote on the way is deleted, but for what the last one reads."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch_scope(spark):
            after = scratch.write(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
