"""A corpus pipeline: five stages, each one operator on all that the one before kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns
of documents. Each is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontamination, exact_dedup, pieces, quality, simhash
from quern.llm.common import Workspace, table


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, that of the greatest id stays."""
    return exact_dedup.keep_first(spark, docs)


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of the least id stays."""
    return simhash.keep_first(spark, docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a run of benchmark words go."""
    return decontamination.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def stage_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the scores of the best two segmentations."""
    return pieces.encode(spark, docs).drop("decoded")


STAGES = [
    ("quality", stage_quality),
    ("exact_dedup", stage_exact_dedup),
    ("simhash", stage_simhash),
    ("decontamination", stage_decontamination),
    ("sentencepiece", stage_sentencepiece),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return docs
