"""A training-data pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return
the columns of documents. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again; what a
stage made on its way, and the rows of the stage before it, are deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from earshot.llm import decontam, langid, mixing, neardup, sharding
from earshot.llm.common import conclude, table

SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without letters and gibberish go."""
    return langid.accept(docs, langid.train(docs.where(~langid.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the least id."""
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mix(docs, numbered=False)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and place in it."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: Filters learned from a sample and sketches of MinHash values are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def through(stages: list) -> DataFrame:
        if not stages:
            return table(spark, sf_dir, "documents")
        name, stage = stages[-1]
        return conclude(spark, f"stage-{name}", lambda: stage(spark, through(stages[:-1]), sf_dir))

    return through(STAGES)
