"""A corpus pipeline of five stages, each one operator of `leadspark.llm`.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, in the
columns of `documents` (the last stage adds the columns of the draw). `run` writes each
result and reads it again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadspark.llm import mixing, quality, rlz, simhash, tiling
from leadspark.llm.common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id.

    Near copies have close prints of five-word shingles, or shingle sets of similarity 0.8.
    """
    return simhash.keep_one(docs)


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut out."""
    return rlz.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights and the documents shuffled."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicates_stage),
    ("substrings", substrings_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL cannot express the classifier, so neither the stages that work on what it keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(docs)
    return docs
