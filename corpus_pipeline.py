"""A training corpus from raw documents, in five stages.

Each stage is written as Parquet and read back as the next one's documents. All but the last
keep the columns of documents, whatever their names. Null and empty texts go in the first
stage, as they have under 50 words; null ids and languages pass like any other value, except
that no label speaks for a null id and that near_dedup keeps rows without an id, as nothing
tells them apart. Rows that repeat an id and a text become one in near_dedup. An empty table
gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import kneser_ney, mixing, quality_rules, simhash
from keyloom.llm.common import discard, materialize
from keyloom.llm.queries import packed, table
from keyloom.session import ship_package

#: Tokenizers and trained models have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep, cutoffs proven on the labels of ``sf_dir``."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose perplexity under a model of trusted texts, by the labels of ``sf_dir``, is not high."""
    return kneser_ney.kept_documents(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest id."""
    ship_package(spark)
    return simhash.one_per_component(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as a mix of the sources takes them, in its order: some repeat, some go."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 tokens."""
    ship_package(spark)
    return packed(docs)


STAGES = [("quality_rules", rules_stage), ("quality_classifier", classifier_stage), ("near_dedup", dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
