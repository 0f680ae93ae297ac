"""A pipeline over the documents table: language ID, SimHash near-dedup, substring dedup, decontamination, mixing.

Each stage reads what its predecessor wrote as Parquet in the shared folder (spark.checkpoint.dir).  All but the last
return the columns of documents; the last returns the mixture to read, block by block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigsieve.llm import decontaminate, language_id, mixing, simhash_dedup, substring_dedup
from sigsieve.llm.common import cut, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go; the model is learned from this stage's own input, as op5 learns."""
    model = language_id.learn(docs.where(~language_id.held_out() & F.col("doc_id").isNotNull()))
    return language_id.keep_identified(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash class the document with the smallest doc_id stays."""
    return simhash_dedup.keep_one(docs, shingle=3, radius=2, seed=42)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a 13-word window of a smaller doc_id go; n_chars follows the text."""
    return substring_dedup.remove_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's shingles go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: which document to read in which epoch, block and place."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identified),
    ("simhash_dedup", without_near_copies),
    ("substring_dedup", without_repeats),
    ("decontaminate", decontaminated),
    ("source_mix", mixed),
]

#: SQL has no mixture inference, no XXH64 and no automata; tests/llm holds run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
