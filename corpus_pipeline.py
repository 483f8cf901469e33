"""From raw documents to training sequences: the stages of the corpus pipeline.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result
to the session's shared folder and hands the reread table to the next stage. Each stage bounds the
session's Arrow batches, which hold whole texts, in bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termweave.llm import minhash, packing, quality, toxicity
from termweave.llm.common import bound_batches, materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxic passages give a score of 0.5 or more."""
    bound_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the rule ensemble scores under 0.7."""
    bound_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each near-duplicate group (five-word shingles, 80 percent)."""
    bound_batches(spark)
    return minhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens; one row per piece."""
    bound_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: Trained scores, graph components and tokenizer ids are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
