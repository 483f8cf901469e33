"""The thin contract queries over the operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_topk, licenses, lm_scoring, minhash, packing, pieces, quality, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: trained where crc32(doc_id) mod 5 is not 0, predicted at 0.5."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    held_out = toxicity.held_out_by(F.col("doc_id"), 5, 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "best", "passages")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: trained where crc32(doc_id) mod 4 is not 2, predicted at 0.7."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.train(docs, labels))
    held_out = toxicity.held_out_by(F.col("doc_id"), 4, 2).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives the text back."""
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op3_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: ids divisible by 20 query all rows for their 20 nearest."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: ids divisible by 50 query all rows for their 5 best integer products."""
    return exact_topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: 4-word shingles, 80 percent."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: sequences of 1024 tokens, end id 0."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document."""
    return lm_scoring.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: base phrases of three licences, labels of the positional index beside them."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of each."""
    return token_counts.section_tokens(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_approximate_nearest_neighbours": op3_approximate_nearest_neighbours,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_packing": op6_packing,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_license_scans": op9_license_scans,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op9_license_scans": licenses.oracle(),
    "op7_exact_top_k": """
        WITH v AS (
          SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
