"""Readers and writers of the engine's file formats."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def bulk_json(spark: SparkSession, path: str) -> DataFrame:
    """input_index, payload of files that hold one JSON array each."""
    from ..operators.ingest import bulk

    return bulk(spark.read.text(path, wholetext=True), "value")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Shard manifests, one JSON object per file."""
    return spark.read.json(path, multiLine=True)


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query_text, doc_id, grade of TSV files: # comments, a header and short rows are skipped, the later line of a key wins (files by name)."""
    line = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    rows = spark.read.text(path).select("value", line.alias("line")).where(~F.col("value").startswith("#"))
    cols = rows.withColumn("c", F.split("value", "\t")).where(F.size("c") >= 4)
    out = cols.select("line", *(F.trim(F.get("c", F.lit(i))).alias(n) for i, n in enumerate(("query_id", "query_text", "doc_id"))), F.trim(F.get("c", F.lit(3))).try_cast("int").alias("grade"))
    nth = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("line")))
    return out.where("grade is not null").withColumn("nth", nth).where("nth = 1").drop("nth", "line")


def embeddings_binary(spark: SparkSession, path: str) -> DataFrame:
    """term, embedding of little-endian files: count u32, dim u32, then length u16, term, dim x float32."""

    def run(batches):
        for p in batches:
            for raw in p.content:
                count, dim = struct.unpack_from("<II", raw, 0)
                at, rows = 8, []
                for _ in range(count):
                    (n,) = struct.unpack_from("<H", raw, at)
                    rows.append((raw[at + 2 : at + 2 + n].decode(), list(struct.unpack_from(f"<{dim}f", raw, at + 2 + n))))
                    at += 2 + n + 4 * dim
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["term", "embedding"])
                        rows = []
                yield pd.DataFrame(rows, columns=["term", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "term string, embedding array<float>")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t")
