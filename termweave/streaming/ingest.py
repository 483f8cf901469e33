"""Streaming ingest: micro-batches into postings, DFs and pair counts, idempotent by batch id."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cooc
from ..operators.index import Spec, postings_of, sharded, tokens


def start(docs: DataFrame, spec: Spec, path: str, checkpoint: str, window: int = 0, trigger: dict | None = None, fields: tuple[str, ...] = ()) -> StreamingQuery:
    """Write each micro-batch's postings (and pairs, if window) under its batch id; a replay overwrites it.

    Pairs are those of the text fields (or of the list), kept per document so that a later version
    of a document replaces them. Back-pressure is the source's own (maxFilesPerTrigger,
    maxBytesPerTrigger); nothing is dropped.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        postings_of(batch, spec).write.mode("overwrite").parquet(f"{path}/postings/batch={batch_id}")
        # a document without terms still replaces its earlier version
        sharded(batch, spec).select("shard_id", F.col(spec.key).alias("doc_id")).distinct().write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")
        if window:
            rows = cooc.document_rows(batch, spec, window, fields=fields)
            rows.groupBy("shard_id", "field", "doc_id", "term_a", "term_b").agg(F.count("*").alias("cnt"), F.sum("weight").alias("wsum")).write.mode("overwrite").parquet(f"{path}/pairs/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _kept(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")


def state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Totals over all batches, of the last version of each document: postings, term_stats and, if kept, pairs."""
    last = _kept(spark, path, "seen").groupBy("shard_id", "doc_id").agg(F.max("batch").alias("batch"))
    live = lambda d: d.join(last, ["shard_id", "doc_id", "batch"], "left_semi").drop("batch")
    posts = live(_kept(spark, path, "postings"))
    out = {"postings": posts, "term_stats": posts.groupBy("shard_id", "field", "term").agg(F.count("*").alias("df"))}
    try:
        rows = _kept(spark, path, "pairs")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return out  # pairs were not kept
    out["pairs"] = live(rows).groupBy("shard_id", "field", "term_a", "term_b").agg(F.sum("cnt").alias("cnt"), F.sum("wsum").alias("wsum"))
    return out


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the live state as batch 0 of a new path, so that reading it costs one version of each document."""
    now = state(spark, path)
    now["postings"].write.mode("overwrite").parquet(f"{target}/postings/batch=0")
    _kept(spark, path, "seen").select("shard_id", "doc_id").distinct().write.mode("overwrite").parquet(f"{target}/seen/batch=0")
    if "pairs" in now:
        last = _kept(spark, path, "seen").groupBy("shard_id", "doc_id").agg(F.max("batch").alias("batch"))
        _kept(spark, path, "pairs").join(last, ["shard_id", "doc_id", "batch"], "left_semi").drop("batch").write.mode("overwrite").parquet(f"{target}/pairs/batch=0")


def term_counts(docs: DataFrame, spec: Spec) -> DataFrame:
    """A streaming aggregate of token counts per term, for update or complete mode."""
    return tokens(docs, spec).groupBy("shard_id", "field", "term").agg(F.count("*").alias("n"))


def bucket_counts(events: DataFrame, time: str, bucket: str, late: str, *by: str) -> DataFrame:
    """Event-time tumbling buckets with a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, bucket), *by).agg(F.count("*").alias("n"))
