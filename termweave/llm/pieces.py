"""SentencePiece encoding and decoding.

Unigram models, lattice_encode(): the distinct words of a column are exploded into substrings of
bounded length, equi-joined to the piece table (a fixed few ten thousand rows, so broadcast),
grouped by word and end, and folded by a Viterbi pass in one higher-order aggregate.

BPE models, encode(): the sum of scores does not order BPE segmentations (a BPE score is a merge
rank), so the lattice's best path is not the model's encoding; encode() follows the merges, in
Arrow batches with the sentencepiece runtime, and decode() is its inverse. README has the figures.

Cases: null text counts as empty and has no pieces; repeated rows are encoded each; texts of any
length are encoded whole; unknown characters become byte pieces; U+2581 in a text decodes to a
space; an empty table gives no rows; extra columns are not read; a null doc_id stays null.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, tokenizer_path

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def processor(path: str):
    """One loaded model per process and file."""
    kept = sys.modules[__name__].__dict__.setdefault("_models", {})
    if path not in kept:
        import sentencepiece

        kept[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return kept[path]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """piece, id, score of the ordinary pieces."""
    p = processor(path)
    special = lambda i: p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)
    rows = [(p.id_to_piece(i), i, float(p.get_score(i))) for i in range(p.get_piece_size()) if not special(i)]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def words_of(text: Column) -> Column:
    """The units that no piece crosses: runs of spaces with the word after them, spaces as U+2581."""
    marked = F.concat(F.lit(SPACE), F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(SPACE)))
    return F.when(F.coalesce(text, F.lit("")) != "", F.regexp_extract_all(marked, F.lit(f"({SPACE}*[^{SPACE}]+|{SPACE}+)"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def lattice(words: DataFrame, pieces: DataFrame, longest: int = 16) -> DataFrame:
    """word, ends: for every end position the edges (start, score, id) into it; characters without a piece get id 0."""
    least = pieces.agg((F.min("score") - UNKNOWN_PENALTY).alias("s")).first().s
    n = F.length("word")
    starts = words.select("word").distinct().select("word", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("n"), F.col("start") + longest))).alias("end"))
    spans = spans.withColumn("piece", F.substring("word", F.col("start") + 1, F.col("end") - F.col("start")))
    edges = spans.join(F.broadcast(pieces), "piece", "left").where("id is not null or end = start + 1")  # fixed model vocabulary
    edge = F.struct("start", F.coalesce("score", F.lit(least)).alias("score"), F.coalesce("id", F.lit(0)).alias("id"))
    by_end = edges.groupBy("word", "end").agg(F.collect_list(edge).alias("edges"))
    return by_end.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("end", "edges"))).alias("ends"))


def viterbi(ends: Column) -> Column:
    """struct<score, ids> of the best path through a word's lattice."""
    none = F.array().cast("array<int>")
    start = F.array(F.struct(F.lit(0.0).alias("score"), none.alias("ids")))

    def step(best: Column, e: Column) -> Column:
        paths = F.transform(e["edges"], lambda x: F.struct((F.get(best, x["start"])["score"] + x["score"]).alias("score"), F.concat(F.get(best, x["start"])["ids"], F.array(x["id"])).alias("ids")))
        return F.concat(best, F.array(F.array_max(paths)))

    return F.element_at(F.aggregate(ends, start, step), -1)


def lattice_encode(words: DataFrame, pieces: DataFrame, longest: int = 16) -> DataFrame:
    """word, score, ids of the distinct non-empty words by the best sum of scores."""
    best = lattice(words.where("word <> ''"), pieces, longest).select("word", viterbi(F.col("ends")).alias("b"))
    return best.select("word", "b.score", "b.ids")


SCHEMA = "doc_id long, n_pieces long, ids array<int>, ids_crc32 long, round_trip boolean"


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids, ids_crc32, round_trip (decoding gives the text back) for every row."""
    ship(docs.sparkSession)
    path = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = processor(path)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                piece = b.slice(a, 256)
                texts = [x or "" for x in piece.column(1).to_pylist()]
                ids = p.encode(texts, num_threads=1)
                same = [x == y for x, y in zip(p.decode(ids, num_threads=1) if ids else [], texts, strict=True)]
                arrays = [np.asarray(x, np.int32) for x in ids]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in arrays]
                cols = [piece.column(0), pa.array([len(x) for x in arrays], pa.int64()), pa.array(arrays, pa.list_(pa.int32())), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pieces", "ids", "ids_crc32", "round_trip"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of rows with ids."""
    ship(encoded.sparkSession)
    path = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = processor(path)
        for b in batches:
            texts = [p.decode([int(i) for i in ids or []]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as bigint) as doc_id", "ids").mapInArrow(run, "doc_id long, text string")
