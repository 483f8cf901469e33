"""Co-occurring terms: positional pairs within sentences, and weighted edges.

document_pairs counts pairs on arrays of term ids (functions.kernels): a task sums millions of pairs at
a time and sends them packed, a pair's sums meet in its bucket. row_pairs makes the pairs of a sentence
inside its row; pair_rows does it for token rows, through a join on blocks of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import analysis, kernels, scoring
from .index import Spec, sharded


def compressed(tokens: DataFrame) -> DataFrame:
    """Positions renumbered from 0 within (shard, field, doc, sentence)."""
    order = Window.partitionBy("shard_id", "field", "doc_id", "sentence").orderBy("position", "term")
    return tokens.withColumn("at", (F.row_number().over(order) - 1).cast("int"))


def pair_rows(tokens: DataFrame, window: int, decay: str = "log") -> DataFrame:
    """shard_id, field, doc_id, term_a < term_b, weight: pairs at most `window` places apart in a sentence.

    tokens: shard_id, field, doc_id, sentence, at (place), term. An equi-join on blocks of `window`
    places finds the neighbours: each token meets its own block and the next.
    """
    keys = ["shard_id", "field", "doc_id", "sentence"]
    t = tokens.select(*keys, "at", "term").withColumn("block", F.floor(F.col("at") / window))
    right = t.select(*keys, F.col("at").alias("at_b"), F.col("term").alias("b"), F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("block"))
    near = t.join(right, [*keys, "block"]).where((F.col("at_b") > F.col("at")) & (F.col("at_b") - F.col("at") <= window) & (F.col("term") != F.col("b")))
    weight = scoring.decay(F.col("at_b") - F.col("at"), decay)
    return near.select("shard_id", "field", "doc_id", F.least("term", "b").alias("term_a"), F.greatest("term", "b").alias("term_b"), weight.alias("weight"))


def row_pairs(sentences: DataFrame, window: int, decay: str = "log", keep: tuple[str, ...] = ("shard_id", "field")) -> DataFrame:
    """The same inside the row, for sentences given as rows with tokens array<struct<term, ...>>: no shuffle before the sums.

    A token carries the `window` tokens after it, so a row holds at most `window` times its sentence. Places are those among the tokens given: positions are compressed within the sentence.
    """
    rows = sentences.select(*keep, F.col("tokens")["term"].alias("w"))
    near = F.transform("w", lambda a, i: F.struct(a.alias("a"), F.slice("w", i + 2, window).alias("after")))
    rows = rows.select(*keep, F.explode(near).alias("t")).select(*keep, F.col("t.a").alias("a"), F.posexplode("t.after").alias("gap", "b")).where("a <> b")
    return rows.select(*keep, F.least("a", "b").alias("term_a"), F.greatest("a", "b").alias("term_b"), scoring.decay(F.col("gap") + 1, decay).alias("weight"))


def document_rows(docs: DataFrame, spec: Spec, window: int, decay: str = "log", fields: tuple[str, ...] = ()) -> DataFrame:
    """shard_id, field, doc_id, term_a < term_b, weight: pairs of all text fields (or those listed), within sentences."""
    parts, keep = [], ("shard_id", "field", "doc_id")
    for f in spec.planned():
        if f.kind != "text" or fields and f.name not in fields:
            continue
        name = spec.analyzer_of(f)
        rows = sharded(docs, spec).select("shard_id", F.lit(f.name).alias("field"), F.col(spec.key).alias("doc_id"), F.col(f.name).cast("string").alias("value"))
        parts.append(_restemmed(row_pairs(analysis.sentence_rows(rows, "value", keep, name), window, decay, keep), name))
    return _union(parts)


#: Bytes of text, times the window, whose pairs share a bucket: about two million sums before they meet.
BUCKET_BYTES = 35 << 20


def document_pairs(docs: DataFrame, spec: Spec, window: int, decay: str = "log", fields: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """Pair sums over documents, of pairs met `least` times or more; there are as many buckets as the length of the texts needs."""
    parts = []
    for f in spec.planned():
        if f.kind != "text" or fields and f.name not in fields:
            continue
        name, value = spec.analyzer_of(f), F.col(f.name).cast("string")
        if window > kernels.MOST_WINDOW:  # a distance would not fit beside two terms
            found = pairs(document_rows(docs, spec, window, decay, (f.name,)))
            parts.append(found.where(F.col("cnt") >= least) if least > 1 else found)
            continue
        rows = sharded(docs, spec).select("shard_id", analysis.items(value, name, ends=True).alias("items"))
        size = docs.agg(F.sum(F.octet_length(value))).first()[0] or 0
        buckets = max(1, min(1 << 16, -(-size * window // BUCKET_BYTES)))
        weights = scoring.decay_values(window, decay)
        sent = rows.mapInArrow(kernels.pair_parts(name, window, weights, buckets), "bucket int, payload binary")
        found = sent.groupBy("bucket").applyInArrow(kernels.pair_sums(weights, least), "shard_id string, term_a string, term_b string, cnt bigint, wsum double")
        parts.append(found.select("shard_id", F.lit(f.name).alias("field"), "term_a", "term_b", "cnt", "wsum"))
    return _union(parts)


def window_counts(docs: DataFrame, spec: Spec, window: int) -> DataFrame:
    """shard_id, field, doc_id, n: the pairs of each document that has any, equal terms left out."""
    parts, kind = [], docs.schema[spec.key].dataType.simpleString()
    for f in spec.planned():
        if f.kind == "text":
            name = spec.analyzer_of(f)
            rows = sharded(docs, spec).select("shard_id", F.col(spec.key).alias("doc_id"), analysis.items(F.col(f.name).cast("string"), name, ends=True).alias("items"))
            found = rows.mapInArrow(kernels.window_counts(name, window), f"shard_id string, doc_id {kind}, n bigint")
            parts.append(found.groupBy("shard_id", "doc_id").agg(F.sum("n").alias("n")).select("shard_id", F.lit(f.name).alias("field"), "doc_id", "n"))
    return _union(parts)


def _restemmed(rows: DataFrame, name: str) -> DataFrame:
    """Pairs of words as pairs of stems; those of one stem go."""
    if name == "simple":
        return rows
    for side in ("term_a", "term_b"):
        rows = analysis.stemmed(rows, side, name)
    rows = rows.where("term_a <> term_b")
    return rows.select(*(c for c in rows.columns if c not in ("term_a", "term_b")), F.least("term_a", "term_b").alias("term_a"), F.greatest("term_a", "term_b").alias("term_b"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pairs(rows: DataFrame) -> DataFrame:
    """shard_id, field, term_a, term_b, cnt, wsum; partial sums before the shuffle."""
    return rows.groupBy("shard_id", "field", "term_a", "term_b").agg(F.count("*").alias("cnt"), F.sum("weight").alias("wsum"))


def edges(pair_sums: DataFrame, term_stats: DataFrame, shard_stats: DataFrame, method: str = "npmi", min_count: int = 3, weigher=None, max_df: int = 0) -> DataFrame:
    """Both directions of weighted edges; pairs without a DF are dropped.

    weigher(columns by name) -> Column serves method "ml"; without one, npmi is used. max_df > 0
    also drops terms of higher DF.
    """
    df = term_stats.select("shard_id", "field", "term", "df")
    if max_df:
        df = df.where(F.col("df") <= max_df)
    rows = pair_sums.where(F.col("cnt") >= min_count)
    for side in ("a", "b"):  # a term has one DF, so its side is the one to hold: the pairs are not sorted
        one = df.select("shard_id", "field", F.col("term").alias(f"term_{side}"), F.col("df").alias(f"df_{side}"))
        rows = rows.join(one.hint("shuffle_hash"), ["shard_id", "field", f"term_{side}"])
    rows = rows.join(shard_stats, "shard_id").withColumn("mean", F.col("wsum") / F.col("cnt"))
    c, a, b, n, m = (F.col(x) for x in ("cnt", "df_a", "df_b", "total_docs", "mean"))
    if method == "llr":
        rows = scoring.with_llr(rows, c, a, b, n, "ratio")
    weight, source = {
        "npmi": (scoring.npmi_weight(c, a, b, n, m), "pmi"), "llr": (scoring.llr_weight(c, a, b, n, m, F.col("ratio")), "llr"), "dice": (scoring.dice_weight(c, a, b, m), "dice"),
        "ml": (scoring.clamp(weigher({"cnt": c, "df_a": a, "df_b": b, "n": n, "mean": m})) if weigher else scoring.npmi_weight(c, a, b, n, m), "ml_weight" if weigher else "pmi"),
    }[method]
    # no filter on the weight: the optimizer would push it down and compute the weight twice
    both = [F.struct(F.col(f"term_{x}").alias("src"), F.col(f"term_{y}").alias("dst")) for x, y in ("ab", "ba")]
    both = F.when(F.col("weight") > 0, F.array(*both)).otherwise(F.array().cast("array<struct<src:string,dst:string>>"))
    rows = rows.withColumn("weight", weight).select("shard_id", "field", "weight", F.lit("cooccurrence").alias("edge_type"), F.lit(source).alias("source"), "cnt", F.inline(both))
    return rows.select("src", "dst", "shard_id", "field", "weight", "edge_type", "source", "cnt")
