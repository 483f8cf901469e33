"""Model hooks and training data: edge weigher, expansion scorer, link prediction, three exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import scoring
from ..functions.scalars import json_kind
from ..sources.workspace import materialize
from . import graph

EDGE_FEATURES = ["cnt", "df_a", "df_b", "n", "mean", "npmi"]


def onnx_weigher(model: bytes) -> Callable[[dict[str, Column]], Column]:
    """A weigher for edges(method="ml"): the model scores feature rows in Arrow batches, one session per task."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(model)
        for columns in batches:
            x = np.column_stack(columns).astype(np.float32)
            yield pd.Series(np.ravel(session.run(None, {session.get_inputs()[0].name: x})[0]).astype(float))

    return lambda f: run(f["cnt"], f["df_a"], f["df_b"], f["n"], f["mean"])


def rescored(expansions: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """query_id, term, score: the scorer's values replace energies per query; without one they pass through."""
    if scorer is None:
        return expansions.select("query_id", "term", F.col("energy").alias("score"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"query_id": g.query_id, "term": g.term, "score": scorer(g).astype(float)})

    kind = expansions.schema["query_id"].dataType.simpleString()
    return expansions.groupBy("query_id").applyInPandas(run, f"query_id {kind}, term string, score double")


def predicted_links(edges: DataFrame, predictor: Column, batch: int = 100, least: float = 0.1, most: float = 0.5) -> DataFrame:
    """Edges between consecutive nodes of batches of about `batch` nodes where the predictor, over the features of both, reaches `least`.

    Nodes are dealt to batches by hash, as many as their number needs, so a batch stays small.
    Features are degree, avg_weight, max_weight, min_weight of a node and next_* of the next one.
    """
    nodes = graph.node_features(edges)
    groups = F.pmod(F.xxhash64("node"), F.lit(max(1, -(-nodes.count() // batch))))
    order = Window.partitionBy("batch").orderBy("node")
    rows = nodes.withColumn("batch", groups)
    for c in ("node", "degree", "avg_weight", "max_weight", "min_weight"):
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    rows = rows.where("next_node is not null").withColumn("p", predictor).where(F.col("p") >= least)
    rows = rows.select(F.col("node").alias("src"), F.col("next_node").alias("dst"), F.least("p", F.lit(most)).alias("weight"))
    tagged = [F.lit("gnn_predicted").alias("edge_type"), F.lit("gnn").alias("source")]
    return rows.select("src", "dst", "weight", *tagged).unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", *tagged))


def estimated_count(weight: Column, df_a: Column, df_b: Column, n: Column) -> Column:
    """Pair count from an edge weight: up to 20 Newton steps on the npmi formula, at least 1."""
    npmi = weight / 1.5
    pa, pb = df_a / n, df_b / n
    start = F.sqrt(pa * pb)
    most = F.least(pa, pb)

    def step(p: Column, _: Column) -> Column:
        f = F.log(p / (pa * pb)) + npmi * F.log(p)
        nxt = p - f / ((1 + npmi) / p)
        return F.greatest(F.least(nxt, most), F.lit(1e-12))

    p = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.greatest(F.least(start, most), F.lit(1e-12)), step)
    return F.greatest(F.round(p * n).cast("long"), F.lit(1).cast("long"))


def edge_features(edges: DataFrame, term_stats: DataFrame, total_docs: int, estimate: bool = False, field: str = "") -> DataFrame:
    """The 14 columns of the edge export, one direction (src <= dst); the real count unless estimate; DFs of the field, or of all."""
    term_stats = term_stats.where(F.col("field") == field) if field else term_stats
    df = term_stats.groupBy("term").agg(F.sum("df").alias("df"))
    side = lambda name, count: df.select(F.col("term").alias(name), F.col("df").alias(count)).hint("shuffle_hash")  # noqa: E731  one row for each term
    rows = edges.where("src <= dst").join(side("src", "df_a"), "src").join(side("dst", "df_b"), "dst")
    n = F.lit(float(total_docs))
    cnt = estimated_count(F.col("weight"), F.col("df_a"), F.col("df_b"), n) if estimate or "cnt" not in edges.columns else F.col("cnt").cast("long")
    rows = rows.withColumn("c", cnt)
    c, a, b = F.col("c"), F.col("df_a"), F.col("df_b")
    npmi = F.when(c != n, F.log((c / n) / ((a / n) * (b / n))) / -F.log(c / n)).otherwise(0.0)
    six = lambda x: F.round(x, 6)
    rows = scoring.with_llr(rows, c, a, b, n)
    ratio = F.least(a, b) / F.greatest(a, b)
    return rows.select(
        F.col("src").alias("term_a"), F.col("dst").alias("term_b"), c.alias("cooc_count"), "df_a", "df_b", F.lit(total_docs).cast("long").alias("total_docs"),
        six(F.col("weight")).alias("weight"), six(npmi).alias("npmi"), six(F.col("llr")).alias("llr"), six(2.0 * c / (a + b)).alias("dice"),
        six(F.log1p(c.cast("double"))).alias("log_count"), six(ratio).alias("df_ratio"), six(F.col("weight")).alias("target_weight"), json_kind(F.col("source")).alias("source"),
    )


def graph_rows(edges: DataFrame) -> DataFrame:
    """term_a, term_b, weight with six places, one direction, field prefixes removed."""
    bare = lambda c: F.element_at(F.split(c, "\u0000"), -1)
    return edges.where("src <= dst").select(bare(F.col("src")).alias("term_a"), bare(F.col("dst")).alias("term_b"), F.format_string("%.6f", F.col("weight")).alias("weight"))


def expansion_features(
    edges: DataFrame, queries: DataFrame, postings: DataFrame, term_stats: DataFrame, judgments: DataFrame, embeddings: DataFrame | None = None, top: int = 50, hops: int = 3
) -> DataFrame:
    """Per query (query_id, term rows) and expansion: energy, df, cos, degree, avg_weight, query_len, label.

    label is 1 where the expansion occurs in a document judged relevant (grade > 0) for the query.
    """
    energy = graph.spread_activation(edges, queries.select(F.col("term").alias("start")), 1.0, hops)
    rows = queries.join(energy, queries.term == energy.start).groupBy("query_id", F.col("node").alias("expansion")).agg(F.sum("energy").alias("energy"))
    rows = rows.join(queries.select("query_id", F.col("term").alias("expansion")), ["query_id", "expansion"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("energy"), "expansion"))
    rows = materialize(rows.withColumn("nth", nth).where(F.col("nth") <= top).drop("nth"), "expansions")
    own = rows.select("expansion").distinct()  # edges and postings of other terms are left out before they are grouped
    edges, postings = edges.join(own.withColumnRenamed("expansion", "src"), "src", "left_semi"), postings.join(own.withColumnRenamed("expansion", "term"), "term", "left_semi")
    df = term_stats.groupBy(F.col("term").alias("expansion")).agg(F.sum("df").alias("df"))
    features = graph.node_features(edges).select(F.col("node").alias("expansion"), "degree", "avg_weight")
    size = queries.groupBy("query_id").agg(F.count("*").alias("query_len"))
    good = judgments.where("grade > 0").select("query_id", "doc_id").distinct()
    hit = postings.select(F.col("term").alias("expansion"), "doc_id").join(good, "doc_id").select("query_id", "expansion").distinct().withColumn("label", F.lit(1))
    out = rows.join(df, "expansion", "left").join(features, "expansion", "left").join(size, "query_id").join(hit, ["query_id", "expansion"], "left")
    if embeddings is not None:
        from .embeddings import centroids

        center = centroids(queries.select(F.col("query_id").alias("group_id"), "term"), embeddings).select(F.col("group_id").alias("query_id"), F.col("embedding").alias("c"))
        out = out.join(center, "query_id", "left").join(embeddings.select(F.col("term").alias("expansion"), "embedding"), "expansion", "left")
        out = out.withColumn("cos", F.coalesce(scoring.cosine(F.col("embedding").cast("array<double>"), F.col("c")), F.lit(0.0))).drop("c", "embedding")
    else:
        out = out.withColumn("cos", F.lit(0.0))
    return out.fillna(0, ["label", "df", "degree"]).fillna(0.0, ["avg_weight"]).select("query_id", "expansion", "energy", "df", "cos", "degree", "avg_weight", "query_len", "label")
