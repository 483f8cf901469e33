"""Exports of training data from a stored index: python -m termweave.export --index DIR --edges DIR --export edges --out DIR."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import ml
from .operators.index import Field, Index, Spec
from .sources import files


def main(argv: list[str] | None = None) -> None:
    """edges (14-column CSV), graph (TSV) or expansion (CSV; needs --judgments)."""
    p = argparse.ArgumentParser(prog="termweave.export", description=main.__doc__)
    p.add_argument("--index", required=True, help="folder of Index.write")
    p.add_argument("--edges", required=True, help="Parquet of edges: src, dst, weight, source")
    p.add_argument("--export", choices=("edges", "graph", "expansion"), required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--judgments", help="TSV of query_id, query_text, doc_id, grade")
    p.add_argument("--field", default="text")
    a = p.parse_args(argv)
    if a.export == "expansion" and not a.judgments:
        p.error("--export expansion needs --judgments")
    spark = SparkSession.builder.getOrCreate()
    index, edges = Index.read(spark, a.index, Spec((Field(a.field),))), spark.read.parquet(a.edges)
    if a.export == "graph":
        files.write_tsv(ml.graph_rows(edges), a.out)
    elif a.export == "edges":
        total = index.shard_stats.agg(F.sum("total_docs")).first()[0] or 0
        files.write_csv(ml.edge_features(edges, index.term_stats, total, field=a.field), a.out)
    else:
        judged = files.judgments(spark, a.judgments)
        words = F.filter(F.split(F.lower("query_text"), r"\s+"), lambda w: F.octet_length(w) >= 2)
        queries = judged.select("query_id", F.explode(words).alias("term")).distinct()
        judged = judged.withColumn("doc_id", F.col("doc_id").cast(index.postings.schema["doc_id"].dataType))
        files.write_csv(ml.expansion_features(edges, queries, index.postings, index.term_stats, judged), a.out)


if __name__ == "__main__":
    main()
