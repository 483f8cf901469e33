"""Shared by the two vector searches: usable vectors, shards and query blocks as packed rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, drop_zero: bool) -> DataFrame:
    """vec_id long, v array<double>, dim int: rows with an id and only finite components.

    drop_zero also leaves out vectors whose components are all zero. Empty arrays never take part.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite
    if drop_zero:
        ok &= F.exists("v", lambda x: x != 0)
    return v.where(ok).withColumn("dim", F.size("v"))


def one_each(rows: DataFrame) -> DataFrame:
    """usable() rows with one vector per vec_id: of several vectors with one id the smallest (component by component) stands.

    Repeats are aggregated before the shuffle, so an id that a large share of the rows has is no large group.
    """
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def pieces(rows: DataFrame, most: int) -> tuple[int, int]:
    """(rows, pieces): how many pieces of at most about `most` bytes of doubles the vectors make."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("dim").cast("long") * 8), F.lit(0))).first()
    return n, max(1, -(-size // most))


def shards(rows: DataFrame, n: int, key: str = "vec_id") -> DataFrame:
    """Adds shard, 0 .. n - 1, by the hash of an id: shards are even whatever the vectors hold."""
    return rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def packed(rows: DataFrame, by: str) -> DataFrame:
    """One row per (dim, by): ids and vectors, ascending by id; groups are bounded by their bytes."""

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id")
        v = np.stack(g.v.to_numpy()).astype(np.float64)
        return pd.DataFrame([(g.dim.iloc[0], g[by].iloc[0], g.vec_id.to_numpy(np.int64).tobytes(), v.tobytes())], columns=["dim", by, "ids", "vectors"])

    return rows.select("dim", by, "vec_id", "v").groupBy("dim", by).applyInPandas(pack, f"dim int, {by} int, ids binary, vectors binary")


def unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, int(dim))


#: Pairs of a shard and a query block that one task works on, at most about.
TILES = 256


def grid(n_shards: int, n_blocks: int, workers: int) -> tuple[int, int]:
    """(rows, columns) of the grid of tasks over all pairs of shards and blocks."""
    cells = min(n_shards * n_blocks, max(2 * workers, -(-n_shards * n_blocks // TILES)))
    down = min(n_shards, max(1, round((cells * n_shards / n_blocks) ** 0.5)))
    return down, min(n_blocks, -(-cells // down))


def over_grid(shard_rows: DataFrame, block_rows: DataFrame, n_shards: int, n_blocks: int, find: Callable, k: int, score: str) -> DataFrame:
    """query_id, rank, vec_id, score: find(shard row, block row) over all pairs, the k best of each query.

    Pairs are dealt to a grid of cells: a shard goes once to every cell of its row, a block once to
    every cell of its column. So the bytes moved grow with the grid's sides, not with the pairs, no
    two rows meet by a constant key, and a task holds one cell's shards and blocks (TILES bounds them).
    find gives (query ids, vec ids, scores); a cell keeps the k best per query of all its shards.
    """
    down, across = grid(n_shards, n_blocks, block_rows.sparkSession.sparkContext.defaultParallelism)
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = shard_rows.withColumn("r", F.col("shard") % down).withColumn("c", span(across))
    right = block_rows.withColumn("c", F.col("block") % across).withColumn("r", span(down))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        for block in b.itertuples():
            found = [find(shard, block) for shard in a.itertuples()]
            if not found:
                continue
            q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            ok = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append(pd.DataFrame({"query_id": q[ok], "shard": int(a.r.iloc[0]), "vec_id": v[ok], "score": s[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "shard": [], "vec_id": [], "score": []})

    key = ["dim", "r", "c"]
    rows = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, f"query_id long, shard int, vec_id long, score {score}")
    return best_of(rows, k)


def best_of(rows: DataFrame, k: int, fan_in: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all shards' lists, merged as a tree of two levels."""

    def level(df: DataFrame, *by: str | Column) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    part = level(rows, "query_id", F.floor(F.col("shard") / fan_in))
    return level(part.drop("rank"), "query_id").select("query_id", "rank", "vec_id", "score")
