"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Equal vectors are one node (it carries its k + 1 smallest ids, enough for any answer), so a vector
that a third of the rows share does not fill neighbour lists. Nodes go to shards of about
SHARD_NODES by the hash of an id. A shard's graph is built by tiled products: every level holds a
random 1 / LEVEL_RATIO of the level below, each node's neighbours come from its nearest candidates
by the diversity heuristic, plus reverse links, and are stored as flat int32 arrays. Inner product
becomes a distance by one added component (the rest of the shard's largest norm), so the graph also
serves vectors of unequal norms. The index covers every row and is written as a table.

Queries come in blocks; each (block, shard) pair descends the levels and runs a beam search for all
its queries at once, then rescores its best nodes in doubles on the original vectors. Pairs are dealt
to a grid of tasks (vectors.over_grid), and the shards' lists are merged per query. Every query visits
every shard, so the work is queries x shards.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part;
vectors of different lengths are never compared; a repeated vec_id counts once, with its smallest vector;
fewer candidates than k give all that are found; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship
from .vectors import one_each, over_grid, packed, pieces, shards, unpack, usable

SHARD_NODES = 8192
BLOCK_BYTES = 256 << 10
LINKS = 16
CANDIDATES = 64
LEVEL_RATIO = 16
BEAM = 256
ENTRIES = 32
STEP = 4


def neighbours(x: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Flat neighbour table (n, 2 * links) of rows of equal norm, padded with -1."""
    n = len(x)
    m = min(CANDIDATES, n - 1)
    forward = np.full((n, links), -1, np.int32)
    near = np.full((n, links), -np.inf, np.float32)
    for a in range(0, n if m > 0 else 0, 512):
        rows = x[a : a + 512]
        s = rows @ x.T
        s[np.arange(len(rows)), np.arange(a, a + len(rows))] = -np.inf
        c = np.argpartition(-s, m - 1, axis=1)[:, :m]
        sc = np.take_along_axis(s, c, 1)
        order = np.argsort(-sc, axis=1, kind="stable")
        c, sc = np.take_along_axis(c, order, 1), np.take_along_axis(sc, order, 1)
        vec = x[c]
        between = vec @ vec.transpose(0, 2, 1)
        taken = np.zeros(c.shape, bool)
        worst = np.full(c.shape, -np.inf, np.float32)  # nearest taken candidate to each candidate
        for j in range(m):
            take = (worst[:, j] < sc[:, j]) & (taken.sum(axis=1) < links)
            taken[:, j] = take
            np.maximum(worst, np.where(take[:, None], between[:, j], -np.inf), out=worst)
        rank = np.argsort(~taken, axis=1, kind="stable")[:, :links]  # diverse ones, then the nearest
        forward[a : a + len(rows), : rank.shape[1]] = np.take_along_axis(c, rank, 1)
        near[a : a + len(rows), : rank.shape[1]] = np.take_along_axis(sc, rank, 1)
    out = np.full((n, 2 * links), -1, np.int32)
    out[:, :links] = forward
    src, col = np.nonzero(forward >= 0)
    dst, score = forward[src, col], near[src, col]
    order = np.lexsort((-score, dst))
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    ok = place < links
    out[dst[ok], links + place[ok]] = src[ok]
    return out


def build(vectors: np.ndarray, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(nodes of each level, neighbour tables in positions of that level), bottom level first."""
    norm2 = (vectors**2).sum(axis=1)
    x = np.column_stack([vectors, np.sqrt(np.maximum(norm2.max() - norm2, 0))])
    x = (x / np.sqrt(norm2.max())).astype(np.float32)
    nodes, tables = [np.arange(len(x), dtype=np.int32)], [neighbours(x)]
    random = np.random.default_rng(seed)
    while len(nodes[-1]) > LEVEL_RATIO * 4:
        up = np.sort(random.choice(nodes[-1], len(nodes[-1]) // LEVEL_RATIO, replace=False))
        nodes.append(up.astype(np.int32))
        tables.append(neighbours(x[up]))
    return nodes, tables


def beam_search(q: np.ndarray, x: np.ndarray, table: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the `width` best rows found for each query, best first; -1 pads."""
    nq, n = len(q), len(x)
    seen = np.zeros((nq, n + 1), bool)  # the last column takes the padding
    seen[:, n] = True
    rows = np.arange(nq)[:, None]

    def look(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.sort(np.where(ids < 0, n, ids), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = n
        ids = np.where(seen[rows, ids], n, ids)
        seen[rows, ids] = True
        s = np.matmul(x[np.minimum(ids, n - 1)], q[:, :, None])[:, :, 0]
        s[ids == n] = -np.inf
        return ids, s

    pool, score = look(entries)
    pad = max(0, width - pool.shape[1])
    pool = np.pad(pool, ((0, 0), (0, pad)), constant_values=n)
    score = np.pad(score, ((0, 0), (0, pad)), constant_values=-np.inf)
    order = np.argsort(-score, axis=1)[:, :width]
    pool, score = np.take_along_axis(pool, order, 1), np.take_along_axis(score, order, 1)
    done = score == -np.inf
    while not done.all():
        pick = np.argsort(done, axis=1, kind="stable")[:, :STEP]
        fresh = ~np.take_along_axis(done, pick, 1)
        at = np.where(fresh, np.take_along_axis(pool, pick, 1), n)
        np.put_along_axis(done, pick, True, 1)
        live = np.flatnonzero(fresh.any(axis=1))
        links = np.where(at[:, :, None] < n, table[np.minimum(at, n - 1)], -1).reshape(nq, -1)
        ids, s = look(links)
        pool, score, done = np.hstack([pool, ids]), np.hstack([score, s]), np.hstack([done, s == -np.inf])
        order = np.argsort(-score, axis=1, kind="stable")[:, :width]
        pool, score, done = (np.take_along_axis(a, order, 1) for a in (pool, score, done))
        if not len(live):
            break
    return np.where(score == -np.inf, -1, pool), score


def search(q: np.ndarray, vectors: np.ndarray, nodes: list[np.ndarray], tables: list[np.ndarray], width: int = BEAM) -> np.ndarray:
    """Positions of about the `width` best vectors for each query, best first; -1 pads."""
    q32, x = q.astype(np.float32), vectors.astype(np.float32)
    top = nodes[-1]
    found = np.broadcast_to(top, (len(q), len(top)))
    found = np.take_along_axis(found, np.argsort(-(q32 @ x[top].T), axis=1)[:, :ENTRIES], 1)
    for level in range(len(nodes) - 1, -1, -1):
        place = np.searchsorted(nodes[level], np.maximum(found, 0))
        entries = np.where(found >= 0, place, -1)
        at, _ = beam_search(q32, x[nodes[level]], tables[level], entries, width if level == 0 else ENTRIES)
        found = np.where(at >= 0, nodes[level][np.maximum(at, 0)], -1)
    return found


def index(vectors: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(the index table: per (dim, shard) vectors, their ids, and the levels' flat arrays; its number of shards).

    vectors are rows of vectors.one_each().
    """
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = vectors.withColumn("nth", nth).where(F.col("nth") <= k + 1)  # limited before the shuffle
    nodes = few.groupBy("v", "dim").agg(F.array_sort(F.collect_set("vec_id")).alias("members"))
    nodes = materialize(nodes.withColumn("vec_id", F.col("members")[0]), "nodes")
    n = max(1, -(-nodes.count() // SHARD_NODES))

    def make(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id", kind="stable")
        x = np.stack(g.v.to_numpy()).astype(np.float64)
        levels, tables = build(x, int(g["shard"].iloc[0]))
        members = [np.asarray(m, np.int64) for m in g.members]
        ptr = np.concatenate([[0], np.cumsum([len(m) for m in members])]).astype(np.int64)
        row = (g.dim.iloc[0], g["shard"].iloc[0], x.tobytes(), np.concatenate(members).tobytes(), ptr.tobytes(), [a.tobytes() for a in levels], [a.tobytes() for a in tables])
        return pd.DataFrame([row], columns=["dim", "shard", "vectors", "ids", "ptr", "nodes", "links"])

    schema = "dim int, shard int, vectors binary, ids binary, ptr binary, nodes array<binary>, links array<binary>"
    return materialize(shards(nodes, n).groupBy("dim", "shard").applyInPandas(make, schema), "hnsw"), n


def nearest(vectors: DataFrame, is_query: Column, k: int, width: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: about the k largest inner products of every query row."""
    ship(vectors.sparkSession)
    rows = materialize(one_each(usable(vectors, drop_zero=True)), "vectors")
    graph, n_shards = index(rows, k)
    queries = rows.where(is_query)
    _, n_blocks = pieces(queries, BLOCK_BYTES)
    blocks = packed(shards(queries, n_blocks).withColumnRenamed("shard", "block"), "block")

    def find(t, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q_ids, q = unpack(b.ids, b.vectors, b.dim)
        x = np.frombuffer(t.vectors, np.float64).reshape(-1, int(t.dim))
        ids, ptr = np.frombuffer(t.ids, np.int64), np.frombuffer(t.ptr, np.int64)
        nodes = [np.frombuffer(a, np.int32) for a in t.nodes]
        tables = [np.frombuffer(a, np.int32).reshape(len(b), -1) for a, b in zip(t.links, nodes, strict=True)]
        out_q, out_v, out_s = [], [], []
        for i, at in enumerate(search(q, x, nodes, tables, max(width, 2 * k))[:, : k + 8]):
            at = at[at >= 0]
            s = np.einsum("ij,j->i", x[at], q[i])
            who = np.concatenate([ids[ptr[j] : ptr[j + 1]] for j in at])
            s = np.repeat(s, ptr[at + 1] - ptr[at])
            ok = who != q_ids[i]
            who, s = who[ok], s[ok]
            best = np.lexsort((who, -s))[:k]
            out_q.append(np.full(len(best), q_ids[i]))
            out_v.append(who[best])
            out_s.append(s[best])
        return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)

    return over_grid(graph, blocks, n_shards, n_blocks, find, k, "double")
