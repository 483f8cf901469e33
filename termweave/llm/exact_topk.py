"""Exact top-k by inner product of integer vectors: tiles of query blocks and candidate shards.

Candidates are packed into shards of about SHARD_BYTES, queries into blocks of BLOCK_BYTES. Every
(block, shard) pair is one tile: a matrix product and a selection of k per query that is exact on
ties (smaller vec_id first). Tiles are dealt to a grid of tasks (vectors.over_grid); the lists are
merged per query within a task, then as a tree. Products are
taken in doubles while all sums stay below 2**53, else in unbounded integers; scores beyond the
range of a long are clamped to it.

Cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of
different lengths are never compared; a repeated vec_id counts once, with its smallest vector; fewer candidates than k give
all of them; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from .common import materialize, ship
from .vectors import one_each, over_grid, packed, pieces, shards, unpack, usable

SHARD_BYTES = 4 << 20
BLOCK_BYTES = 512 << 10
SCALE = 256
_LONG = (1 << 63) - 1


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-valued rows, exact, as int64 (clamped)."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    s = exact(q) @ exact(c).T
    return np.vectorize(lambda x: max(-_LONG - 1, min(_LONG, x)), otypes=[np.int64])(s)


def top_of_tile(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best; earlier columns first on ties; own[i] is a column to skip, or -1."""
    rows, cols = [], []
    m = scores.shape[1]
    kth = np.partition(scores, max(0, m - k - 1), axis=1)[:, max(0, m - k - 1)]  # one more, for the own column
    for i in range(len(scores)):
        s = scores[i]
        over = np.flatnonzero(s > kth[i])
        level = np.flatnonzero(s == kth[i])[: k + 1]
        at = np.concatenate([over, level])
        at = at[at != own[i]]
        at = at[np.lexsort((at, -s[at]))][:k]
        rows.append(np.full(len(at), i))
        cols.append(at)
    return np.concatenate(rows), np.concatenate(cols)


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every query row among all other rows."""
    ship(vectors.sparkSession)
    rows = materialize(one_each(usable(vectors, drop_zero=False)), "vectors")
    (_, n_shards), (_, n_blocks) = pieces(rows, SHARD_BYTES), pieces(rows.where(is_query), BLOCK_BYTES)
    cands = packed(shards(rows, n_shards), "shard")
    blocks = packed(shards(rows.where(is_query), n_blocks).withColumnRenamed("shard", "block"), "block")

    def find(t, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c_ids, c = unpack(t.ids, t.vectors, t.dim)
        q_ids, q = unpack(b.ids, b.vectors, b.dim)
        s = products(np.floor(q * scale), np.floor(c * scale))
        at = np.minimum(np.searchsorted(c_ids, q_ids), len(c_ids) - 1)
        r, j = top_of_tile(s, np.where(c_ids[at] == q_ids, at, -1), k)
        return q_ids[r], c_ids[j], s[r, j]

    return over_grid(cands, blocks, n_shards, n_blocks, find, k, "long")
