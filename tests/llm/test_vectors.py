import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from termweave.llm import ann, exact_topk, queries, vectors

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, dim int, shard int"


def odd_rows():
    r = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in r.integers(-3, 4, 4) / 2]) for i in r.permutation(240)]
    same = [0.5, 0.25, -0.5, 1.0]
    rows += [(1000 + i, same) for i in range(80)]  # a vector that many share: ties everywhere
    rows += [(2000, None), (2001, []), (2002, [0.0] * 4), (2003, [1.0, None, 0.0, 0.0]), (2004, [float("nan"), 1.0, 1.0, 1.0]), (2005, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(2010, [1.0, 2.0]), (2050, [3.0, 1.0]), (None, same), (1000, same)]
    return rows


def ranked(rows, is_query, k, score, drop_zero):
    ok = {i: v for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (any(v) or not drop_zero)}
    out = {}
    for q in filter(is_query, ok):
        best = sorted((-score(ok[q], v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
        for n, (s, i) in enumerate(best):
            out[q, n + 1] = (i, -s)
    return out


def test_exact_top_k_equals_brute_force(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA).repartition(3)
    product = lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=True))
    want = ranked(rows, lambda i: i % 50 == 0, 5, product, False)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in exact_topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()}
    assert got == want
    assert exact_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).collect() == []


def test_products_stay_exact_beyond_doubles():
    q, c = np.array([[2.0**31, 3.0]]), np.array([[2.0**31 + 256, 5.0], [-(2.0**40), 2.0**40]])
    assert exact_topk.products(q, c).tolist() == [[2**31 * (2**31 + 256) + 15, max(-(2**63), -(2**71) + 3 * 2**40)]]


def test_approximate_search_on_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA).repartition(3)
    want = ranked(rows, lambda i: i % 20 == 0, 20, lambda a, b: float(np.dot(np.float64(a), np.float64(b))), True)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()}
    assert got.keys() == want.keys()
    per_query = defaultdict(list)
    for (q, n), (i, s) in sorted(got.items()):
        per_query[q].append((-s, i))
        assert i != q
    assert all(x == sorted(x) and len({i for _, i in x}) == len(x) for x in per_query.values())
    assert sum(abs(got[k][1] - want[k][1]) < 1e-9 for k in want) >= 0.9 * len(want)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 20).collect() == []


def test_recall_on_embeddings(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_NODES", 200)  # several shards and levels
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    hit = n = 0
    got = defaultdict(dict)
    for r in queries.op3_approximate_nearest_neighbours(spark, SF).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    for q, best in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        order = np.lexsort((ids, -s))[:20]
        hit += len({i for i, _ in best.values()} & set(ids[order].tolist()))
        n += 20
        for i, score in best.values():
            assert abs(score - s[ids == i][0]) < 1e-9
    assert len(got) == sum(i % 20 == 0 for i in ids.tolist()) and hit / n >= 0.9


def test_recall_on_full_shards():
    """A shard of production size: clustered vectors of unequal norms, and normal ones; 0.9 at least."""
    r = np.random.default_rng(5)
    n, dim, k = ann.SHARD_NODES, 64, 20
    centres = r.standard_normal((60, dim)) * 2
    clustered = (centres[r.integers(0, 60, n)] + r.standard_normal((n, dim)) * 0.4) * r.lognormal(0, 0.3, (n, 1))
    for name, x in (("clustered, unequal norms", clustered), ("normal", r.standard_normal((n, dim)))):
        nodes, tables = ann.build(x, 0)
        q = x[r.choice(n, 200, replace=False)]
        found = ann.search(q, x, nodes, tables)[:, :k]
        exact = np.argsort(-(q @ x.T), axis=1)[:, :k]
        recall = np.mean([len(set(a) & set(b)) / k for a, b in zip(found, exact, strict=True)])
        print(name, recall)
        assert recall >= 0.9


def test_grid_covers_every_pair_once():
    for shards, blocks, workers in ((1, 1, 4), (7, 6, 6), (3, 50, 8), (1000, 40, 16), (5000, 800, 64)):
        down, across = vectors.grid(shards, blocks, workers)
        assert 1 <= down <= shards and 1 <= across <= blocks
        assert -(-shards // down) * -(-blocks // across) <= 4 * vectors.TILES


def test_reused_ids(spark):
    """Of two vectors with one id the smaller stands; repeats of a row change nothing."""
    rows = [(0, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [0.5, 9.0]), (2, [2.0, 0.0])] + [(3, [1.0, 1.0])] * 300
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id, r.score) for r in exact_topk.top_k(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert got == [(1, 2, 512 * 256), (2, 3, 256 * 256), (3, 1, 128 * 256)]
    assert [r.vec_id for r in ann.nearest(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()] == [2, 3, 1]


def test_flat_graph_links_are_valid():
    x = np.random.default_rng(1).standard_normal((300, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = ann.neighbours(x)
    assert table.shape == (300, 2 * ann.LINKS) and table.max() < 300
    assert not (table == np.arange(300)[:, None]).any()
    assert ann.neighbours(x[:1]).max() == -1
