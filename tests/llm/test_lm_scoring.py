import numpy as np
import pytest

from termweave.llm import lm_scoring as lm

SF = "/root/testdata/sf0.001"


def dense_log_p(params, around, ids):
    """The same model, one place at a time and without any grouping."""
    e, wg, bg, wm, bm = (p.astype(np.float64) for p in params)
    out = []
    for ctx, w in zip(around, ids, strict=True):
        h = np.tanh(sum(e[k][c] for k, c in enumerate(ctx)))
        z, g = wg @ h + bg, w // lm.MEMBERS
        m = wm[g] @ h + bm[g]
        out.append(z[g] - np.log(np.exp(z).sum()) + m[w % lm.MEMBERS] - np.log(np.exp(m).sum()))
    return np.array(out)


def sample(n=400):
    r = np.random.default_rng(2)
    ids = r.integers(0, 40, n).astype(np.int32)
    ids[1::2] = (ids[::2] * 7 + 3) % lm.VOCABULARY  # every second word follows from the one before
    return ids, np.array([0, 0, n // 3, n // 3, n])


def test_contexts_stay_within_documents():
    ids, ptr = np.arange(7, dtype=np.int32), np.array([0, 3, 3, 7])
    pad = lm.VOCABULARY
    assert lm.contexts(ids, ptr).tolist() == [[pad, pad, 1, 2], [pad, 0, 2, pad], [0, 1, pad, pad], [pad, pad, 4, 5], [pad, 3, 5, 6], [3, 4, 6, pad], [4, 5, pad, pad]]


def test_log_p_equals_dense_softmax_and_sums_to_one():
    ids, ptr = sample()
    params, around = lm.start(), lm.contexts(ids, ptr)
    assert np.allclose(lm.log_p(params, around, ids), dense_log_p(params, around, ids), atol=1e-4)
    every = np.arange(lm.VOCABULARY, dtype=np.int32)
    assert np.exp(lm.log_p(params, np.repeat(around[:1], lm.VOCABULARY, axis=0), every)).sum() == pytest.approx(1, abs=1e-4)


def test_large_logits_do_not_overflow():
    ids, ptr = sample()
    params, around = [20 * x for x in lm.start()], lm.contexts(ids, ptr)
    params[1] *= 10
    params[3] *= 10
    assert not lm._bounded(params[1], params[2]) and not lm._bounded(params[3], params[4])
    got = lm.log_p(params, around, ids)
    assert np.isfinite(got).all() and np.allclose(got, dense_log_p(params, around, ids), rtol=1e-4, atol=1e-2)
    lm.train_step(params, around, ids, 1e-3)
    assert all(np.isfinite(x).all() for x in params)


def test_step_follows_the_gradient():
    ids, ptr = sample(60)
    around, rate = lm.contexts(ids, ptr), 1e-3
    before = lm.start()
    after = [p.copy() for p in before]
    lm.train_step(after, around, ids, rate)
    r = np.random.default_rng(4)
    for k, p in enumerate(before):
        moved = np.argwhere(np.abs(after[k] - p) > 1e-7)
        for at in map(tuple, r.permutation(moved)[:6]):
            up, down = [x.astype(np.float64) for x in before], [x.astype(np.float64) for x in before]
            up[k][at] += 1e-4
            down[k][at] -= 1e-4
            slope = (dense_log_p(up, around, ids).mean() - dense_log_p(down, around, ids).mean()) / 2e-4
            assert (after[k][at] - p[at]) / (rate * lm.PLACES) == pytest.approx(slope, rel=0.05, abs=2e-4)


def test_training_raises_the_likelihood(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known, ids = lm.vocabulary(docs)
    params = lm.train(docs, known, ids)
    again = lm.train(docs, known, ids)
    assert all(np.array_equal(a, b) for a, b in zip(params, again, strict=True))
    mean = lambda p: lm.score(docs, p, known, ids).selectExpr("sum(sum_logp) / sum(n_words) as m").first().m
    assert mean(params) > mean(lm.start()) + 0.3


def test_scores_of_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "a b c"), (4, "w " * 300_000), (5, "é漢 é漢")]
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t in odd], "doc_id long, text string, n_words int, sum_logp double")
    got = lm.pseudo_likelihood(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == [(0, 3), (1, 0), (2, 0), (3, 1), (3, 1), (4, 300_000), (5, 2)]
    for r in got:
        assert r.sum_logp == 0 and r.mean_logp is None if r.n_words == 0 else r.sum_logp < 0 and r.mean_logp == pytest.approx(r.sum_logp / r.n_words)
    assert lm.pseudo_likelihood(docs.limit(0)).collect() == []


def test_vocabulary_is_the_most_frequent_words(spark):
    docs = spark.createDataFrame([("b b b a",), ("A c b",), (None,)], "text string")
    known, ids = lm.vocabulary(docs)
    from termweave.llm.common import hash_words

    order = [int(known[np.flatnonzero(ids == k)[0]]) for k in range(3)]
    h = {w: int(hash_words([w])[0]) for w in "abc"}
    assert order == [h["b"], h["a"], h["c"]]


def test_a_threshold_keeps_no_more_than_asked(spark):
    rows = [(k, 1 + (k < 30) * 5 + (k < 3) * 10**9 * (k + 1)) for k in range(400)]
    counts = spark.createDataFrame(rows, "word long, n long")
    for most, kept in ((400, 400), (399, 30), (30, 30), (29, 3), (2, 2), (0, 0)):
        words, n = lm._top(counts, most)
        assert len(words) == kept and list(n) == sorted(n, reverse=True)


def test_rare_words_take_their_share_of_the_class(spark, monkeypatch):
    from termweave.llm.common import hash_words

    top = [f"top{k}" for k in range(lm.VOCABULARY - lm.RARE)]
    rare = [f"rare{k}" for k in range(400)]
    times = {w: 1 + k % 7 for k, w in enumerate(rare)}
    docs = spark.createDataFrame([(k, w) for k, w in enumerate(top * 9)] + [(-1, w) for w in rare for _ in range(times[w])], "doc_id long, text string")
    counts = lm.counted(docs)
    known, ids = lm.vocabulary(docs, counts)
    asked = spark.createDataFrame(list(enumerate([*rare, "unseen"])), "doc_id long, text string")
    classes = hash_words([*rare, "unseen"]) % lm.RARE
    total = [sum(times[w] for w, x in zip(rare, classes) if x == c) for c in range(lm.RARE)]
    params = lm.start()
    pad = np.full((len(classes), 2 * lm.SIDE), lm.VOCABULARY, np.int32)
    p_class = lm.log_p(params, pad, (lm.VOCABULARY - lm.RARE + classes.astype(np.int64)).astype(np.int32))
    want = p_class + np.log([times.get(w, 1) / (total[c] + 1) for w, c in zip([*rare, "unseen"], classes)])
    for kept in (lm.KEPT, 1100):  # all counts broadcast; most of them joined
        monkeypatch.setattr(lm, "KEPT", kept)
        got = {r.doc_id: r.sum_logp for r in lm.score(asked, params, known, ids, counts).collect()}
        assert np.allclose([got[k] for k in range(len(want))], want, atol=1e-4)


def test_vocabulary_grows_with_the_corpus(spark):
    assert lm.side_of(0) == lm.side_of(1_000_000) == lm.GROUPS and lm.side_of(64_000_000) == 2 * lm.GROUPS
    assert lm.rare_of(lm.GROUPS) == lm.RARE and lm.rare_of(2 * lm.GROUPS) == 4 * lm.RARE
    docs = spark.createDataFrame([(" ".join(f"w{k}" for k in range(5000)),)], "text string")
    known, ids = lm.vocabulary(docs, side=64)
    assert len(known) == 64 * 64 - lm.rare_of(64)
    assert lm.train(docs, known, ids, 64)[0].shape[1] == 64 * 64 + 1


def test_every_place_is_a_target(spark):
    for word in ("one", "two", "three", "four", "five", "six"):
        docs = spark.createDataFrame([(word,)], "text string")
        known, ids = lm.vocabulary(docs)
        params = lm.train(docs, known, ids)
        assert not np.array_equal(params[2], lm.start()[2])  # the word's own group rose
        assert params[2].argmax() == 0


def test_documents_end_to_end(spark):
    """Sums of whole documents equal a dense loop over their words, and natural texts outrank shuffled ones."""
    r = np.random.default_rng(6)
    after = {k: r.permutation(60)[:2] for k in range(60)}  # two words may follow each word
    texts = []
    for _ in range(600):
        w = [int(r.integers(60))]
        while len(w) < 40:
            w.append(int(after[w[-1]][r.integers(2)]))
        texts.append([f"w{k}" for k in w])
    mixed = [[t[i] for i in r.permutation(40)] for t in texts[:50]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    asked = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts[:50] + mixed)], "doc_id long, text string")
    counts = lm.counted(docs)
    known, ids = lm.vocabulary(docs, counts)
    more = docs.unionAll(docs).unionAll(docs).unionAll(docs).unionAll(docs)  # five passes
    params = lm.train(more.coalesce(1), known, ids)
    got = {x.doc_id: x.sum_logp for x in lm.score(asked, params, known, ids, counts).collect()}
    from termweave.llm.common import hash_words

    for k, t in enumerate((texts[:50] + mixed)[::10]):
        w = lm.word_ids(hash_words(t), known, ids)
        assert got[10 * k] == pytest.approx(dense_log_p(params, lm.contexts(w, np.array([0, len(w)])), w).sum(), abs=1e-3)
    assert np.mean([got[k] > got[50 + k] for k in range(50)]) >= 0.9


def test_logits_held_at_once_stay_small():
    """Scoring many places at a large vocabulary works through its logits in pieces of a core's cache."""
    import tracemalloc

    side = 110
    r = np.random.default_rng(3)
    ids = (side * side * r.random(40_000) ** 3).astype(np.int32)
    around, params = lm.contexts(ids, np.array([0, len(ids)]), side), lm.start(side)
    tracemalloc.start()
    lm.log_p(params, around, ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6


def test_find_equals_binary_search():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 1000, 70_000):
        known = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
        h = np.concatenate([known, r.integers(0, 1 << 64, 5000, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        at, hit = lm.find(h, known, lm.starts_of(known))
        assert (hit == np.isin(h, known)).all() and (known[at[hit]] == h[hit]).all()
    crowded = np.arange(500, dtype=np.uint64)  # not spread evenly: slower, but right
    at, hit = lm.find(crowded[::-1], crowded, lm.starts_of(crowded))
    assert hit.all() and (at == np.arange(500)[::-1]).all()


def test_rows_of_one_place_add_up():
    r = np.random.default_rng(7)
    for at in (np.zeros((50, 2), np.int32), np.stack([np.arange(50), np.arange(50)[::-1]], 1).astype(np.int32), r.integers(0, 20, (50, 2)).astype(np.int32), np.minimum(r.geometric(0.1, (50, 2)), 59).astype(np.int32)):
        tables, rows = r.standard_normal((2, 60, 32)).astype(np.float32), r.standard_normal((50, 32)).astype(np.float32)
        want = tables.astype(np.float64)
        for k in range(2):
            np.add.at(want[k], at[:, k], rows.astype(np.float64))
        lm._add_rows(tables, at, rows)
        assert np.allclose(tables, want, atol=1e-5)
