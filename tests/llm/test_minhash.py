import random
import re

import pytest

from termweave.llm import minhash


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}


def components(rows, words, percent):
    """{doc_id: (set size, smallest reachable id)} by comparing all pairs; rows share no ids."""
    sets = {i: shingles(t, words) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    r = random.Random(5)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    out, n = [], 1000
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice([3, 30, 60, 120]))]
        for _ in range(8):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(words)
            out.append((n, (" " if r.random() < 0.5 else "\n").join(w)))
            n -= r.choice([1, 3])
    base = [r.choice(words) for _ in range(80)]
    for k in range(40):  # a chain: neighbours are linked, its ends share nothing
        out.append((5000 + k, " ".join(base)))
        base = [*base[3:], *(r.choice(words) for _ in range(3))]
    same = " ".join(r.choice(words) for _ in range(50))
    out += [(6000 + k, same.upper() if k % 2 else same) for k in range(30)]
    out += [(7000, None), (7001, ""), (7002, " \t\n"), (7003, "one two"), (7004, "ONE  two"), (7005, "one"), (7006, "x " * 3000)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("words", "tile"), [(4, 1024), (5, 3)])
def test_components_equal_brute_force(spark, monkeypatch, words, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rep string, size int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words, 80).collect()}
    assert got == components(rows, words, 80)


def test_repeated_rows_null_ids_and_keep_one(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(3, text), (3, text), (None, text), (None, None), (9, text + " b"), (4, "alone here"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, key int")
    found = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert found == [(0, 0, True), (0, 0, True), (3, 3, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (9, 3, False)]
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 3, 4, 5, 6]


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_star_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 7), (1, 2), (2, 1)], "a long, b long")
    got = {r.node: r.component for r in minhash.star_components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 2: 1}


def test_reused_ids_are_one_document(spark):
    """Two texts of one doc_id: each keeps its own links, and neither is dropped for the other's sake."""
    words = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    rows = [(1, words("a", 60)), (1, words("b", 60)), (2, words("b", 60) + " more"), (3, words("c", 60)), (4, words("a", 60)), (5, words("d", 60)), (5, words("d", 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 1), (5, 5)}
    kept = sorted((r.doc_id, r.text[:2]) for r in minhash.keep_one(docs).collect())
    assert kept == [(1, "a0"), (1, "b0"), (3, "c0"), (5, "d0")]


@pytest.mark.parametrize("tile", [3, 1024])
def test_tiles_equal_brute_force(spark, monkeypatch, tile):
    """Every open bucket goes through tiles."""
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "FEW", 1)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 4, 80).collect()}
    assert got == components(rows, 4, 80)


def near_copies(n):
    """n texts of 100 words, 0 to 9 of them changed: some are linked with many, some with none."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(100)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(10)):
            w[r.randrange(100)] = f"x{r.randrange(40)}"
        out.append((i, " ".join(w)))
    return out


def test_large_group_of_near_copies(spark):
    rows = near_copies(500)
    want = components(rows, 4, 80)
    assert 1 < len({c for _, c in want.values()}) < 400
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == want


def test_pairs_that_were_compared_meet_no_more(spark, monkeypatch):
    """Buckets of two texts under 80 percent are decided by their one comparison, larger small ones in pairs, not in tiles."""
    seen, tiles = [], minhash._tile_rows
    monkeypatch.setattr(minhash, "_tile_rows", lambda placed: seen.append(placed.count()) or tiles(placed))
    r = random.Random(4)
    rows = []
    for k in range(0, 200, 2):
        w = [f"a{r.randrange(10**6)}" for _ in range(60)]
        rows += [(k, " ".join(w)), (k + 1, " ".join([*w[:52], *(f"b{r.randrange(10**6)}" for _ in range(8))]))]  # 49 shingles of 65
    rows += [(1000 + i, t) for i, t in near_copies(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs, 4, 80).collect()}
    assert got == components(rows, 4, 80) and all(got[k][1] == k for k in range(200))
    assert sum(seen) == 0
