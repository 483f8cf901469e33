"""Near-duplicate documents: MinHash, banding, verification, alternating large-star / small-star.

1. One pass over the texts hashes each document's distinct word shingles and takes 128 minima of
   universal hashes a * x + b; 32 bands of 4 minima miss a pair at similarity 0.8 with a
   probability of 5e-8.
2. Documents of equal shingle sets are one class; only its smallest doc_id goes on. So thousands of
   exact copies cost one row.
3. In every band bucket each member is paired with one centre, the member that shares most buckets
   with others, never with all others. Pairs whose signatures agree enough are confirmed on the full
   sets.
4. Buckets whose members other than the centre, which has met them all, still are of different
   components are finished exactly. Up to FEW members meet in pairs, each pair once however many buckets
   it shares. More members meet in tiles of about 2 x TILE rows: those outside a bucket's largest
   component meet one another and that component, whose members need not meet again. A tile first
   compares signatures and passes on only members with a likely partner in another component; then full
   sets decide, and a tile emits only links that join components. No link between components is lost.
5. Components come from large-star / small-star rounds on the links, all as DataFrames.

Cases: null or empty texts have no shingles, are linked with nothing and are their own component;
texts with fewer words than a shingle are one shingle; repeated rows fall into one class; several
texts of one doc_id are one document, linked with what any of them is linked with; rows with
a null doc_id are never linked, their component_id is null and they are kept; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NON_SPACE, bitmap, in_bitmap, materialize, mix, ship, span_hashes, text_slices, word_spans

WORDS = 5
PERCENT = 80
BANDS = 32
BAND_ROWS = 4
#: Signatures must agree on this share before full sets are compared: 5.6 standard deviations below 0.8.
AGREE = 0.60
TILE = 1024
#: A bucket of at most so many members beside its centre is paired in full, without tiles.
FEW = 32
#: Entries of the table that bounds common shingles within a tile.
MARKS = 1 << 20
#: Bits of the id filter, of which a power of two is taken by the number of ids: 2 MB to 32 MB.
LEAST_SLOTS, MOST_SLOTS = 1 << 24, 1 << 28
MAX_ROUNDS = 60
_RANDOM = np.random.default_rng(7)
_A = _RANDOM.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, 1024, dtype=np.uint64)
_STEP = np.random.default_rng(11).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_AT_ONCE = 1 << 15


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, ascending (uint64)."""
    for _, _, buf, offsets in text_slices(column):
        s, e, ptr = word_spans(buf, offsets, NON_SPACE)
        h = span_hashes(buf, s, e)
        n = max(0, len(h) - words + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(words):
            rolled += mix(h[j : j + n] * _STEP[j])
        rolled = mix(rolled)
        for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                yield mix(np.sum(mix(h[a:b] * _STEP[: b - a]), keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def set_digest(items: np.ndarray) -> bytes | None:
    """128 bits of a whole set; None of an empty one."""
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minima per non-empty set, as uint32; sets are processed in cache-sized groups."""
    out = np.full((len(sets), n), np.uint32(0xFFFFFFFF))
    group: list[int] = []
    size = 0

    def flush() -> None:
        x = np.concatenate([sets[i] for i in group])
        ptr = np.concatenate([[0], np.cumsum([len(sets[i]) for i in group])[:-1]])
        t = np.empty_like(x)
        for k in range(n):
            np.multiply(x, _A[k], out=t)
            t += _B[k]
            out[group, k] = np.minimum.reduceat(t, ptr) >> np.uint64(32)

    for i, x in enumerate(sets):
        if len(x):
            group.append(i)
            size += len(x)
            if size >= _AT_ONCE:
                flush()
                group, size = [], 0
    if group:
        flush()
    return out


def sketch(docs: DataFrame, words: int, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set; null if empty), sig binary (band after band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 512):
                piece = b.slice(part, 512)
                sets = list(shingle_sets(piece.column(1), words))
                sig = signatures(sets, bands * rows)
                live = [len(x) > 0 for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([set_digest(x) for x in sets], pa.binary()),
                        pa.array([x.tobytes() if ok else None for x, ok in zip(sig, live, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_key", "sig"],
                )

    schema = "doc_id long, n_shingles long, set_key binary, sig binary"
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, words: int, ids: DataFrame) -> DataFrame:
    """node, items: the shingle hashes, as binary, of the classes in ids (node, doc_id, set_key).

    The texts are filtered by a bitmap of bounded size where they are read, so that they are not
    shuffled; a join with ids then settles the bitmap's false hits and texts of one id that differ.
    """
    held = bitmap(ids, F.xxhash64("doc_id"), LEAST_SLOTS, MOST_SLOTS)
    bits = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b.column(2).to_numpy()
            b = b.filter(pa.array(in_bitmap(bits.value, slot), pa.bool_()))
            for part in range(0, b.num_rows, 512):
                piece = b.slice(part, 512)
                sets = list(shingle_sets(piece.column(1), words))
                cols = [piece.column(0), pa.array([set_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "set_key", "items"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(len(held) * 8)))
    found = rows.mapInArrow(run, "doc_id long, set_key binary, items binary").join(ids, ["doc_id", "set_key"])
    return found.select("node", "items").dropDuplicates(["node"])  # repeated rows have one set


def _agree(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, np.uint32) == np.frombuffer(b, np.uint32)).mean())


def _linked(a: bytes, b: bytes, percent: int) -> bool:
    """100 * |A & B| >= percent * |A | B|, in integers."""
    n, m = len(a) // 8, len(b) // 8
    if 100 * min(n, m) < percent * max(n, m):
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, m - 1)] == x).sum())
    return 100 * both >= percent * (n + m - both)


def _keep_pairs(pairs: DataFrame, test: str, percent: int) -> DataFrame:
    """Pairs (a, b) with columns x, y: those whose signatures agree or whose sets are linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = [_agree(x, y) >= AGREE if test == "sig" else _linked(x, y, percent) for x, y in zip(p.x, p.y, strict=True)]
            yield p.loc[np.array(ok, bool), ["a", "b"]]

    return pairs.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def _with_both(pairs: DataFrame, values: DataFrame, key: str, col: str) -> DataFrame:
    x = values.select(F.col(key).alias("a"), F.col(col).alias("x"))
    y = values.select(F.col(key).alias("b"), F.col(col).alias("y"))
    return pairs.join(x, "a").join(y, "b")


def star_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Alternates large-star and small-star until a round changes nothing; every round is written to
    the shared folder, so a lost executor costs one round.
    """

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    # a > b throughout
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(e)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = materialize(small, "star")
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


_TILE_KEY = ["key", "low", "high", "kind"]


def _tile_rows(placed: DataFrame) -> DataFrame:
    """Members (key, doc, component) of open buckets, dealt into tiles (key, low, high, kind), with block.

    kind 0: blocks low and high of the members outside the largest component; kind 1: such a block
    (low) against a block (high) of the largest component.
    """
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    sums = counts.groupBy("key").agg(F.sum("n").alias("total"), F.max(F.struct("n", "component")).alias("top"))
    rows = placed.join(sums, "key").withColumn("minor", F.col("component") != F.col("top.component"))
    blocks = lambda n: F.ceil(n / TILE).cast("int")
    rows = rows.withColumn("mb", blocks(F.col("total") - F.col("top.n"))).withColumn("tb", blocks(F.col("top.n")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(3)), F.when(F.col("minor"), F.col("mb")).otherwise(F.col("tb"))).cast("int"))
    own, upto = F.col("block"), lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    tile = lambda low, high, kind: F.struct(low.alias("low"), high.alias("high"), F.lit(kind).alias("kind"))
    minors = F.concat(F.transform(upto("mb"), lambda j: tile(F.least(own, j), F.greatest(own, j), 0)), F.transform(upto("tb"), lambda j: tile(own, j, 1)))
    tiles = F.when(F.col("minor"), minors).otherwise(F.transform(upto("mb"), lambda j: tile(j, own, 1)))
    side = F.when(F.col("minor"), F.lit(0)).otherwise(F.lit(1))
    rows = rows.select("key", "doc", "component", "block", side.alias("side"), F.explode(tiles).alias("t"))
    return rows.select("key", "t.low", "t.high", "t.kind", "doc", "component", "block", "side")


def _tile_pairs(g: pd.DataFrame) -> Callable[[int], np.ndarray]:
    """For row i of a tile, which later rows of another component the tile compares with it."""
    comp, kind = g.component.to_numpy(), g["kind"].iloc[0]
    by = g["side"].to_numpy() if kind == 1 else g["block"].to_numpy() if g["low"].iloc[0] != g["high"].iloc[0] else None

    def of(i: int) -> np.ndarray:
        other = comp[i + 1 :] != comp[i]
        return other if by is None else other & (by[i + 1 :] != by[i])

    return of


_ROW = "key long, low int, high int, kind int, doc long, component long, block int, side int"


def _likely_rows(members: DataFrame) -> DataFrame:
    """The tile rows with at least one partner of another component whose signature agrees."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.reset_index(drop=True)
        sig, of = np.stack([np.frombuffer(x, np.uint16)[::2] for x in g.sig]), _tile_pairs(g)
        ok = np.zeros(len(g), bool)
        for i in range(len(g) - 1):
            j = i + 1 + np.flatnonzero(of(i))
            j = j[np.count_nonzero(sig[j] == sig[i], axis=1) >= AGREE * sig.shape[1]]
            if len(j):
                ok[i] = True
                ok[j] = True
        return g.loc[ok, columns]

    columns = [x.split()[0] for x in _ROW.split(", ")]
    return members.select(*columns, "sig").groupBy(*_TILE_KEY).applyInPandas(run, _ROW)


def _tile_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components within each tile, enough to join them.

    A row meets all its partners at once: a table of MARKS low bits of its hashes gives each of them a
    number of common shingles that is never too small, and only pairs that it lets through, of rows
    that earlier links have not joined, are compared in full.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("doc").reset_index(drop=True)
        items, doc, of = g["items"].tolist(), g.doc.tolist(), _tile_pairs(g)
        label = g.component.to_numpy().copy()
        codes = [(np.frombuffer(x, np.uint64) & np.uint64(MARKS - 1)).astype(np.uint32) for x in items]
        n = np.array([len(x) for x in codes])
        table, out = np.zeros(MARKS, bool), []
        for i in range(len(g) - 1):
            m = n[i + 1 :]
            partners = i + 1 + np.flatnonzero(of(i) & (label[i + 1 :] != label[i]) & (100 * np.minimum(n[i], m) >= percent * np.maximum(n[i], m)))
            table[codes[i]] = True
            for at in range(0, len(partners), 256):
                j = partners[at : at + 256]
                both = np.add.reduceat(table[np.concatenate([codes[k] for k in j])], np.concatenate([[0], np.cumsum(n[j])[:-1]]), dtype=np.int64)
                for k in j[100 * both >= percent * (n[i] + n[j] - both)].tolist():
                    if label[k] != label[i] and _linked(items[i], items[k], percent):
                        label[label == label[k]] = label[i]
                        out.append((doc[i], doc[k]))
            table[codes[i]] = False
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return members.groupBy(*_TILE_KEY).applyInPandas(run, "a long, b long")


def _few_pairs(few: DataFrame) -> DataFrame:
    """(a, b), a > b: members (key, doc, component) of one bucket that are of different components, each pair once."""
    both = few.groupBy("key").agg(F.collect_list(F.struct("doc", "component")).alias("m"))  # FEW members at most
    of = lambda x, m: F.transform(F.filter(m, lambda y: (y.doc < x.doc) & (y.component != x.component)), lambda y: F.struct(x.doc.alias("a"), y.doc.alias("b")))
    return both.select(F.explode(F.flatten(F.transform("m", lambda x: of(x, F.col("m"))))).alias("p")).select("p.a", "p.b").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; see the module's text."""
    ship(docs.sparkSession)
    known = materialize(sketch(docs, words), "sketch")
    classes = materialize(known.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    # a class goes by its smallest doc_id; where one id has several texts, all but one of its classes go by a number above it
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("set_key"))
    more = F.col("rep") + 1 + F.xxhash64("set_key").bitwiseAND(F.lit((1 << 40) - 1))
    classes = materialize(classes.withColumn("nth", nth).select("set_key", "rep", F.when(F.col("nth") == 1, F.col("rep")).otherwise(more).alias("node")), "nodes")
    mine = classes.select("node", F.col("rep").alias("doc_id"), F.col("set_key").alias("key"))
    reps = known.join(mine, "doc_id").where("key = set_key").groupBy("node").agg(F.first("doc_id").alias("doc_id"), F.first("set_key").alias("set_key"), F.first("sig").alias("sig"))
    reps = materialize(reps, "reps")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.col("sig").substr(i * (4 * BAND_ROWS) + 1, F.lit(4 * BAND_ROWS)), i))
    rows = reps.select(F.col("node").alias("doc"), F.explode(bands).alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    crowd = materialize(rows.join(buckets, "key"), "buckets")
    social = crowd.groupBy("doc").agg(F.sum("size").alias("degree"))
    centres = crowd.join(social, "doc").groupBy("key").agg(F.max(F.struct("degree", "doc")).alias("c")).select("key", F.col("c.doc").alias("centre"))
    signed = materialize(reps.join(social.select(F.col("doc").alias("node")), "node", "left_semi"), "signed")
    others = materialize(crowd.join(centres, "key").where("doc <> centre").select("key", "doc", "centre", "size"), "others")
    pairs = others.select(F.greatest("doc", "centre").alias("a"), F.least("doc", "centre").alias("b")).distinct()
    likely = materialize(_keep_pairs(_with_both(pairs, signed, "node", "sig"), "sig", percent), "likely")

    def sets_of(nodes: DataFrame) -> DataFrame:
        return full_sets(docs, words, materialize(signed.select("node", "doc_id", "set_key").join(nodes, "node", "left_semi"), "wanted"))

    ids = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    links = materialize(_keep_pairs(_with_both(likely, materialize(sets_of(ids), "sets"), "node", "items"), "set", percent), "links")
    stars = materialize(star_components(links), "components")

    # buckets of more than one component beside the centre, whose pairs are all decided; each set of members once
    at = others.where("size > 2").join(stars.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    at = materialize(at, "placed")
    mark = F.struct(F.sum(F.xxhash64("doc").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("doc", F.lit(1))), F.count("*"))
    open_ = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), mark.alias("mark"), F.count("*").alias("members")).where("lo <> hi")
    open_ = open_.groupBy("mark").agg(F.min("key").alias("key"), F.first("members").alias("members")).select("key", "members")
    opened = materialize(at.join(open_, "key"), "open")
    found = stars.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if not opened.isEmpty():  # else no bucket has members of two components
        fresh = _few_pairs(opened.where(F.col("members") <= FEW)).join(likely, ["a", "b"], "left_anti")
        near = materialize(_keep_pairs(_with_both(fresh, signed, "node", "sig"), "sig", percent), "near")
        tiles = _tile_rows(opened.where(F.col("members") > FEW).drop("members"))
        some = materialize(_likely_rows(tiles.join(signed.select(F.col("node").alias("doc"), "sig"), "doc")), "some")
        ids = near.select(F.col("a").alias("node")).union(near.select("b")).union(some.select("doc")).distinct()
        items = materialize(sets_of(ids), "opensets")
        found = found.unionByName(materialize(_keep_pairs(_with_both(near, items, "node", "items"), "set", percent), "few"))
        found = found.unionByName(materialize(_tile_links(some.join(items.withColumnRenamed("node", "doc"), "doc"), percent), "more"))
    # the classes of one id are one document
    final = star_components(found.unionByName(classes.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))))
    placed = classes.join(final, "node", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = known.select("doc_id", "n_shingles", "set_key").join(placed, "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose document is its group's smallest doc_id; others go, and so do repeats of a row's id and text.

    Different texts of one doc_id all stay, as none of them is a copy by its id alone.
    """
    found = near_duplicates(docs, words, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text"), F.length("text")).orderBy("text"))
    return kept.withColumn("_nth", nth).where("_nth = 1").select(*docs.columns).unionByName(docs.where("doc_id is null"))
