"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, scores documents.

Words of all documents are counted; the most frequent ones are the vocabulary, which grows with the
cube root of the number of words (side_of), and rarer words fall into hashed classes of rare words.
A rare word's probability is its class's times count / (class count + 1); a word that was not
counted takes 1 / (class count + 1), the share that the counted ones leave. Counts of the most
frequent words, KEPT at most, are broadcast; rarer words that a bitmap of bounded size says may occur
more than once meet their counts in a join (the others have log 1 = 0). The network sums position-specific embeddings of SIDE words on
each side of the masked one, applies tanh, and predicts it by a two-level softmax (a class of
words, then the word in the class). Every task trains a copy from one seeded start on its own
documents, on every place of each; copies are averaged by their numbers of places, block by block, in two
levels. A second pass predicts every word of every document from both sides and sums log p.

Cases: null and empty texts have n_words 0, sum_logp 0 and null mean; a single word is predicted
from padding; repeated rows are scored each; long texts are scored whole; an empty table gives no
rows; extra columns are not read; a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, bitmap, in_bitmap, materialize, mix, ship, span_hashes, text_slices, word_spans

#: The least size; side_of() gives the size for a corpus.
GROUPS = 32
MEMBERS = 32
VOCABULARY = GROUPS * MEMBERS
RARE = 64
KEPT = 1 << 19
#: Bits of the filter of rarer words that occur more than once.
LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 28
SIDE = 2
WIDTH = 32
BATCH = 4096
#: Places scored at once: their logits stay in a core's cache.
AT_ONCE = 1 << 13
#: Rows of one word that a step adds one by one, all words together; a word's further rows are added in a loop of their own.
ROUNDS = 8
#: A batch moves as so many places do.
PLACES = 64
RATE = 0.15
BLOCK = 16_384


def side_of(words: int) -> int:
    """Groups, and members of each, for a corpus of so many words."""
    return max(GROUPS, int(np.ceil(GROUPS * (words / 1e6) ** (1 / 6))))


def rare_of(side: int) -> int:
    """Classes of rare words: a power of two near a sixteenth of the ids."""
    return 1 << (side * side * RARE // VOCABULARY).bit_length() - 1


def _shapes(side: int) -> list[tuple[int, ...]]:
    return [(2 * SIDE, side * side + 1, WIDTH), (side, WIDTH), (side,), (side, side, WIDTH), (side, side)]


def start(side: int = GROUPS) -> list[np.ndarray]:
    """The seeded parameters that every task begins with."""
    random, shapes = np.random.default_rng(1), _shapes(side)
    return [(random.standard_normal(s) * (0.1 if len(s) > 1 and k < len(shapes) - 1 else 0.0)).astype(np.float32) for k, s in enumerate(shapes)]


def flat(params: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params])


def shaped(values: np.ndarray, side: int = GROUPS) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in _shapes(side)])
    return [x.reshape(s) for x, s in zip(np.split(values, ends[:-1]), _shapes(side), strict=True)]


def starts_of(known: np.ndarray) -> np.ndarray:
    """Where hashes with each value of their highest bits begin in known, which is sorted; two to four values a hash."""
    bits = len(known).bit_length() + 1
    return np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))


def find(h: np.ndarray, known: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in known, whether the hash is there): as a binary search, but in one or two steps, as hashes are spread evenly."""
    last = len(known) - 1
    if last < 0:
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(starts[(h >> np.uint64(65 - len(starts).bit_length())).astype(np.int64)], last)
    below = np.flatnonzero((known[at] < h) & (at < last))
    while len(below):
        at[below] += 1
        below = below[(known[at[below]] < h[below]) & (at[below] < last)]
    return at, known[at] == h


def word_ids(h: np.ndarray, known: np.ndarray, ids: np.ndarray, side: int = GROUPS, starts: np.ndarray | None = None) -> np.ndarray:
    """Vocabulary ids of word hashes; known is sorted, and starts are starts_of(known). Rare words take one of the last ids."""
    rare = rare_of(side)
    out = (side * side - rare + (h % np.uint64(rare)).astype(np.int64)).astype(np.int32)
    at, hit = find(h, known, starts_of(known) if starts is None else starts)
    out[hit] = ids[at[hit]]
    return out


def contexts(ids: np.ndarray, ptr: np.ndarray, side: int = GROUPS) -> np.ndarray:
    """(words, 2 * SIDE) ids of the words around each, padded with the id after all at document ends."""
    n = len(ids)
    first, last = np.repeat(ptr[:-1], np.diff(ptr)), np.repeat(ptr[1:], np.diff(ptr))
    out = np.full((n, 2 * SIDE), side * side, np.int32)
    for col, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        at = np.arange(n) + d
        ok = (at >= first) & (at < last)
        out[ok, col] = ids[at[ok]]
    return out


def hidden(params: list[np.ndarray], around: np.ndarray) -> np.ndarray:
    e = params[0]
    h = e[0].take(around[:, 0], axis=0)
    row = np.empty_like(h)
    for k in range(1, 2 * SIDE):
        h += e[k].take(around[:, k], axis=0, out=row, mode="clip")  # the other modes copy what they put out
    return np.tanh(h, out=h)


def _order(keys: np.ndarray, below: int) -> np.ndarray:
    """Stable order of keys in 0 .. below - 1; 16-bit keys are sorted by radix."""
    return np.argsort(keys.astype(np.uint16) if below <= 1 << 16 else keys, kind="stable")


def _bounded(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether no logit of a tanh layer can reach 60, so that its exponential needs no shift."""
    if max(w.max(), -w.min()) * w.shape[-1] + np.abs(b).max() < 60:  # the cheaper test
        return True
    return bool((np.abs(w) @ np.ones(w.shape[-1], w.dtype) + np.abs(b)).max() < 60)


def _logits(h: np.ndarray, w: np.ndarray, b: np.ndarray, bounded: bool) -> np.ndarray:
    z = h @ w.T
    z += b
    if not bounded:
        z -= z.max(axis=1, keepdims=True)
    return z


def _exp_sums(z: np.ndarray) -> np.ndarray:
    """Exponentials in place, and the sum of each row."""
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def _minus_softmax(z: np.ndarray) -> np.ndarray:
    """Minus the softmax of each row of logits, in place, with one exponential."""
    z *= (-1 / _exp_sums(z))[:, None]
    return z


def _member_logits(h: np.ndarray, wm: np.ndarray, bm: np.ndarray, ptr: list[int], bounded: bool) -> np.ndarray:
    """Logits of each row's own group; rows ptr[g] to ptr[g + 1] are of group g."""
    z = np.empty((len(h), bm.shape[1]), h.dtype)
    for g, (i, j) in enumerate(pairwise(ptr)):
        if i < j:
            np.matmul(h[i:j], wm[g].T, out=z[i:j])
            z[i:j] += bm[g]
    if not bounded:
        z -= z.max(axis=1, keepdims=True)
    return z


def log_p(params: list[np.ndarray], around: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each word given the words around it."""
    _, wg, bg, wm, bm = params
    groups, members = bm.shape
    low_g, low_m = _bounded(wg, bg), _bounded(wm, bm)

    def piece(around: np.ndarray, w: np.ndarray) -> np.ndarray:
        order = _order(w // members, groups)
        w = w[order]
        group, rows = w // members, np.arange(len(w))
        h = hidden(params, around.take(order, axis=0))
        ptr = np.searchsorted(group, np.arange(groups + 1)).tolist()
        z, m = _logits(h, wg, bg, low_g), _member_logits(h, wm, bm, ptr, low_m)
        p = z[rows, group].astype(np.float64) + m[rows, w % members]
        out = np.empty(len(w), np.float64)
        out[order] = p - np.log(_exp_sums(z).astype(np.float64)) - np.log(_exp_sums(m).astype(np.float64))
        return out

    return np.concatenate([np.zeros(0), *(piece(around[a : a + AT_ONCE], ids[a : a + AT_ONCE]) for a in range(0, len(ids), AT_ONCE))])


def _add_rows(tables: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """tables[k][at[:, k]] += rows for each k, where at may repeat; rows of one place are summed first."""
    many, places, width = tables.shape
    table = tables.reshape(-1, width, copy=False)
    orders = [_order(at[:, k], places) for k in range(many)]
    source = np.concatenate(orders)
    at = np.concatenate([at[order, k] + k * places for k, order in enumerate(orders)])
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
    size, cut = cut[1:] - cut[:-1], cut[:-1]
    by = np.argsort(-np.minimum(size, ROUNDS + 1).astype(np.int8), kind="stable")  # the most repeated first
    size, cut = size[by], cut[by]
    sums = rows.take(source[cut], axis=0)
    for r in range(1, ROUNDS):
        upto = np.count_nonzero(size > r)
        sums[:upto] += rows.take(source[cut[:upto] + r], axis=0)
    upto = np.count_nonzero(size > ROUNDS)
    if upto:
        left = size[:upto] - ROUNDS
        first = np.cumsum(left) - left
        more = rows.take(source[np.arange(left.sum()) + np.repeat(cut[:upto] + ROUNDS - first, left)], axis=0)
        # two floats at a time, as a complex number
        sums[:upto] += np.add.reduceat(more.view(np.complex64), first, axis=0).view(np.float32)
    table[at[cut]] += sums


def train_step(params: list[np.ndarray], around: np.ndarray, ids: np.ndarray, rate: float) -> None:
    """One step of gradient ascent on the mean log probability, in place."""
    e, wg, bg, wm, bm = params
    groups, members = bm.shape
    low_g, low_m = _bounded(wg, bg), _bounded(wm, bm)
    order = _order(ids // members, groups)
    ids, around = ids[order], around.take(order, axis=0)
    n, group = len(ids), ids // members
    rows = np.arange(n)
    ptr = np.searchsorted(group, np.arange(groups + 1)).tolist()
    h = hidden(params, around)
    scale = np.float32(rate / n * PLACES)  # frequent words are in many places of a batch
    scales, step = np.full(n, scale), h * scale
    dz = _minus_softmax(_logits(h, wg, bg, low_g))
    dz.reshape(-1)[rows * groups + group] += 1
    dh = dz @ wg
    wg += dz.T @ step
    bg += scales @ dz
    dm = _minus_softmax(_member_logits(h, wm, bm, ptr, low_m))
    dm.reshape(-1)[rows * members + ids % members] += 1
    for g, (i, j) in enumerate(pairwise(ptr)):
        if i < j:
            part = dm[i:j]
            dh[i:j] += part @ wm[g]
            wm[g] += part.T @ step[i:j]
            bm[g] += scales[: j - i] @ part
    h *= h
    np.subtract(1, h, out=h)
    dh *= h
    dh *= scale
    _add_rows(e, around, dh)


def _count(docs: DataFrame) -> DataFrame:
    """word (hash), n: each task adds up its own words before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            return words, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def out(words: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(words), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 65_536].view(np.int64)), pa.array(n[a : a + 65_536])], ["word", "n"])

        for b in batches:
            for _, _, buf, offsets in text_slices(b.column(0)):
                s, e, _ = word_spans(buf, offsets, NON_SPACE)
                if len(s):
                    held.append(np.unique(span_hashes(buf, s, e), return_counts=True))
                    size += len(held[-1][0])
                if size > 2_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*merged())

    return docs.selectExpr("cast(text as string) as text").mapInArrow(run, "word long, n long")


def counted(docs: DataFrame) -> DataFrame:
    """word (hash), n over all of docs, kept as a table."""
    return materialize(_count(docs).groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


def _top(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words above the least frequency that at most `most` words have, by rank.

    The threshold comes from a histogram of the counts (a few thousand rows), so no task and not the
    driver ever holds more than `most` words, whatever the number of partitions.
    """
    level = F.when(F.col("n") <= 1024, F.col("n")).otherwise(F.floor(F.log2(F.col("n") / 1024) * 64) + 1024)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()  # at most 1024 + 64 * 54 rows
    least, total = None, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        total += r["words"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counts.where(level >= least).select("word", "n").toArrow()  # two longs a word
    word, n = top["word"].to_numpy(), top["n"].to_numpy()
    order = np.lexsort((word, -n))
    return word[order].view(np.uint64), n[order]


def vocabulary(docs: DataFrame, counts: DataFrame | None = None, side: int = GROUPS, top: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, ids) of the most frequent words; ids follow frequency ranks. top: words by rank, if known."""
    h = _top(counted(docs) if counts is None else counts, KEPT)[0] if top is None else top
    h = h[: side * side - rare_of(side)]
    order = np.argsort(h)
    return h[order], order.astype(np.int32)


def train(docs: DataFrame, known: np.ndarray, ids: np.ndarray, side: int = GROUPS) -> list[np.ndarray]:
    """Parameters averaged over the tasks; see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        params, starts, seen = start(side), starts_of(known), 0
        wait: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def learn(rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
            around, w = (np.concatenate(x) for x in zip(*rows, strict=True))
            mixed = np.random.default_rng(len(w)).permutation(len(w))
            for a in range(0, len(w), BATCH):
                at = mixed[a : a + BATCH]
                train_step(params, around.take(at, axis=0), w.take(at), RATE)

        for b in batches:
            for _, _, buf, offsets in text_slices(b.column(0)):
                s, e, ptr = word_spans(buf, offsets, NON_SPACE)
                h = span_hashes(buf, s, e)
                w = word_ids(h, known, ids, side, starts)
                wait.append((contexts(w, ptr, side), w))
                waiting += len(w)
                seen += len(w)
                if waiting >= 32 * BATCH:
                    learn(wait)
                    wait, waiting = [], 0
        if waiting:
            learn(wait)
        if seen:
            values, part = flat(params), TaskContext.get().partitionId()
            cuts = range(0, len(values), BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(cuts), pa.int32()), pa.array(range(len(cuts)), pa.int32()), pa.array([seen] * len(cuts), pa.float64()), pa.array([values[a : a + BLOCK].tobytes() for a in cuts], pa.binary())],
                ["part", "block", "weight", "items"],
            )

    def mean(g: pd.DataFrame) -> pd.DataFrame:
        total, acc = float(g.weight.sum()), 0.0
        for w, x in zip(g.weight, g["items"], strict=True):
            acc = acc + np.frombuffer(x, np.float32).astype(np.float64) * (w / total)
        return pd.DataFrame([(int(g.part.iloc[0]) % 64, int(g.block.iloc[0]), total, acc.astype(np.float32).tobytes())], columns=["part", "block", "weight", "items"])

    schema = "part int, block int, weight double, items binary"
    copies = docs.selectExpr("cast(text as string) as text").mapInArrow(run, schema)
    halfway = copies.groupBy("block", (F.col("part") % 64).alias("p64")).applyInPandas(mean, schema)
    blocks = halfway.groupBy("block").applyInPandas(mean, schema).toPandas().sort_values("block")  # one model's size
    if blocks.empty:
        return start(side)
    return shaped(np.concatenate([np.frombuffer(x, np.float32) for x in blocks["items"]]), side)


def score(docs: DataFrame, params: list[np.ndarray], known: np.ndarray, ids: np.ndarray, counts: DataFrame | None = None, kept: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """doc_id, n_words, sum_logp, mean_logp, pseudo_perplexity for every row; counts are those of docs if not given."""
    counts = counted(docs) if counts is None else counts
    side = len(params[2])
    rare = rare_of(side)
    top, top_n = _top(counts, KEPT) if kept is None else kept
    in_class = np.zeros(rare, np.int64)
    # hashes are 64 bits without a sign and rare is a power of two, so the lowest bits are the class
    for c, n in counts.groupBy(F.col("word").bitwiseAND(F.lit(rare - 1)).alias("c")).agg(F.sum("n").alias("n")).collect():
        in_class[c] = n
    ours = np.isin(top, known)
    np.subtract.at(in_class, (top[ours] % np.uint64(rare)).astype(np.int64), top_n[ours])
    beyond = counts.where((F.col("n") > 1) & (F.col("n") <= int(top_n.min(initial=1 << 62))))  # all that top may lack
    bits = bitmap(beyond, F.col("word"), LEAST_SLOTS, MOST_SLOTS)
    order = np.argsort(top)
    # of fixed size but for params, known and ids, which grow as side_of() has it
    model = docs.sparkSession.sparkContext.broadcast((params, known, ids, top[order], np.log(top_n[order]), np.log(in_class + 1.0), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A record for each row, with a word that is no word, and one for each word in it that is outside top and may occur more than once."""
        params, known, ids, top, log_n, log_class, bits = model.value
        starts, top_starts = starts_of(known), starts_of(top)
        uid = TaskContext.get().partitionId() << 33
        names = ["uid", "doc_id", "n_words", "sum_logp", "word", "times"]

        def far(uids: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(uids), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(uids), none, none, pa.array(np.zeros(len(uids))), pa.array(words.view(np.int64)), pa.array(np.ones(len(uids), np.int32))], names)

        for b in batches:
            counts, sums = [], []
            for row, upto_row, buf, offsets in text_slices(b.column(1)):
                s, e, ptr = word_spans(buf, offsets, NON_SPACE)
                h = span_hashes(buf, s, e)
                w = word_ids(h, known, ids, side, starts)
                p = log_p(params, contexts(w, ptr, side), w)
                at = np.flatnonzero(w >= side * side - rare)
                if len(at):
                    p[at] -= log_class[w[at] - (side * side - rare)]
                    k, hit = find(h[at], top, top_starts)
                    p[at[hit]] += log_n[k[hit]]
                    far_at = at[~hit]
                    far_at = far_at[in_bitmap(bits, (h[far_at] & np.uint64(8 * len(bits) - 1)).astype(np.int64))]
                    of = np.repeat(np.arange(row, upto_row), np.diff(ptr))[far_at]
                    words = h[far_at]
                    for a in range(0, len(of), 65_536):
                        yield far(uid + of[a : a + 65_536], words[a : a + 65_536])
                upto = np.concatenate([[0.0], np.cumsum(p)])
                counts.append(np.diff(ptr))
                sums.append(upto[ptr[1:]] - upto[ptr[:-1]])
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            total = np.where(n > 0, np.concatenate(sums), 0.0) if counts else np.zeros(0)
            uids = uid + np.arange(len(n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids), b.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(mix(uids.astype(np.uint64)).view(np.int64)), pa.array(np.zeros(len(n), np.int32))], names
            )
            uid += len(n)

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    rows = rows.mapInArrow(run, "uid long, doc_id long, n_words long, sum_logp double, word long, times int")
    rows = rows.join(counts.where("n > 1"), "word", "left")  # a word that occurred once adds log 1
    rows = rows.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum(F.col("sum_logp") + F.col("times") * F.log(F.coalesce("n", F.lit(1)))).alias("sum_logp")
    )
    mean = F.when(F.col("n_words") > 0, F.col("sum_logp") / F.col("n_words"))
    return rows.select("doc_id", "n_words", "sum_logp", mean.alias("mean_logp")).withColumn("pseudo_perplexity", F.exp(-F.col("mean_logp")))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Count, train and score over all of docs."""
    ship(docs.sparkSession)
    counts = counted(docs)
    side = side_of(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    kept = _top(counts, KEPT)
    known, ids = vocabulary(docs, counts, side, kept[0])
    return score(docs, train(docs, known, ids, side), known, ids, counts, kept)
