"""Toxicity by maximum-scoring segments over token log-odds, calibrated by extreme-value theory.

Training (bounded: MAX_LABEL_ROWS labelled documents, the lowest by hash of doc_id): counts of
letter words and of their first bytes (PREFIXES), at most COUNT_CAP of each in a document (a word
said a hundred times is one habit) and each group of near copies having one vote, give log-odds with
an informative Dirichlet prior; features whose z-score reaches MIN_Z form the lexicon (at most
LEXICON_SIZE, a bound of the model that is shipped to tasks). A word scores as its best feature;
every other word costs the drift: DRIFT, or more where clean words would else gain on average.
Karlin-Altschul lambda solves sum p * exp(lambda * s) = 1, where p is the share of the clean
documents' words with score s, counted in a scan of them; K follows from the segments seen there.

Scoring: one linear scan per document finds all maximal segments. A segment of score S among n
words has E = K * n * exp(-lambda * S); passages with E <= MAX_E are reported. The document's
score is a logistic function of its best and its summed -ln E, fitted on the same labelled rows.

Cases: null and empty texts have no segments and get the score of a document without evidence;
labels that are null or whose document is missing are not used; of several texts with one doc_id the
smallest trains; labels of one class only, or none,
give the smoothed share of label 1 for every document; repeated rows are scored each; long texts
are scanned whole, in one slice each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, materialize, mix, ship, span_hashes, text_slices, word_spans

MAX_LABEL_ROWS = 20_000
LEXICON_SIZE = 20_000
PRIOR = 40.0
PREFIXES = (7, 5)
COUNT_CAP = 8
MIN_Z = 3.0
DRIFT = 0.2
MAX_E = 0.05


@dataclass
class Model:
    """Lexicon (sorted hashes and scores), lambda, K, logistic weights (bias, best, summed) and drift."""

    words: np.ndarray
    scores: np.ndarray
    lam: float
    k: float
    weights: np.ndarray
    drift: float = DRIFT


def held_out_by(doc_id: Column, parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, rest: int, most: int) -> DataFrame:
    """doc_id, text, label of at most `most` training rows: the lowest hashes of doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out_by(F.col("doc_id"), parts, rest)).dropDuplicates(["doc_id"])
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(rows), "doc_id")  # at most `most` pairs of numbers
    # one text per id, aggregated before the shuffle: repeats of an id are no more training rows
    return found.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def maximal_segments(at: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score); first and last index the given hits.

    Hits lie at ascending word positions with positive scores, all words between cost drift. Linear:
    each kept candidate remembers the nearest one on its left that starts lower (Ruzzo-Tompa).
    """
    kept: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, None
    for k, (p, s) in enumerate(zip(at, score, strict=True)):
        if last is not None:
            total -= (p - last - 1) * drift
        last = p
        first, low = k, total
        total += s
        high = total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((first, k, low, high, j))
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def _features(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words, then of each length of prefix; 0 where a word is not longer."""
    out = [span_hashes(buf, start, end)]
    for n in PREFIXES:
        longer = end - start > n
        out.append(np.where(longer, span_hashes(buf, start, np.minimum(start + n, end)) ^ np.uint64(n), np.uint64(0)))
    return out


def _training_rows(rows: DataFrame) -> DataFrame:
    """label, near (a one-hash key that near copies share), tokens and counts of the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, counts, near = [], [], []
            for _, _, buf, offsets in text_slices(b.column(1)):
                s, e, ptr = word_spans(buf, offsets, LETTERS)
                kinds = _features(buf, s, e)
                for x, y in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
                    w = kinds[0][x:y]
                    found, n = np.unique(np.concatenate([k[x:y] for k in kinds]), return_counts=True)
                    tokens.append(found[found != 0].view(np.int64))
                    counts.append(np.minimum(n, COUNT_CAP)[found != 0])
                    grams = mix(w[:-2] + mix(w[1:-1] + mix(w[2:]))) if len(w) > 2 else w
                    near.append(int(grams.min().view(np.int64)) if len(grams) else 0)
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.int64()), pa.array(tokens, many), pa.array(counts, many)], ["label", "near", "tokens", "counts"])

    return rows.select("label", "text").mapInArrow(run, "label int, near long, tokens array<long>, counts array<long>")


def _word_values(model: Model, column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """For each slice of texts: word starts and ends, words before each text, text offsets, scores of the words (0: no feature)."""
    gate = np.zeros(1 << 16, bool)
    gate[(model.words & np.uint64(0xFFFF)).astype(np.int64)] = True
    for _, _, buf, offsets in text_slices(column):
        s, e, ptr = word_spans(buf, offsets, LETTERS)
        value = np.zeros(len(s))
        for h in _features(buf, s, e) if len(model.words) else ():
            maybe = np.flatnonzero(gate[(h & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(model.words, h[maybe]), len(model.words) - 1)
            known = model.words[place] == h[maybe]
            np.maximum.at(value, maybe[known], model.scores[place[known]])
        yield s, e, ptr, offsets, value


def _evidence(model: Model, column: pa.Array) -> Iterator[tuple[int, float, float, list[dict]]]:
    """For each text: words, best and summed -ln E of its segments, significant passages."""
    for s, e, ptr, offsets, value in _word_values(model, column):
        hits = np.flatnonzero(value)
        bounds = np.searchsorted(hits, ptr)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            n = int(ptr[i + 1] - ptr[i])
            if a == b:
                yield n, 0.0, 0.0, []
                continue
            at = (hits[a:b] - ptr[i]).tolist()
            found, values = [], []
            for x, y, total in maximal_segments(at, value[hits[a:b]].tolist(), model.drift):
                log_e = float(np.log(model.k) + np.log(n) - model.lam * total)
                values.append(max(0.0, -log_e))
                if log_e <= np.log(MAX_E):
                    found.append({"first_word": at[x], "last_word": at[y], "start_byte": int(s[hits[a + x]] - offsets[i]), "end_byte": int(e[hits[a + y]] - offsets[i]), "score": total, "e_value": float(np.exp(log_e))})
            yield n, max(values), float(sum(values)), found


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights, bias first; a slope that would be negative is left out and the rest fitted again."""
    use = list(range(x.shape[1]))
    while True:
        z = np.column_stack([np.ones(len(x)), x[:, use]])
        penalty = np.diag([1e-4] + [ridge] * len(use))

        def loss(beta: np.ndarray, z: np.ndarray = z, penalty: np.ndarray = penalty) -> float:
            t = z @ beta
            return float((np.logaddexp(0, t) - y * t).sum() + beta @ penalty @ beta / 2)

        beta = np.zeros(z.shape[1])
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ beta)
            rate, now = 1.0, loss(beta)
            while rate > 1e-6 and loss(beta + rate * step) > now:
                rate /= 2
            beta = beta + rate * step
            if np.abs(rate * step).max() < 1e-8:
                break
        worst = int(np.argmin(beta[1:])) if use else 0
        if not use or beta[1 + worst] >= 0:
            out = np.zeros(1 + x.shape[1])
            out[0], out[[1 + k for k in use]] = beta[0], beta[1:]
            return out
        del use[worst]


def _signal(best: np.ndarray, summed: np.ndarray) -> np.ndarray:
    return np.log1p(np.column_stack([best, summed]))


def _score_shares(rows: DataFrame, model: Model) -> tuple[np.ndarray, float]:
    """(share of all words that have each lexicon score, share of words without one) in the texts of rows."""
    values = np.unique(model.scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(values) + 1, np.int64)
        for b in batches:
            for *_, value in _word_values(model, b.column(0)):
                n += np.bincount(np.where(value > 0, np.searchsorted(values, value) + 1, 0), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["at", "n"])

    found = rows.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # a row per score
    n = np.zeros(len(values) + 1)
    n[found["at"].to_numpy()] = found["n"].to_numpy()
    share = n / max(n.sum(), 1.0)
    return share[1:], float(share[0])


def _lambda(values: np.ndarray, p: np.ndarray, rest: float, drift: float) -> float:
    """The positive root of sum p * exp(lambda * s) = 1; the expected score must be negative."""
    total = lambda lam: float((p * np.exp(lam * values)).sum() + rest * np.exp(-lam * drift))
    low, high = 0.0, 1.0
    while total(high) < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return max(low, 1e-6)

def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, rest: int = 0, most: int = MAX_LABEL_ROWS) -> Model:
    """Fit lexicon, lambda, K and logistic weights; see the module's text."""
    ship(docs.sparkSession)
    chosen = materialize(labelled(docs, labels, label, parts, rest, most), "toxtrain")
    rows = materialize(_training_rows(chosen), "toxtokens")
    votes = rows.groupBy("near", "label").agg(F.count("*").alias("n"))
    totals = {r.label: (r.v, r.n) for r in votes.groupBy("label").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()}
    (v1, n1), (v0, n0) = totals.get(1, (0, 0)), totals.get(0, (0, 0))
    share = (n1 + 0.5) / (n1 + n0 + 1)
    flat = Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    if not v1 or not v0:
        return flat
    words = rows.join(F.broadcast(votes), ["near", "label"]).select("label", (1 / F.col("n")).alias("v"), F.explode(F.arrays_zip("tokens", "counts")).alias("t"))  # at most MAX_LABEL_ROWS votes
    vote = lambda c: F.sum(F.when(F.col("label") == c, F.col("v") * F.col("t.counts")).otherwise(0.0))
    counts = materialize(words.groupBy(F.col("t.tokens").alias("word")).agg(vote(1).alias("y1"), vote(0).alias("y0")), "toxcounts")
    sums = counts.agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")).first()
    prior = PRIOR * (sums.y1 + sums.y0) / (v1 + v0)  # as many tokens as PRIOR documents have
    counts = counts.withColumn("a", F.lit(prior / max(sums.y1 + sums.y0, 1.0)) * (F.col("y1") + F.col("y0")))
    odds = lambda y: F.log((F.col(y) + F.col("a")) / (F.lit(float(sums[y]) + prior + 1e-9) - F.col(y) - F.col("a")))
    scored = counts.withColumn("d", odds("y1") - odds("y0")).withColumn("z", F.col("d") / F.sqrt(1 / (F.col("y1") + F.col("a")) + 1 / (F.col("y0") + F.col("a"))))
    lexicon = scored.where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").limit(LEXICON_SIZE).select("word", "d", "y0", "a").toPandas()
    if lexicon.empty:
        return flat
    lexicon["word"] = lexicon.word.to_numpy().view(np.uint64)
    lexicon = lexicon.sort_values("word")
    model = Model(lexicon.word.to_numpy(), np.maximum(lexicon.d.to_numpy(), 0.1), 1.0, 1.0, flat.weights)
    p, rest = _score_shares(chosen.where("label = 0"), model)
    values = np.unique(model.scores)
    model.drift = max(DRIFT, 2 * float(p @ values) / max(rest, 0.5))
    model.lam = _lambda(values, p, rest, model.drift)
    tokens = materialize(_scored(chosen, model, extra=["label"]), "toxscan")
    clean = tokens.where("label = 0").agg(F.sum("n_words").alias("n")).first().n or 1
    level = float(model.scores.min())
    seen = tokens.where("label = 0").select(F.explode("passages").alias("p")).where(F.col("p.score") >= level).count()
    model.k = (seen + 0.5) / clean * float(np.exp(min(model.lam * level, 600)))
    fit = _scored(chosen, model, extra=["label"]).select("label", "best", "summed").toPandas()
    signal = _signal(fit.best.to_numpy(), fit.summed.to_numpy())
    model.weights = _logistic(signal, fit.label.to_numpy(float))
    return model


_PASSAGES = "array<struct<first_word:int,last_word:int,start_byte:int,end_byte:int,score:double,e_value:double>>"


def _scored(docs: DataFrame, model: Model, extra: list[str]) -> DataFrame:
    """extra columns, n_words, best, summed, score, passages for every row of docs."""
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("start_byte", pa.int32()), ("end_byte", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
    names = [*extra, "n_words", "best", "summed", "score", "passages"]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(_evidence(model, b.column(len(extra))))
            best, summed = np.array([x[1] for x in found]), np.array([x[2] for x in found])
            z = model.weights[0] + _signal(best, summed) @ model.weights[1:] if len(found) else np.zeros(0)
            cols = [pa.array([x[0] for x in found], pa.int64()), pa.array(best, pa.float64()), pa.array(summed, pa.float64()), pa.array(1 / (1 + np.exp(-z)), pa.float64()), pa.array([x[3] for x in found], kind)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(extra))), *cols], names)

    schema = ", ".join([*(f"{c} {fields[c]}" for c in extra), f"n_words long, best double, summed double, score double, passages {_PASSAGES}"])
    return docs.select(*extra, "text").mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), n_words, best (-ln E), passages for every row of docs."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scored(rows, model, ["doc_id"]).select("doc_id", "score", "n_words", "best", "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under the threshold, with their own columns."""
    model = train(docs, labels)
    ship(docs.sparkSession)
    names = docs.columns
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(_evidence(model, b.column(text_at).cast(pa.string())))
            z = model.weights[0] + _signal(np.array([x[1] for x in found]), np.array([x[2] for x in found])) @ model.weights[1:] if found else np.zeros(0)
            yield b.filter(pa.array(1 / (1 + np.exp(-z)) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
