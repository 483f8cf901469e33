"""Quality classifier: a sparse ensemble of rules over document statistics (RuleFit).

Statistics are counted over each whole text in one byte-level pass. Boosted trees of depth 3 over a
bounded sample of labelled rows (MAX_LABEL_ROWS, the lowest hashes of doc_id) supply rules: every
node's path is a conjunction of thresholds. L1-penalised logistic regression keeps few of them. The
rules left are compiled into one Spark column over the statistics, so scoring stays in codegen.

Cases: null and empty texts have zero statistics and get a score like any other; null labels and
labels without a document are not used; labels of one class, or none, give the smoothed share of
label 1 to all; repeated rows are scored each; equal statistics share one vote in training; very
long texts are counted whole; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, _table, mix, ship, span_hashes, text_slices, word_spans
from .toxicity import labelled

MAX_LABEL_ROWS = 20_000
TREES = 40
DEPTH = 3
BINS = 48
RATE = 0.25
LEAF_SHARE = 0.002
L1 = 5e-4

_CLASSES = {
    "upper": _table((0x41, 0x5A)),
    "lower": _table((0x61, 0x7A)),
    "digit": _table((0x30, 0x39)),
    "stop": _table((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B)),
    "bang": _table((0x21, 0x21), (0x3F, 0x3F)),
    "symbol": _table((0x23, 0x26), (0x2A, 0x2B), (0x2F, 0x2F), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7E)),
    "pipe": _table((0x7C, 0x7C)),
    "wide": _table((0x80, 0xFF)),
    "line": _table((0x0A, 0x0A)),
}
STATS = ["n_words", "word_bytes", *(f"{c}_share" for c in _CLASSES), "distinct_share", "top_share", "pair_share", "line_distinct", "repeat_share"]
_NOT_LINE = ~_table((0x0A, 0x0A))


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATS per text."""
    out = []
    for _, _, buf, offsets in text_slices(column):
        n = len(offsets) - 1
        s, e, ptr = word_spans(buf, offsets, NON_SPACE)
        h = span_hashes(buf, s, e)
        lengths = np.concatenate([[0], np.cumsum(e - s)])
        visible = (lengths[ptr[1:]] - lengths[ptr[:-1]]).astype(float)
        rows = np.zeros((n, len(STATS)))
        words = np.diff(ptr).astype(float)
        rows[:, 0] = words
        rows[:, 1] = visible / np.maximum(words, 1)
        for k, members in enumerate(_CLASSES.values()):
            upto = np.concatenate([[0], np.cumsum(members[buf], dtype=np.int64)])
            rows[:, 2 + k] = (upto[offsets[1:]] - upto[offsets[:-1]]) / np.maximum(visible, 1)
        ls, le, lptr = word_spans(buf, offsets, _NOT_LINE)
        lines = span_hashes(buf, ls, le)
        at = 2 + len(_CLASSES)
        for i in range(n):
            w, t = h[ptr[i] : ptr[i + 1]], lines[lptr[i] : lptr[i + 1]]
            if len(w):
                _, c = np.unique(w, return_counts=True)
                rows[i, at], rows[i, at + 1] = len(c) / len(w), c.max() / len(w)
                rows[i, at + 2] = len(np.unique(mix(w[:-1]) + w[1:])) / (len(w) - 1) if len(w) > 1 else 1.0
                rows[i, at + 4] = (w[1:] == w[:-1]).mean() if len(w) > 1 else 0.0
            if len(t):
                rows[i, at + 3] = len(np.unique(t)) / len(t)
        out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, len(STATS)))


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, then one double column per statistic."""
    ship(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = statistics(b.column(len(keep)))
            cols = [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *cols], [*keep, *STATS])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} double" for c in STATS)])
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


#: A rule: for each statistic used (low, high], either side possibly infinite.
Rule = tuple[tuple[int, float, float], ...]


@dataclass
class Model:
    """Bias and weighted rules."""

    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)


def _grow(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, hess: np.ndarray, w: np.ndarray, least: float) -> tuple[np.ndarray, list[Rule]]:
    """One Newton-boosted tree: (its output on the rows, the paths of all its nodes)."""
    output, rules = np.zeros(len(g)), []

    def node(rows: np.ndarray, box: dict[int, tuple[float, float]], depth: int) -> None:
        best, gg, hh = (1e-6, None, None), g[rows].sum(), hess[rows].sum()
        if depth < DEPTH:
            for k in range(bins.shape[1]):
                m = len(cuts[k]) + 1
                cg = np.bincount(bins[rows, k], g[rows], m).cumsum()[:-1]
                ch = np.bincount(bins[rows, k], hess[rows], m).cumsum()[:-1]
                cw = np.bincount(bins[rows, k], w[rows], m).cumsum()[:-1]
                gain = cg**2 / (ch + 1) + (gg - cg) ** 2 / (hh - ch + 1) - gg**2 / (hh + 1)
                gain[(cw < least) | (w[rows].sum() - cw < least)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), k, int(gain.argmax()))
        if box:
            rules.append(tuple(sorted((k, a, b) for k, (a, b) in box.items())))
        if best[1] is None:
            output[rows] = gg / (hh + 1)
            return
        _, k, at = best
        a, b = box.get(k, (-np.inf, np.inf))
        left = bins[rows, k] <= at
        node(rows[left], box | {k: (a, float(cuts[k][at]))}, depth + 1)
        node(rows[~left], box | {k: (float(cuts[k][at]), b)}, depth + 1)

    node(np.arange(len(g)), {}, 0)
    return output, rules


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for k, a, b in rule:
        ok &= (x[:, k] > a) & (x[:, k] <= b)
    return ok


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Rules from boosted trees, weights by FISTA on the L1-penalised logistic loss."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not 0 < y.sum() < len(y):
        return Model(float(np.log(share / (1 - share))))
    _, group, n = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    w = 1.0 / n[group.ravel()]
    w *= len(w) / w.sum()
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)])
    base = np.log(np.average(y, weights=w) / (1 - np.average(y, weights=w)))
    score, rules = np.full(len(y), base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        output, found = _grow(bins, cuts, w * (y - p), w * p * (1 - p), w, max(3.0, LEAF_SHARE * len(y)))
        score += RATE * output
        rules.update(dict.fromkeys(found))
    names = list(rules)
    r = np.column_stack([_holds(x, rule) for rule in names]).astype(np.float32)
    mean = np.average(r, axis=0, weights=w)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4)).astype(np.float32)
    z = (r - mean.astype(np.float32)) / scale
    wf = (w / w.sum()).astype(np.float32)
    v = np.full(z.shape[1], 1.0, np.float32)
    for _ in range(20):
        v = z.T @ (wf * (z @ v))
        v /= np.linalg.norm(v) + 1e-12
    step = 4 / (float(v @ (z.T @ (wf * (z @ v)))) * 1.1 + 1)
    beta, bias, t = np.zeros(z.shape[1], np.float32), float(base), 1.0
    ahead, ahead_bias = beta.copy(), bias
    for _ in range(400):
        p = 1 / (1 + np.exp(-(z @ ahead + ahead_bias)))
        d = wf * (p - y)
        new = ahead - step * (z.T @ d)
        new = (np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)).astype(np.float32)
        new_bias = ahead_bias - step * float(d.sum())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - beta), new_bias + (t - 1) / t_new * (new_bias - bias)
        beta, bias, t = new, new_bias, t_new
    weight = beta / scale
    kept = [(rule, float(b)) for rule, b in zip(names, weight, strict=True) if abs(b) > 1e-6]
    return Model(float(bias - (weight * mean).sum()), kept)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, rest: int = 2, most: int = MAX_LABEL_ROWS) -> Model:
    """Fit on the bounded sample of labelled rows that are not held out."""
    rows = with_statistics(labelled(docs, labels, label, parts, rest, most), ["label"]).toPandas()  # at most `most` rows of numbers
    return fit(rows[STATS].to_numpy(float), rows.label.to_numpy(float))


def score_column(model: Model) -> Column:
    """The ensemble as one column over the statistics."""
    total = F.lit(model.bias)
    for rule, weight in model.rules:
        test = F.lit(True)
        for k, a, b in rule:
            if a > -np.inf:
                test &= F.col(STATS[k]) > a
            if b < np.inf:
                test &= F.col(STATS[k]) <= b
        total += F.when(test, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and the statistics for every row of docs."""
    rows = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    return rows.select("doc_id", score_column(model).alias("score"), *STATS)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score at least the threshold, with their own columns."""
    model = train(docs, labels)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    return with_statistics(rows, names).where(score_column(model) >= threshold).select(*names).toDF(*docs.columns)
