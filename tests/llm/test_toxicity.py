import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from termweave.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def segments_by_recursion(scores):
    """The maximal segments by their definition: the best one, then the same on its left and right."""

    def best(a, b):
        found = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (found is None or total > found[2] + 1e-12 or abs(total - found[2]) <= 1e-12 and j - i < found[1] - found[0]):
                    found = (i, j, total)
        return found

    def run(a, b):
        if a >= b or (m := best(a, b)) is None:
            return []
        return run(a, m[0]) + [m] + run(m[1] + 1, b)

    return run(0, len(scores))


@given(st.lists(st.sampled_from([0.0, 0.0, 0.0, 1.03, 2.11, 0.57]), max_size=24))
@settings(max_examples=200, deadline=None)
def test_linear_scan_finds_the_maximal_segments(values):
    drift = 0.71
    at = [i for i, v in enumerate(values) if v > 0]
    got = [(at[a], at[b], s) for a, b, s in toxicity.maximal_segments(at, [values[i] for i in at], drift)]
    want = segments_by_recursion([v if v > 0 else -drift for v in values])
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def trained(spark):
    r = random.Random(1)
    clean, bad = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], ["scumlike", "vileness", "hateful", "brutish"]
    rows, labels = [], []
    for i in range(300):
        w = [r.choice(clean) for _ in range(40)]
        if i % 4 == 0:
            k = r.randrange(30)
            w[k : k + 6] = [r.choice(bad) for _ in range(6)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels, spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, score string, label double"), spark.createDataFrame([*labels, (None, 1), (5, None), (999, 1)], "doc_id long, toxic int")


def test_passages_scores_and_odd_rows(spark):
    rows, labels, docs, label_df = trained(spark)
    model = toxicity.train(docs, label_df)
    odd = [(1, None), (2, ""), (3, "Scumlike VILENESS hateful brutish scumlike hateful"), (3, "worda wordb"), (None, "wordcc " * 60_000), (4, "é漢 " * 500)]
    more = spark.createDataFrame([(i, t, "x", 0.5) for i, t in odd], "doc_id long, text string, score string, label double")
    got = toxicity.score(more, model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    high = [r for r in got if r.score >= 0.5]
    assert len(high) == 1 and high[0].doc_id == 3 and high[0].passages
    p = high[0].passages[0]
    assert odd[2][1].encode()[p.start_byte : p.end_byte].decode() == odd[2][1] and (p.first_word, p.last_word) == (0, 5)
    kept = toxicity.drop_toxic(more, label_df)
    assert kept.columns == more.columns  # drop_toxic trains on its own input, which holds no labelled toxic text but id 3
    found = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, model).collect()}
    assert sum(found[i] == bool(y) for i, y in labels) >= 0.97 * len(labels)


def test_one_class_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    for labels in (one, one.limit(0)):
        scores = {r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
        assert len(scores) == 1 and 0 < scores.pop() <= 0.5
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), one)).collect() == []


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op1_toxicity(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    right = sum(p == y for p, y in held) / len(held)
    assert len(held) > 20 and right >= 0.9, (right, len(held))


def test_evidence_is_the_same_in_any_batching():
    model = toxicity.Model(np.sort(toxicity.span_hashes(np.frombuffer(b"badword", np.uint8), np.array([0]), np.array([7]))), np.array([2.0]), 1.0, 1.0, np.zeros(3))
    texts = ["a badword b badword", None, "", "badword", "x " * 400_000 + "badword"]
    together = list(toxicity._evidence(model, pa.array(texts)))
    assert together == [x for t in texts for x in toxicity._evidence(model, pa.array([t], pa.string()))]
    assert [x[0] for x in together] == [4, 0, 0, 1, 400_001]
