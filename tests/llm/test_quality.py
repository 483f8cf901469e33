import re
from collections import Counter

import numpy as np
import pyarrow as pa

from termweave.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_statistics_equal_a_word_loop():
    texts = ["The quick, brown Fox: 42!\nthe the quick\n\nthe the quick", "", None, "É漢 | é漢 |", "one", " \n\t "]
    got = quality.statistics(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        visible = sum(len(w.encode()) for w in words)
        s = dict(zip(quality.STATS, row, strict=True))
        assert s["n_words"] == len(words) and s["word_bytes"] == visible / max(1, len(words))
        assert s["upper_share"] == sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) / max(1, visible)
        assert s["wide_share"] == sum(len(c.encode()) for c in text if ord(c) > 127) / max(1, visible)
        if words:
            assert s["distinct_share"] == len(set(words)) / len(words) and s["top_share"] == max(Counter(words).values()) / len(words)
            pairs = list(zip(words, words[1:], strict=False))
            assert s["pair_share"] == (len(set(pairs)) / len(pairs) if pairs else 1.0)
            assert s["repeat_share"] == (sum(a == b for a, b in pairs) / len(pairs) if pairs else 0.0)
        lines = [x.lower() for x in text.split("\n") if x]
        assert s["line_distinct"] == (len(set(lines)) / len(lines) if lines else 0.0)


def test_rules_and_compiled_column_agree(spark):
    r = np.random.default_rng(0)
    x = np.zeros((600, len(quality.STATS)))
    x[:, 0], x[:, 3], x[:, 5] = r.integers(0, 100, 600), r.random(600), r.random(600)
    y = ((x[:, 0] > 40) & (x[:, 3] < 0.6) | (x[:, 5] > 0.9)).astype(float)
    model = quality.fit(x, y)
    total = model.bias + sum(w * quality._holds(x, rule) for rule, w in model.rules)
    p = 1 / (1 + np.exp(-total))
    assert ((p >= 0.5) == y).mean() >= 0.95 and 0 < len(model.rules) < 400
    rows = spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"{c} double" for c in quality.STATS))
    got = [v.s for v in rows.coalesce(1).select(quality.score_column(model).alias("s")).collect()]
    assert np.allclose(sorted(got), sorted(p))


def test_odd_rows_one_class_and_empty_tables(spark):
    odd = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "w " * 100_000), (4, "é")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in odd], "doc_id long, text string, n_words int, label string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None), (77, 0)], "doc_id long, quality int")
    for chosen in (labels, labels.limit(0)):
        got = quality.score(docs, quality.train(docs, chosen)).collect()
        assert len(got) == len(odd) and len({r.score for r in got}) == 1 and 0 < got[0].score < 1
    kept = quality.keep_good(docs, labels, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(odd)
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).collect() == []


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op8_quality_classifier(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert all(p == (s >= 0.7) for s, p, _ in held)
    right = sum((s >= 0.5) == y for s, _, y in held) / len(held)
    assert len(held) > 20 and right >= 0.85, (right, len(held))
