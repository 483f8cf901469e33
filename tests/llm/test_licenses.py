import random
import re

import duckdb
import pandas as pd

from termweave.llm import licenses

BSD = licenses.TEMPLATES[8][1]
ODD = [
    (1, None), (2, ""), (3, "..."), (4, "MIT License, Apache License; gnu general public license"), (4, "MIT License, Apache License; gnu general public license"),
    (None, "released under the MIT\nlicense"), (5, f"x {BSD.upper()} y"), (6, BSD.replace("source", "sauce")), (7, BSD.replace("provided", "supplied")),
    (8, "the licensed general license public"), (9, "é mit license" + " filler" * 20_000 + " apache license"), (10, "mit-license mit  license"), (11, "licenser mit licensed"),
    (12, "This work is licensed under the GNU General Public License, version 3."), (13, "mit license " * 500),
]


def frame(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, word string, pos int")


def test_base_columns_equal_a_word_loop(spark):
    rows = licenses.scan(frame(spark).repartition(3)).collect()
    assert len(rows) == len(ODD)
    want = []
    for i, t in ODD:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = sorted((k, label) for label, p in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        starts = [k for k, _ in at]
        want.append((i, len(w), len(at), starts[0] if at else None, starts[-1] if at else None, ",".join(sorted({x for _, x in at}))))
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=key) == sorted(want, key=key)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].labels == "bsd" and by_id[5].score == 1.0
    assert by_id[6].labels == ""  # the key phrase is broken
    assert by_id[7].labels == "bsd" and 0.6 <= by_id[7].score < 1
    assert by_id[8].labels == "" and by_id[12].labels == "gpl"


def test_scan_equals_sql(spark):
    got = licenses.scan(frame(spark)).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(ODD, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = con.execute(licenses.oracle()).df()
    tidy = lambda d: sorted(tuple(None if pd.isna(x) else round(float(x), 9) if isinstance(x, float) else x for x in r) for r in d[list(got.columns)].assign(doc_id=d.doc_id.fillna(-1), first_word=d.first_word.fillna(-1), last_word=d.last_word.fillna(-1)).itertuples(index=False))
    assert tidy(got) == tidy(want)


def test_no_python_in_the_plan_and_empty_table(spark):
    plan = licenses.scan(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert licenses.scan(frame(spark).limit(0)).collect() == []


def test_openers_lie_in_the_key_phrase():
    for (t, first, p1, second, p2), (_, _, size, at, n) in zip(licenses.openers(), licenses.template_rows(), strict=True):
        words = licenses.TEMPLATES[t][1].split()
        assert len(words) == size and words[p1] == first and words[p2] == second and p1 != p2
        assert at <= min(p1, p2) and max(p1, p2) < at + n


def test_many_passages_equal_sql(spark):
    """Random joins of three and four passages, some with words lost or changed, against the SQL that has no openers."""
    r = random.Random(3)
    texts = []
    for k in range(120):
        words = " x ".join(p for _, p, _ in r.sample(licenses.TEMPLATES, 3 + k % 2)).split()
        for _ in range(k % 5):
            words[r.randrange(len(words))] = r.choice(["license", "the", "zzz", "gnu"])
        texts.append((k, " ".join(words)))
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(texts, columns=["doc_id", "text"]))
    want = con.execute(licenses.oracle()).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_every_passage_is_found_beside_all_others_and_common_prose(spark):
    prose = "are as at can for it code conditions deal files following form "
    texts = [" x ".join(p for _, p, _ in licenses.TEMPLATES), *(prose + p for _, p, _ in licenses.TEMPLATES)]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: set(r.labels.split(",")) for r in rows}
    assert got[0] == {x for x, _, _ in licenses.TEMPLATES}
    assert all(x in got[k + 1] for k, (x, _, _) in enumerate(licenses.TEMPLATES))
