"""Findings of the reviews, each with the case that failed."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from termweave import queries
from termweave.functions import analysis, kernels, scoring
from termweave.operators import cooc, graph, search
from termweave.operators.index import Field, Index, Spec, tokens

SF = "/root/testdata/sf0.001"
SIMPLE = Spec((Field("text", analyzer="simple"),))


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_fuzziness_bounds_the_distance(spark):
    """A commoner word two edits away does not replace one within the distance asked for."""
    i = Index.build(docs_of(spark, "license", "licensed", "licensed", "nothing"), SIMPLE)
    ask = lambda n: {"index_id": "i", "query": {"match": {"field": "text", "value": "licenxe", "fuzziness": n}}}
    ids = lambda n: sorted(r.doc_id for r in search.search(i, ask(n)).collect())
    assert ids(1) == [1] and ids(2) == [2, 3]


ODD = ["One two, three. Two one! face's face's facing _ faces", None, "", "...", "a. _ b", "x 1.5 é naïve; 2;3 x_y co-op", "same same same", "Running runs. The of THE running"]


def brute_pairs(texts, analyzer, window):
    """(term_a, term_b) to count and weight, by the exact analysis."""
    cnt, wsum = Counter(), Counter()
    for text in texts:
        if analyzer == "simple":
            found = analysis.regex.findall(rf"{analysis.WORD}|{analysis.BOUNDARY}", (text or "").lower())
            rows = [(w, sum(x in analysis.ENDS for x in found[:i])) for i, w in enumerate(found) if w not in analysis.ENDS]
        else:
            rows = [(t[0], t[4]) for t in analysis.standard_analyze(analysis.standard_tokens(text))]
        for i, (a, s) in enumerate(rows):
            kept = [x for x in rows[i:] if x[1] == s][1 : window + 1]
            for d, (b, _) in enumerate(kept, 1):
                if a != b:
                    cnt[min(a, b), max(a, b)] += 1
                    wsum[min(a, b), max(a, b)] += 1 / math.log2(1 + d)
    return {k: (n, round(wsum[k], 9)) for k, n in cnt.items()}


def test_pairs_are_summed_before_they_are_sent(spark, monkeypatch):
    """All pairs of odd texts, in several runs and buckets; no plan makes a row for each pair."""
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice("ab cd. ef gh! ij kl mn; op".split()) for _ in range(rng.randrange(40))) for _ in range(60)]
    monkeypatch.setattr(cooc, "BUCKET_BYTES", 2000)
    for name in ("simple", "standard"):
        found = cooc.document_pairs(docs_of(spark, *texts), Spec((Field("text", analyzer=name),)), 3)
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.term_a, r.term_b): (r.cnt, round(r.wsum, 9)) for r in found.collect()}
        assert got == brute_pairs(texts, name, 3)
        few = cooc.document_pairs(docs_of(spark, *texts), Spec((Field("text", analyzer=name),)), 3, least=3)
        assert {(r.term_a, r.term_b) for r in few.collect()} == {k for k, v in got.items() if v[0] >= 3}
        wide = cooc.document_pairs(docs_of(spark, *texts[:9]), Spec((Field("text", analyzer=name),)), kernels.MOST_WINDOW + 1)
        assert {(r.term_a, r.term_b): r.cnt for r in wide.collect()} == {k: v[0] for k, v in brute_pairs(texts[:9], name, kernels.MOST_WINDOW + 1).items()}


def test_pairs_of_shards_stay_apart(spark):
    rows = spark.createDataFrame([("s", 1, "a b"), ("t", 2, "a b b"), (None, 3, "a c")], "s string, doc_id long, text string")
    found = cooc.document_pairs(rows, Spec((Field("text", analyzer="simple"),), shard_column="s"), 2)
    assert sorted((r.shard_id or "", r.term_a, r.term_b, r.cnt) for r in found.collect()) == [("", "a", "c", 1), ("s", "a", "b", 1), ("t", "a", "b", 2)]


def test_window_counts(spark):
    """Counted inside the row: no join on places."""
    found = cooc.window_counts(docs_of(spark, *ODD), SIMPLE, 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {i: sum(n for n, _ in brute_pairs([t], "simple", 3).values()) for i, t in enumerate(ODD, 1)}
    assert {r.doc_id: r.n for r in found.collect()} == {k: n for k, n in want.items() if n}


def test_signs_do_not_hide_the_end_of_a_sentence(spark):
    """A word after an end and a lone _ begins a new sentence."""
    assert {(r.term, r.sentence) for r in tokens(docs_of(spark, "cat. _ dog"), Spec((Field("text"),))).collect()} == {("cat", 0), ("dog", 1)}


def test_postings_in_runs(spark, monkeypatch):
    """Runs of few tokens give all postings, sorted by shard and term within each; no row is shuffled."""
    monkeypatch.setattr(kernels, "RUN_TOKENS", 7)
    for name in ("simple", "standard"):
        cut = docs_of(spark, *ODD).select(F.lit("s").alias("shard_id"), F.col("doc_id"), analysis.items(F.col("text"), name).alias("items"))
        batches = cut.toArrow().to_batches(max_chunksize=2)
        runs = [b.to_pylist() for b in kernels.postings(name)(iter(batches))]
        assert len(runs) > 1 and all(r == sorted(r, key=lambda x: x["term"].encode()) for r in runs)
        want = {}
        for i, t in enumerate(ODD, 1):
            words = analysis.regex.findall(analysis.WORD, (t or "").lower())
            for w, at in enumerate_terms(words) if name == "simple" else [(x[0], x[1]) for x in analysis.standard_analyze(analysis.standard_tokens(t))]:
                want.setdefault((w, i), []).append(at)
        assert {(x["term"], x["doc_id"]): x["positions"] for r in runs for x in r} == want and sum(map(len, runs)) == len(want)
        lens = Counter(d for _, d in want)
        assert all(x["doc_len"] == lens[x["doc_id"]] and x["tf"] == len(x["positions"]) for r in runs for x in r)
        df = Counter()
        for b in kernels.frequencies(name)(iter(x.drop_columns(["doc_id"]) for x in batches)):
            df.update({x["term"]: x["df"] for x in b.to_pylist()})
        assert df == Counter(w for w, _ in want)
        plan = Index.build(docs_of(spark, *ODD), Spec((Field("text", analyzer=name),))).postings._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def enumerate_terms(words):
    return [(w, i) for i, w in enumerate(words, 1)]


def test_statistics_and_ranges_write_no_postings(spark):
    """Dictionary and range queries leave the index unwritten; their rows are those of the index."""
    for name in ("range_query", "terms_merge_df", "term_df"):
        queries.QUERIES[name](spark, SF).collect()
    assert not [k for k in queries._stored if SF in k and "index" in k]
    i = queries.text_index(spark, SF, "lang")
    assert sorted(map(str, i.term_stats.select("shard_id", "term", "df").collect())) == sorted(map(str, i.postings.groupBy("shard_id", "term").agg(F.count("*").alias("df")).collect()))
    assert sorted(map(str, i.shard_stats.collect())) == sorted(map(str, i.field_stats.select("shard_id", F.col("doc_count").alias("total_docs")).collect()))


def test_edges_come_from_one_evaluation(spark):
    """Both directions from one evaluation of the joins; the likelihood ratio's cells are computed once; weights are those of one expression."""
    sums = spark.createDataFrame([("s", "t", "a", "b", 3, 2.0), ("s", "t", "a", "c", 2, 2.0), ("s", "t", "b", "c", 9, 4.5), ("s", "t", "b", "x", 9, 4.5)], "shard_id string, field string, term_a string, term_b string, cnt long, wsum double")
    df = spark.createDataFrame([("s", "t", w, n) for w, n in (("a", 4), ("b", 40), ("c", 11))], "shard_id string, field string, term string, df long")
    total = spark.createDataFrame([("s", 100)], "shard_id string, total_docs long")
    for method in ("npmi", "llr", "dice"):
        e = cooc.edges(sums, df, total, method)
        plan = e._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan and plan.count("Join") == 3 and plan.lower().count("greatest(") <= 8
        got = {(r.src, r.dst): round(r.weight, 12) for r in e.collect()}
        want = {}
        for x, y, n, a, b, m in (("a", "b", 3, 4, 40, 2 / 3), ("b", "c", 9, 40, 11, 0.5)):
            args = [F.lit(v) for v in (n, a, b)]
            w = {"npmi": lambda: scoring.npmi_weight(*args, F.lit(100), F.lit(m)), "llr": lambda: scoring.llr_weight(*args, F.lit(100), F.lit(m)), "dice": lambda: scoring.dice_weight(*args, F.lit(m))}[method]()
            w = spark.range(1).select(w.alias("w")).first().w
            if w > 0:
                want[x, y] = want[y, x] = round(w, 12)
        assert got == want


def test_only_reached_nodes_are_ranked(spark, monkeypatch):
    """Spreading ranks the edges of the nodes it reaches, not those of the whole graph."""
    rows = [(f"n{i}", f"n{j}", 0.9 - j / 1000) for i in range(60) for j in (i + 1, i + 2)]
    seen, rank = [], graph.top_edges

    def counted(edges, *a):
        seen.append(edges.count())
        return rank(edges, *a)

    monkeypatch.setattr(graph, "top_edges", counted)
    found = graph.spread_activation(spark.createDataFrame(rows, "src string, dst string, weight double"), spark.createDataFrame([("n0",)], "start string"), hops=2, threshold=0.0)
    assert {r.node for r in found.collect()} == {"n1", "n2", "n3", "n4"} and seen == [2, 4]


def test_edge_queries_write_no_postings(spark):
    for name in ("npmi_edges", "export_graph"):
        queries.QUERIES[name](spark, SF).collect()
    assert not [k for k in queries._stored if SF in k and "index" in k]
