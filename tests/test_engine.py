"""Engine functions against the fixtures' values and brute force."""

import datetime
import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from termweave.functions import analysis, porter2, scalars, scoring
from termweave.operators import cooc, graph, hydrate, sharding, terms
from termweave.operators.index import Field, Index, Spec, tokens
from termweave.plans import catalog, request


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("word", "stem"), [("moisturizing", "moistur"), ("organization", "organ"), ("shelves", "shelv"), ("running", "run"), ("skies", "sky"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("by", "by")])
def test_stems(word, stem):
    assert porter2.stem(word) == stem


@pytest.mark.parametrize(("text", "want"), [("face&body", ["face", "bodi"]), ("urns,cats,dogs", ["urn", "cat", "dog"]), ("a.b", []), ("mois(", ["moi"]), ("the is at for", [])])
def test_split_terms(text, want):
    assert [t[0] for t in analysis.standard_analyze(analysis.whitespace_tokens(text))] == want


def test_sentences(spark):
    text = "Pi is 3.14 here. Next one! Last?"
    t = analysis.standard_tokens(text)
    assert [(x[0], x[4]) for x in t] == [("pi", 0), ("is", 0), ("3.14", 0), ("here", 0), ("next", 1), ("one", 1), ("last", 2)]
    rows = spark.createDataFrame([(1, text), (2, "..."), (3, None), (4, "a.b c;d e.g. 1;2 v.2")], "doc_id long, text string")
    got = [(r.doc_id, r.sentence, [x.term for x in r.tokens]) for r in analysis.sentence_rows(rows, "text", ("doc_id",)).orderBy("doc_id", "sentence").collect()]
    assert got == [(1, 0, ["pi", "is", "3", "14", "here"]), (1, 1, ["next", "one"]), (1, 2, ["last"]), (4, 0, ["a", "b", "c"]), (4, 1, ["d", "e", "g"]), (4, 2, ["1", "2", "v"]), (4, 3, ["2"])]


def test_standard_columns_equal_the_exact_analysis(spark):
    """Terms, positions and sentences of the Column path are those of Unicode word segmentation, on real texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).select("doc_id", "text")
    want = {(r.doc_id, r.term, r.position, r.sentence) for r in analysis.exact_tokens(docs, "doc_id", "text").collect()}
    toks = tokens(docs, Spec((Field("text"),)))
    assert {(r.doc_id, r.term, r.position, r.sentence) for r in toks.collect()} == want


def test_standard_postings(spark):
    docs = spark.createDataFrame([(1, "The runner's running; runs, run. face&body"), (2, None), (3, "the")], "doc_id long, text string")
    i = Index.build(docs, Spec((Field("text"),)))
    got = {(r.term, r.doc_id): (r.tf, r.doc_len, r.positions) for r in i.postings.collect()}
    want = {}
    for t in analysis.standard_analyze(analysis.standard_tokens(docs.first().text)):
        want.setdefault((t[0], 1), []).append(t[1])
    assert got == {k: (len(v), len(want), v) for k, v in want.items()}
    assert i.field_stats.first().total_len == len(want) and i.shard_stats.first().total_docs == 1


def test_words_are_cut_once(spark):
    """No plan evaluates the text's words above the row that cuts them, nor filters on what derives from them."""
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for field in (Field("text", analyzer="simple"), Field("text")):
        plan = Index.build(docs, Spec((field,))).postings._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(lower(text") == 1
    for plan in (tokens(docs, Spec((Field("text", analyzer="simple"),))), cooc.document_pairs(docs, Spec((Field("text", analyzer="simple"),)), 3)):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(lower(text") == 1


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "bac", 1), ("kitten", "sitting", 3), ("headlihgt", "headlight", 1), ("", "ab", 2), ("ab", "ba", 1), ("same", "same", 0)])
def test_edit_distance(a, b, d):
    assert scalars.osa_distance(a, b) == d


def test_hash_dates_and_json(spark):
    for text in ("", "a", "customer#1", "é漢"):
        assert one(spark, scalars.fnv1a(F.lit(text))) == scalars.fnv1a_python(text)
    day = one(spark, F.date_format(scalars.shard_date(F.lit("2025-11-24T15:04:05Z")), "yyyy-MM"))
    assert day == "2025-11"
    ms = str(int(datetime.datetime(2025, 11, 24, tzinfo=datetime.UTC).timestamp() * 1000))
    assert one(spark, scalars.date_bucket(scalars.shard_date(F.lit(ms)), "day")) == "2025-11-24"
    assert one(spark, scalars.sanitize_key(F.lit(" US East/1 "))) == "us-east-1"
    payload = json.dumps({"a": " x ", "b": 1.50, "c": True, "d": None})
    assert [one(spark, scalars.json_value(F.lit(payload), k)) for k in "abcde"] == ["x", "1.5", "true", "", ""]


@pytest.mark.parametrize(("value", "kind"), [("12", "long"), ("1.5", "float"), ("true", "boolean"), ('"TRUE"', "boolean"), ('"2024-02-03"', "date"), ('"2024-99-03"', "keyword"), ('"word"', "keyword"), ('"three whole words"', "text"), ('"two words"', "keyword"), ("null", "keyword"), ("[]", "keyword"), ('{"a":1}', "object")])
def test_type_inference(spark, value, kind):
    assert one(spark, scalars.infer_type(F.lit(value))) == kind


@pytest.mark.parametrize(("text", "want"), [("3", 3), (" 4 ", 4), ("5.0", 5), ("5.5", None), ("x", None), (None, 0), ("true", None)])
def test_integers(spark, text, want):
    got = one(spark, scalars.coerce_integer(F.lit(text).cast("string")))
    assert got.value == want and (got.error is None) == (want is not None)


def test_scores(spark):
    idf = lambda df: one(spark, scoring.idf(F.lit(10_000), F.lit(df)))
    assert 5 < idf(10) < 8 and 0 < idf(5000) < 1 and 8 < idf(1) < 12 and idf(0) == 0
    assert one(spark, scoring.ordering_boost(F.array(F.lit(1), F.lit(2), F.lit(4)))) == pytest.approx(1 + 0.5 * (1 + 0.5) / 2)
    assert [one(spark, scoring.decay(F.lit(d))) for d in (1, 3)] == [1.0, 0.5]
    assert one(spark, scoring.decay(F.lit(5))) == pytest.approx(1 / math.log2(6))


@pytest.fixture(scope="module")
def index(spark):
    rows = [(1, "Hello foo hello"), (2, "hello world"), (3, None), (4, ""), (5, "headlight headline"), (6, "headlight heavyduty world")]
    return Index.build(spark.createDataFrame(rows, "doc_id long, text string"), Spec((Field("text", analyzer="simple"),)))


def test_postings(index):
    got = {(r.term, r.doc_id): (r.tf, r.doc_len, r.positions) for r in index.postings.collect()}
    assert got["hello", 1] == (2, 2, [1, 3]) and got["world", 6] == (1, 3, [3]) and len(got) == 9
    assert {r.term: r.df for r in index.term_stats.collect()}["headlight"] == 2
    assert index.shard_stats.first().total_docs == 4


def test_dictionary(index):
    names = lambda df: [r.term for r in df.collect()]
    assert names(terms.fuzzy(index.term_stats, "text", "heaslight", 1)) == ["headlight"]
    assert sorted(names(terms.by_prefix(index.term_stats, "text", "head"))) == ["headlight", "headline"]
    assert names(terms.listed(index.term_stats, "text", 1, 2)) == ["headlight", "headline"]


def test_index_round_trip(index, spark, tmp_path):
    index.write(str(tmp_path / "i"))
    back = Index.read(spark, str(tmp_path / "i"), index.spec)
    assert sorted(map(str, back.postings.select(*index.postings.columns).collect())) == sorted(map(str, index.postings.collect()))


def test_pairs_both_ways(spark):
    docs = spark.createDataFrame([("s", "t", 1, "a b a c b"), ("s", "t", 2, "a"), ("s", "t", 3, "")], "shard_id string, field string, doc_id long, text string")
    by_row = cooc.document_pairs(docs.withColumnRenamed("shard_id", "s"), Spec((Field("text", analyzer="simple"),), shard_column="s"), 2)
    toks = docs.select("shard_id", "field", "doc_id", F.lit(0).alias("sentence"), F.posexplode(analysis.simple_words(F.col("text"))).alias("at", "term"))
    by_join = cooc.pairs(cooc.pair_rows(toks, 2))
    tidy = lambda d: sorted((r.term_a, r.term_b, r.cnt, round(r.wsum, 9)) for r in d.collect())
    words, want = "a b a c b".split(), {}
    for i in range(5):
        for j in range(i + 1, min(5, i + 3)):
            if words[i] != words[j]:
                k = tuple(sorted((words[i], words[j])))
                n, w = want.get(k, (0, 0.0))
                want[k] = (n + 1, w + 1 / math.log2(1 + j - i))
    assert tidy(by_row) == tidy(by_join) == sorted((*k, n, round(w, 9)) for k, (n, w) in want.items())


def test_spread_and_decay(spark):
    e = spark.createDataFrame([("A", "B", 0.9), ("B", "C", 0.8), ("A", "D", 0.5), ("B", "A", 0.9)], "src string, dst string, weight double")
    assert {r.node: round(r.weight, 4) for r in graph.spread(e, "A", 2).collect()} == {"B": 0.63, "C": 0.3528, "D": 0.35}
    act = graph.spread_activation(e, spark.createDataFrame([("A",)], "start string"), hops=2, threshold=0.36)
    assert {r.node: round(r.energy, 4) for r in act.collect()} == {"B": 0.63}
    assert {r.dst: r.weight for r in graph.decayed(e.where("src = 'A'").unionByName(spark.createDataFrame([("A", "Z", 0.001)], e.schema)), 0.5).collect()} == {"B": 0.45, "D": 0.25}
    new = spark.createDataFrame([("A", "B", 0.1)], e.schema)
    assert graph.upsert(e, new).where("src = 'A' and dst = 'B'").first().weight == 0.1


def test_requests_are_checked():
    ok = request.parse({"index_id": " i ", "query": {"match": {"field": "title^100", "value": " x "}}})
    assert (ok.query.boost, ok.query.value, ok.limit) == (100.0, "x", 20)
    term = {"term": {"field": "f", "value": "v"}}
    for bad in ({"query": term}, {"index_id": "i", "query": {}}, {"index_id": "i", "query": term, "limit": 1000}, {"index_id": "i", "query": term, "filters": [{"match": {"field": "f", "value": "v"}}]}):
        with pytest.raises(request.ValidationError):
            request.parse(bad)


def test_catalog_versions_and_modes():
    c = catalog.Catalog()
    c.create(catalog.Definition("i", catalog.Mapping((Field("t"),))))
    assert c.process("i", {"n": "long", "t": "keyword"}).version == 2
    with pytest.raises(request.ValidationError):
        c.process("i", {"n": "text"})
    c.set_mode("i", "strict")
    with pytest.raises(request.ValidationError):
        c.process("i", {"fresh": "long"})


def test_shards_and_hydration(spark):
    s = sharding.Sharding("computed", fields=("region", "tier"))
    df = spark.createDataFrame([(1, "US East", "prod")], "id long, region string, tier string")
    assert df.select(sharding.shard_key(s, F.col("id"), F.col).alias("k")).first().k == "us-east-prod"
    docs = spark.createDataFrame([("doc-1", "a"), ("doc-2", "b")], "doc_id string, title string")
    hits = spark.createDataFrame([("doc-1",), ("doc-3",)], "doc_id string")
    got = {r.doc_id: (r.found, r.source and json.loads(r.source)["title"]) for r in hydrate.hydrate(hits, hydrate.create("internal", docs)).collect()}
    assert got == {"doc-1": (True, "a"), "doc-3": (False, None)}


def test_exact_tokens_of_nulls(spark):
    rows = spark.createDataFrame(pd.DataFrame({"doc_id": [1, 2], "text": ["Running dogs", None]}))
    assert [(r.doc_id, r.term) for r in analysis.exact_tokens(rows, "doc_id", "text").collect()] == [(1, "run"), (1, "dog")]
