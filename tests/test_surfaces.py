"""Search, ingest, storage and export surfaces on small fixtures."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from termweave import export
from termweave.functions import scalars
from termweave.operators import cooc, embeddings, hydrate, ingest, ml, search, terms
from termweave.operators.index import Field, Index, Spec
from termweave.plans import catalog, cluster, request
from termweave.sources import files
from termweave.streaming import ingest as stream

SPEC = Spec((Field("text", analyzer="simple"),), shard_column="shard")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, "a" if k % 3 else "b", f"red {'blue ' * (k % 4)}green. item{k}") for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, shard string, text string")


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return Index.build(docs, SPEC).write(str(tmp_path_factory.mktemp("index")))


def ask(**query):
    return {"index_id": "i", "query": query, "limit": 5}


def test_stored_index_prunes_its_scan(index):
    plan = index.search_hits("text", "blue").where("shard_id = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard_id" in plan and "EqualTo(term,blue)" in plan and "positions" not in plan.split("ReadSchema")[1]


def test_totals_streams_and_missing_shards(index):
    body = ask(match={"field": "text", "value": "blue red"})
    total = {r.shard_id: r.total for r in search.totals(index, body).collect()}
    assert total == {"a": 40, "b": 20}
    assert [tuple(r) for r in search.stream(index, body)] == [tuple(r) for r in search.search(index, body).collect()]
    assert {s: len(h) for s, h in search.shard_streams(index, body)} == {"a": 5, "b": 5}
    assert search.metadata(index, body)["total"] == 60
    with pytest.raises(request.ValidationError):
        search.hits(index, {"shard_ids": ["zz"], "query": body["query"]})


def test_ranks_equal_a_sort(spark):
    rows = [("s" if k % 5 else "t", k, float(k * 7 % 13)) for k in range(300)]
    got = {(r.shard_id, r.doc_id): r["rank"] for r in search.ranked(spark.createDataFrame(rows, "shard_id string, doc_id long, score double").repartition(7)).collect()}
    for shard in "st":
        mine = sorted((-s, d) for x, d, s in rows if x == shard)
        assert [got[shard, d] for _, d in mine] == list(range(1, len(mine) + 1))


def test_hybrid_reads_one_hop(index, spark):
    import dataclasses

    e = spark.createDataFrame([("blue", "green", 0.9), ("blue", "red", 0.8)], "src string, dst string, weight double")
    i = dataclasses.replace(index, edges=e)
    found = search.metadata(i, ask(hybrid={"field": "text", "value": "blue", "max_hops": 1}))["expansions"]
    assert [(t, round(x, 6)) for t, x in found] == [("green", 0.63), ("red", 0.56)]
    hits = search.hits(i, ask(hybrid={"field": "text", "value": "blue", "operator": "and", "max_hops": 1}))
    assert {r.doc_id for r in hits.collect()} == set(range(60))  # the group of blue holds its neighbours' documents


def test_bulk_rows_keep_their_errors(spark):
    raw = spark.createDataFrame([('[{"a": 1}, 2, {"a": "x"}]',), ("[{",), ("[]",)], "body string")
    got = sorted((r.input_index if r.input_index is not None else -1, r.error or "") for r in ingest.bulk(raw).collect())
    assert got == [(-1, "body: not a JSON array"), (0, ""), (1, "payload: not an object"), (2, "")]
    assert tuple(ingest.bulk_status(ingest.bulk(raw)).first()) == (4, 2, 207)
    payload = F.lit(json.dumps({"x.y": 3, "a": 1}))
    assert spark.range(1).select(scalars.json_value(payload, "x.y").alias("v")).first().v == "3"


def test_hydration_store(spark, tmp_path):
    s = hydrate.Store(spark, str(tmp_path))
    hits = spark.createDataFrame([(1,), (2,)], "doc_id long")
    found = lambda: {r.doc_id: r.found for r in hydrate.hydrate(hits, s.connector()).collect()}
    assert found() == {1: False, 2: False}
    s.store(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, t string"))
    s.store(spark.createDataFrame([(2, "c")], "doc_id long, t string"))
    assert found() == {1: True, 2: True}
    s.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert found() == {1: False, 2: True}


def test_embeddings_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("a", [0.5, 2.0]), ("b", None)], "term string, embedding array<float>")
    back = e.select("term", embeddings.decoded(embeddings.encoded(F.col("embedding"))).alias("v")).collect()
    assert [(r.term, r.v) for r in back] == [("a", [0.5, 2.0]), ("b", None)]
    with pytest.raises(Exception, match="components"):
        embeddings.write(e.where("term = 'a'"), str(tmp_path / "e"), dim=3)


def test_cluster_log_replays():
    c = cluster.Cluster()
    for n in ("n1", "n2"):
        c.apply("join", node=n, at=0.0)
    assert c.apply("assign", index="i", shards=["s1", "s2", "s3"], copies=2) == {"s1": "n1", "s2": "n2", "s3": "n1"}
    c.apply("heartbeat", node="n1", at=50.0)
    assert c.stale(60.0) == ["n2"] and c.replicas["i", "s1"] == ["n2"]
    again = cluster.Cluster.replay(c.log)
    assert (again.nodes, again.shards, again.replicas) == (c.nodes, c.shards, c.replicas)
    c.apply("drop", index="i")
    assert not c.shards
    assert int(cluster.suggested_conf(100, 400, 100_000)["spark.sql.shuffle.partitions"]) > 100_000


def test_mapping_bodies_and_default_analyzer():
    c = catalog.Catalog()
    c.create(catalog.Definition("i", catalog.Mapping((Field("t"), Field("s", analyzer="simple")))))
    assert c.put_mapping("i", {"fields": {"n": {"type": "long"}}, "dynamic": "strict"})["version"] == 2
    spec = c.get("i").spec()
    assert (spec.text_analyzer("t"), spec.text_analyzer("s")) == ("standard", "simple")
    with pytest.raises(request.ValidationError):
        c.put_mapping("i", {"fields": {"x": {"type": "odd"}}})


def test_judgments_and_exports(index, spark, tmp_path):
    (tmp_path / "a.tsv").write_text("# c\nquery_id\tquery_text\tdoc_id\tgrade\n1\tblue\t3\t0\n1\tblue\t3\t2\nshort\n")
    (tmp_path / "b.tsv").write_text("1\tblue\t3\t1\n")
    got = files.judgments(spark, str(tmp_path / "*.tsv")).collect()
    assert [(r.query_id, r.doc_id, r.grade) for r in got] == [("1", "3", 1)]
    sums = cooc.document_pairs(index.docs.drop("shard_id"), SPEC, 3)
    edges = cooc.edges(sums, index.term_stats, index.shard_stats)
    edges.write.parquet(str(tmp_path / "weights"))
    path = index.docs.inputFiles()[0].split("/docs/")[0].removeprefix("file://").removeprefix("file:")
    for kind in ("edges", "graph", "expansion"):
        export.main(["--index", path, "--edges", str(tmp_path / "weights"), "--export", kind, "--out", str(tmp_path / kind), "--judgments", str(tmp_path / "a.tsv")])
    rows = spark.read.csv(str(tmp_path / "graph"), sep="\t")
    assert rows.count() == edges.where("src <= dst").count()
    links = ml.predicted_links(edges, F.lit(0.9), batch=2)
    assert links.where("src = dst").count() == 0 and links.agg(F.max("weight")).first()[0] in (0.5, None)


def test_stream_takes_the_last_version(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id long, text string"
    spec = Spec((Field("text", analyzer="simple"),))
    for rows in ([(1, "old words here"), (2, "stay")], [(1, "new"), (3, "")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream.start(spark.readStream.schema(schema).parquet(src), spec, out, str(tmp_path / "cp"), window=2).awaitTermination()
    now = stream.state(spark, out)
    assert {r.term: r.df for r in now["term_stats"].collect()} == {"new": 1, "stay": 1}
    assert now["pairs"].count() == 0
    stream.compact(spark, out, str(tmp_path / "small"))
    assert {r.term: r.df for r in stream.state(spark, str(tmp_path / "small"))["term_stats"].collect()} == {"new": 1, "stay": 1}


def test_lookup_by_time(spark):
    s = spark.createDataFrame([("2024-01", "f", "x", 1), ("2024-02", "f", "x", 2), ("default", "f", "y", 5)], "shard_id string, field string, term string, df long")
    got = {r.term: r.df for r in terms.cluster_lookup(s, "2024-02-03", "2024-02-20").collect()}
    assert got == {"x": 2, "y": 5}
    assert pd.DataFrame([tuple(r) for r in terms.cluster_lookup(s).collect()]).shape[0] == 2
