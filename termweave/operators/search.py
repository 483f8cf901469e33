"""Clause trees to one DataFrame plan: (shard_id, doc_id, score), then filters, top-k and cursor.

Statistics are those of the shard. Every clause uses the documents it hits itself as DF. Ties rank
by doc_id. Query terms reach the posting scan as pushed filters; the DFs joined back have at most
one row per query term and shard.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import analysis, scoring
from ..functions.scalars import auto_distance
from ..plans.request import Clause, Pipeline, Request, ValidationError, parse, query_type, scoring_field
from ..sources.workspace import materialize
from . import graph, terms
from .index import Index

ORDERING_TOP = 50
ACTIVE_SCALE = 5


def _by_score() -> list[Column]:
    """Order of hits: sums of the same parts in another order are the same score."""
    return [F.desc(F.round("score", 12)), F.asc("doc_id")]


def _best(*by: str) -> WindowSpec:  # noqa: N802
    return Window.partitionBy(*by).orderBy(*_by_score())




def _statistics(index: Index, name: str) -> DataFrame:
    """shard_id, n, avg_len; one row per shard."""
    avg = F.when(F.col("doc_count") > 0, F.col("total_len") / F.col("doc_count")).otherwise(1.0)
    lens = index.field_stats.where(F.col("field") == name).select("shard_id", avg.alias("avg_len"))
    return index.shard_stats.select("shard_id", F.col("total_docs").alias("n")).join(lens, "shard_id", "left").fillna(1.0, ["avg_len"])


def _scored(index: Index, hits: DataFrame, name: str, boost: float, p: Pipeline, by: tuple[str, ...] = ("shard_id", "term")) -> DataFrame:
    """hits (shard_id, term, doc_id, tf, doc_len, ...) with the BM25 score of each row."""
    df = hits.groupBy(*by).agg(F.countDistinct("doc_id").alias("df"))
    rows = hits.join(df, list(by)).join(_statistics(index, name), "shard_id")
    value = scoring.bm25(F.col("tf"), F.col("doc_len"), F.col("avg_len"), F.col("n"), F.col("df"), boost, p.k1, p.b)
    return rows.withColumn("score", value)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard_id", "doc_id").agg(F.sum("score").alias("score"))


def _query_terms(index: Index, c: Clause) -> list[str]:
    kind = index.spec.text_analyzer(c.field)
    found = [c.value] if kind == "keyword" else analysis.analyze_query(c.value, kind)
    if c.fuzziness and kind != "keyword":
        known = {r.term for r in index.postings.where((F.col("field") == c.field) & F.col("term").isin(found)).select("term").distinct().collect()}  # at most the query's terms
        found = [t if t in known or len(t.encode()) < 3 else _corrected(index, c.field, t, c.fuzziness) for t in found]
    return found


def _corrected(index: Index, name: str, term: str, fuzziness: int) -> str:
    """The candidate of highest DF, or the term itself; fuzziness is the largest distance asked for, and a short term allows less."""
    distance = min(fuzziness, auto_distance(term))
    best = terms.fuzzy(index.term_stats, name, term, distance, 1).first() if distance else None
    return best.term if best else term


def _token_hits(index: Index, name: str, words: list[str]) -> DataFrame:
    """Posting rows of each query token (idx), duplicates of a token counted twice."""
    hits = index.postings.where((F.col("field") == name) & F.col("term").isin(sorted(set(words)))).select("shard_id", "term", "doc_id", "tf", "doc_len")
    toks = index.spark.createDataFrame([(i, w) for i, w in enumerate(words)], "idx int, term string")
    return hits.join(F.broadcast(toks), "term")  # one row per query token


def match(index: Index, c: Clause, p: Pipeline, ordered: bool = True) -> DataFrame:
    """Analysed terms: summed BM25, optional AND, coordination, ordering boost of the best 50."""
    words = _query_terms(index, c)
    if not words:
        return _none(index)
    rows = _scored(index, _token_hits(index, c.field, words), c.field, c.boost, p)
    docs = rows.groupBy("shard_id", "doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("matched"))
    if c.operator == "and":
        live = rows.select("shard_id", "idx").distinct().groupBy("shard_id").agg(F.count("*").alias("live"))
        docs = docs.join(live, "shard_id").where((F.col("live") <= 1) | (F.col("matched") >= F.col("live")))
    docs = docs.select("shard_id", "doc_id", (F.col("score") * scoring.coordination(F.col("matched"), len(words), p.coord_weight)).alias("score"))
    if not ordered or len(words) < 2 or not p.ordering_factor:
        return docs
    top = docs.withColumn("rank", F.row_number().over(_best("shard_id"))).where(F.col("rank") <= ORDERING_TOP)
    places = index.postings.where((F.col("field") == c.field) & F.col("term").isin(sorted(set(words)))).select("shard_id", "doc_id", "term", F.get("positions", F.lit(0)).alias("first"))
    toks = F.broadcast(index.spark.createDataFrame([(i, w) for i, w in enumerate(words)], "idx int, term string"))
    firsts = places.join(top.select("shard_id", "doc_id"), ["shard_id", "doc_id"], "left_semi").join(toks, "term")
    firsts = firsts.groupBy("shard_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "first"))).alias("f"))
    boosts = firsts.select("shard_id", "doc_id", scoring.ordering_boost(F.col("f.first"), p.ordering_factor).alias("boost"))
    return docs.join(boosts, ["shard_id", "doc_id"], "left").select("shard_id", "doc_id", (F.col("score") * F.coalesce("boost", F.lit(1.0))).alias("score"))


def term(index: Index, c: Clause, p: Pipeline) -> DataFrame:
    """One literal term, lower-cased, not stemmed."""
    rows = index.postings.where((F.col("field") == c.field) & (F.col("term") == c.value.lower())).select("shard_id", "term", "doc_id", "tf", "doc_len")
    return _scored(index, rows, c.field, 1.0, p).select("shard_id", "doc_id", "score")


def prefix(index: Index, c: Clause, p: Pipeline) -> DataFrame:
    """Summed BM25 of every term with the prefix."""
    rows = index.postings.where((F.col("field") == c.field) & F.col("term").startswith(c.value.lower())).select("shard_id", "term", "doc_id", "tf", "doc_len")
    return _summed(_scored(index, rows, c.field, c.boost, p))


def in_range(index: Index, c: Clause) -> DataFrame:
    """Typed comparison on the source column; score 0."""
    x, ok = F.col(c.field), F.lit(True)
    for bound, test in ((c.gte, x.__ge__), (c.gt, x.__gt__), (c.lte, x.__le__), (c.lt, x.__lt__)):
        if bound is not None:
            ok &= test(F.lit(bound))
    return index.docs.where(ok).select("shard_id", F.col(index.spec.key).alias("doc_id"), F.lit(0.0).alias("score"))


def boolean(index: Index, c: Clause, p: Pipeline) -> DataFrame:
    """must: all, summed; should: summed; must_not: excluded. Without must and should: nothing."""
    keys = ["shard_id", "doc_id"]
    if not c.must and not c.should:
        return _none(index)
    parts = [compile_clause(index, x, p).withColumn("need", F.lit(1)) for x in c.must] + [compile_clause(index, x, p).withColumn("need", F.lit(0)) for x in c.should]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    out = rows.groupBy(*keys).agg(F.sum("score").alias("score"), F.sum("need").alias("need")).where(F.col("need") == len(c.must)).drop("need")
    for x in c.must_not:
        out = out.join(compile_clause(index, x, p).select(*keys), keys, "left_anti")
    return out


def expansions(index: Index, words: list[str], name: str, p: Pipeline) -> DataFrame:
    """term, energy: terms activated from the query's terms, originals dropped, the strongest kept."""
    if index.edges is None:
        return index.spark.createDataFrame([], "term string, energy double")
    starts = index.spark.createDataFrame([(w,) for w in sorted(set(words))], "start string")
    energy = graph.spread_activation(index.edges, starts, 1.0 / len(words), p.max_hops, p.decay, p.fan_out, p.energy_threshold)
    found = energy.groupBy(F.col("node").alias("term")).agg(F.sum("energy").alias("energy")).where(~F.col("term").isin(words))
    return found.orderBy(F.desc("energy"), "term").limit(p.max_expansions)


def hybrid(index: Index, c: Clause, p: Pipeline) -> DataFrame:
    """Lexical and expansion scores: fused by reciprocal ranks (or), or by concept groups (and)."""
    p = p.merged({"max_hops": c.hops, "blend": c.blend})
    words = _query_terms(index, c)
    lexical = match(index, c if c.operator == "or" else _as_or(c), p, ordered=False)
    if c.operator == "and":
        return _concepts(index, c, words, p)
    more = expansions(index, words, c.field, p)
    hits = index.postings.where(F.col("field") == c.field).join(F.broadcast(more), "term").select("shard_id", "term", "doc_id", "tf", "doc_len", "energy")  # max_expansions rows
    rows = _scored(index, hits, c.field, 1.0, p).where(F.col("df") <= p.max_df)
    extra = rows.groupBy("shard_id", "doc_id").agg(F.sum(F.col("score") * c.boost * F.col("energy") * p.expansion_cap).alias("score"))
    return fuse(lexical, extra, p.blend)


def _as_or(c: Clause) -> Clause:
    return replace(c, operator="or")


def ranked(rows: DataFrame) -> DataFrame:
    """rows (shard_id, doc_id, score) with rank within the shard, by score, then doc_id.

    Hits are dealt by ranges of the order itself and written, so that the hits of one large shard
    are many tasks; a rank is the place within the range plus the sizes of the ranges before.
    """
    order = [F.asc("shard_id"), *_by_score()]
    placed = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("shard_id", "part").agg(F.count("*").alias("size"))  # at most ranges x shards rows
    before = F.coalesce(F.sum("size").over(Window.partitionBy("shard_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("shard_id", "part").orderBy(*_by_score()))
    out = placed.withColumn("own", own).join(sizes.select("shard_id", "part", before.alias("before")), ["shard_id", "part"])
    return out.withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "part")


def fuse(first: DataFrame, second: DataFrame, blend: float) -> DataFrame:
    """Reciprocal rank fusion per shard; where the second list is empty the first keeps its scores."""
    keys = ["shard_id", "doc_id"]
    a = ranked(first.select(*keys, "score")).select(*keys, F.col("score").alias("own"), F.col("rank").alias("ra"))
    b = ranked(second.select(*keys, "score")).select(*keys, F.col("rank").alias("rb"))
    some = b.groupBy("shard_id").agg(F.lit(True).alias("some"))
    both = a.join(b, keys, "full").join(some, "shard_id", "left")
    return both.select(*keys, F.when(F.col("some"), scoring.rrf(F.col("ra")) + scoring.rrf(F.col("rb"), blend)).otherwise(F.col("own")).alias("score"))


def _concepts(index: Index, c: Clause, words: list[str], p: Pipeline) -> DataFrame:
    """One group per token (its own hits and up to five expansions): documents in all live groups, else in any."""
    own = index.spark.createDataFrame([(i, w, 1.0, True) for i, w in enumerate(words)], "idx int, term string, energy double, lexical boolean")
    if index.edges is not None:
        starts = index.spark.createDataFrame([(w,) for w in sorted(set(words))], "start string")
        energy = graph.spread_activation(index.edges, starts, 1.0, p.max_hops, p.decay, p.fan_out, p.energy_threshold)
        nth = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("energy"), "node"))
        near = energy.where(~F.col("node").isin(words)).withColumn("nth", nth).where(F.col("nth") <= ACTIVE_SCALE)
        tok = index.spark.createDataFrame([(i, w) for i, w in enumerate(words)], "idx int, start string")
        own = own.unionByName(near.join(tok, "start").select("idx", F.col("node").alias("term"), (F.col("energy") * p.expansion_cap).alias("energy"), F.lit(False).alias("lexical")))
    hits = index.postings.where(F.col("field") == c.field).join(F.broadcast(own), "term").select("shard_id", "term", "doc_id", "tf", "doc_len", "idx", "energy", "lexical")  # at most six per token
    rows = _scored(index, hits, c.field, c.boost, p).where(F.col("lexical") | (F.col("df") <= p.max_df))
    docs = rows.groupBy("shard_id", "doc_id").agg(
        F.sum(F.col("score") * F.col("energy")).alias("score"), F.countDistinct("idx").alias("groups"), F.sum(F.col("lexical").cast("int")).alias("matched")
    )
    live = rows.groupBy("shard_id").agg(F.countDistinct("idx").alias("live"))
    docs = docs.join(live, "shard_id").withColumn("all", F.col("groups") == F.col("live"))
    any_all = docs.groupBy("shard_id").agg(F.max("all").alias("any_all"))  # one row per shard
    docs = docs.join(any_all, "shard_id").where(F.col("all") | ~F.col("any_all"))
    return docs.select("shard_id", "doc_id", (F.col("score") * scoring.coordination(F.col("matched"), len(words), p.coord_weight)).alias("score"))


def _none(index: Index) -> DataFrame:
    return index.docs.select("shard_id", F.col(index.spec.key).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)


def compile_clause(index: Index, c: Clause, p: Pipeline) -> DataFrame:
    """(shard_id, doc_id, score) of a clause."""
    return {
        "term": lambda: term(index, c, p), "match": lambda: match(index, c, p), "prefix": lambda: prefix(index, c, p),
        "range": lambda: in_range(index, c), "hybrid": lambda: hybrid(index, c, p), "bool": lambda: boolean(index, c, p),
    }[c.kind]()


def hits(index: Index, request: Request | Mapping[str, Any], pipeline: Pipeline | None = None, check_shards: bool = True) -> DataFrame:
    """All hits of a request before the limit; shards that the index lacks are an error."""
    r = request if isinstance(request, Request) else parse(request)
    p = (pipeline or Pipeline()).merged(r.pipeline)
    if r.shard_ids:
        known = {x.shard_id for x in index.shard_stats.where(F.col("shard_id").isin(list(r.shard_ids))).select("shard_id").collect()} if check_shards else set(r.shard_ids)
        if missing := set(r.shard_ids) - known:
            raise ValidationError("shard_ids", f"unknown shards {sorted(missing)}")
    out = compile_clause(index, r.query, p)
    if r.shard_ids:
        out = out.where(F.col("shard_id").isin(list(r.shard_ids)))
    for f in r.filters:
        out = out.join(compile_clause(index, f, p).select("shard_id", "doc_id"), ["shard_id", "doc_id"], "left_semi")
    return out


def search(index: Index, request: Request | Mapping[str, Any], pipeline: Pipeline | None = None) -> DataFrame:
    """shard_id, doc_id, score: the best hits of all shards, after the cursor if one is given."""
    r = request if isinstance(request, Request) else parse(request)
    out = hits(index, r, pipeline)
    if r.cursor:
        s, d = r.cursor
        out = out.where((F.col("score") < s) | ((F.col("score") == s) & (F.col("doc_id") > F.lit(d).cast(out.schema["doc_id"].dataType))))
    return out.orderBy(*_by_score()).limit(r.limit)


def totals(index: Index, request: Request | Mapping[str, Any], pipeline: Pipeline | None = None) -> DataFrame:
    """shard_id, total: the number of hits of each shard before the limit."""
    return hits(index, request, pipeline).groupBy("shard_id").agg(F.count("*").alias("total"))


def metadata(index: Index, request: Request | Mapping[str, Any], pipeline: Pipeline | None = None) -> dict[str, Any]:
    """What a response tells beside its hits: query type, total, scoring field and expansion terms with energies."""
    r = request if isinstance(request, Request) else parse(request)
    p = (pipeline or Pipeline()).merged(r.pipeline)
    out: dict[str, Any] = {"query_type": query_type(r.query), "field": scoring_field(r.query), "total": totals(index, r, pipeline).agg(F.sum("total")).first()[0] or 0}
    if r.query.kind == "hybrid":
        words = _query_terms(index, r.query)
        found = expansions(index, words, r.query.field, p.merged({"max_hops": r.query.hops})) if words else None
        out["expansions"] = [(x.term, x.energy) for x in found.collect()] if found is not None else []  # max_expansions rows
    return out


def stream(index: Index, request: Request | Mapping[str, Any], pipeline: Pipeline | None = None) -> Iterator[Row]:
    """The hits of search(), one at a time in order; the caller may stop early."""
    yield from search(index, request, pipeline).toLocalIterator()


def shard_streams(index: Index, request: Request | Mapping[str, Any], pipeline: Pipeline | None = None) -> Iterator[tuple[str, list[Row]]]:
    """(shard, its best hits) for every shard with hits, each list within the request's limit."""
    r = request if isinstance(request, Request) else parse(request)
    rows = hits(index, r, pipeline)
    best = rows.withColumn("rank", F.row_number().over(_best("shard_id"))).where(F.col("rank") <= r.limit).orderBy("shard_id", "rank")
    held: list[Row] = []
    for x in best.toLocalIterator():
        if held and held[0].shard_id != x.shard_id:
            yield held[0].shard_id, held
            held = []
        held.append(x)
    if held:
        yield held[0].shard_id, held


def merge_top(shard_hits: DataFrame, limit: int) -> DataFrame:
    """Global top-k of per-shard hits."""
    return shard_hits.orderBy(*_by_score()).limit(limit)
