"""Documents to a positional inverted index with per-shard statistics.

postings: shard_id, field, term, doc_id, tf, doc_len (distinct terms of the field), positions
sorted. The JVM cuts a text into words once; functions.kernels groups the words of a run of texts into
postings on arrays of ids, so no field needs a shuffle. DFs are counted the same way, without postings.
The last row of a doc_id wins when documents are appended (latest). In plans of token rows no filter may
stand on a column derived from a text's words, nor may such a column be exploded by name: the optimizer
would push the filter down and cut the text again for every word.

A stored index (write, read) is partitioned by shard and consists of segments: every task writes its runs, each
sorted by field and term, so a query reads the pages of its terms in every run only, and writing moves no row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import analysis, kernels
from .sharding import Sharding, shard_key


#: Shards for which a task holds a file open at once; rows of more shards are sorted by shard first.
OPEN_SHARDS = 32


@dataclass(frozen=True)
class Field:
    """A mapped field: text, keyword, integer or date."""

    name: str
    kind: str = "text"
    analyzer: str = ""  # that of the index
    indexed: bool = True


@dataclass(frozen=True)
class Spec:
    """Fields and sharding of an index. lower_keywords makes keywords findable whatever their case."""

    fields: tuple[Field, ...]
    key: str = "doc_id"
    sharding: Sharding = field(default_factory=Sharding)
    shard_column: str = ""
    lower_keywords: bool = False
    default_analyzer: str = "standard"

    def analyzer_of(self, f: Field) -> str:
        return f.analyzer or self.default_analyzer

    def text_analyzer(self, name: str) -> str:
        return next((self.analyzer_of(f) for f in self.fields if f.name == name and f.kind == "text"), "keyword")

    def planned(self) -> list[Field]:
        """The fields that are indexed at all."""
        return [f for f in self.fields if f.indexed and f.kind in ("text", "keyword", "integer")]


def _value(f: Field, spec: Spec) -> Column:
    """A field as text; keywords in lower case if the index has them so."""
    value = F.col(f.name).cast("string")
    return F.lower(value) if spec.lower_keywords and f.kind == "keyword" else value


def sharded(docs: DataFrame, spec: Spec) -> DataFrame:
    key = F.col(spec.key)
    shard = F.col(spec.shard_column).cast("string") if spec.shard_column else shard_key(spec.sharding, key, lambda f: F.col(f).cast("string"))
    return docs.withColumn("shard_id", shard)


def latest(docs: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return docs.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def tokens(docs: DataFrame, spec: Spec, fields: tuple[str, ...] = ()) -> DataFrame:
    """shard_id, doc_id, field, term, position, sentence: one row per token; fields restricts them."""
    rows, parts = sharded(docs, spec), []
    keep = ("shard_id", "doc_id", "field")
    for f in spec.planned():
        if fields and f.name not in fields:
            continue
        x = rows.select("shard_id", F.col(spec.key).alias("doc_id"), F.lit(f.name).alias("field"), F.col(f.name).cast("string").alias("value"))
        if f.kind == "text":
            name = spec.analyzer_of(f)
            x = analysis.sentence_rows(x, "value", keep, name).select(*keep, "sentence", F.explode(F.transform("tokens", lambda t: t)).alias("t"))
            x = analysis.stemmed(x.select(*keep, F.col("t.term").alias("term"), F.col("t.position").alias("position"), "sentence"), "term", name)
        else:
            x = rows.select("shard_id", F.col(spec.key).alias("doc_id"), F.lit(f.name).alias("field"), _value(f, spec).alias("value"))
            x = x.where("value is not null").select(*keep, F.col("value").alias("term"), F.lit(0).alias("position"), F.lit(0).alias("sentence"))
        parts.append(x)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _words(docs: DataFrame, spec: Spec, f: Field) -> DataFrame:
    return sharded(docs, spec).select("shard_id", F.col(spec.key).alias("doc_id"), analysis.items(_value(f, spec), spec.analyzer_of(f)).alias("items"))


def _literals(docs: DataFrame, spec: Spec, f: Field) -> DataFrame:
    """shard_id, field, term, doc_id of a keyword or integer field."""
    return sharded(docs, spec).where(F.col(f.name).isNotNull()).select("shard_id", F.lit(f.name).alias("field"), _value(f, spec).alias("term"), F.col(spec.key).alias("doc_id"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def postings_of(docs: DataFrame, spec: Spec) -> DataFrame:
    """One row per (shard, field, term, doc)."""
    parts, kind = [], docs.schema[spec.key].dataType.simpleString()
    for f in spec.planned():
        if f.kind == "text":
            run = kernels.postings(spec.analyzer_of(f))
            x = _words(docs, spec, f).mapInArrow(run, f"shard_id string, doc_id {kind}, term string, tf int, doc_len int, positions array<int>")
            parts.append(x.select("shard_id", F.lit(f.name).alias("field"), "term", "doc_id", "tf", "doc_len", "positions"))
        else:
            parts.append(_literals(docs, spec, f).select("*", F.lit(1).alias("tf"), F.lit(1).alias("doc_len"), F.array(F.lit(0)).alias("positions")))
    return _all(parts)


def term_counts(docs: DataFrame, spec: Spec) -> DataFrame:
    """shard_id, field, term, df; tasks send sums of their runs, no postings are made."""
    parts = []
    for f in spec.planned():
        if f.kind == "text":
            x = _words(docs, spec, f).drop("doc_id").mapInArrow(kernels.frequencies(spec.analyzer_of(f)), "shard_id string, term string, df bigint")
            parts.append(x.groupBy("shard_id", "term").agg(F.sum("df").alias("df")).select("shard_id", F.lit(f.name).alias("field"), "term", "df"))
        else:
            parts.append(_literals(docs, spec, f).groupBy("shard_id", "field", "term").agg(F.count("*").alias("df")))
    return _all(parts)


def lengths(docs: DataFrame, spec: Spec) -> DataFrame:
    """shard_id, field, doc_id, doc_len of documents with terms; fields of plain analysis need no postings."""
    plain = [f for f in spec.planned() if f.kind != "text" or spec.analyzer_of(f) == "simple"]
    if len(plain) < len(spec.planned()):
        return postings_of(docs, spec).groupBy("shard_id", "field", "doc_id").agg(F.first("doc_len").alias("doc_len"))
    words = lambda f: F.size(F.array_distinct(analysis.items(_value(f, spec), "simple"))) if f.kind == "text" else F.col(f.name).isNotNull().cast("int")
    fields = F.array(*(F.struct(F.lit(f.name).alias("field"), words(f).alias("doc_len")) for f in plain))
    x = sharded(docs, spec).select("shard_id", F.col(spec.key).alias("doc_id"), F.explode(fields).alias("f"))
    return x.select("shard_id", "f.field", "doc_id", "f.doc_len").where("doc_len > 0")


def document_counts(docs: DataFrame, spec: Spec) -> DataFrame:
    """shard_id, total_docs: documents with a term; for one text of plain analysis its first word decides."""
    fields = spec.planned()
    if len(fields) == 1 and fields[0].kind == "text" and spec.analyzer_of(fields[0]) == "simple":
        return sharded(docs, spec).where(_value(fields[0], spec).rlike(analysis.WORD)).groupBy("shard_id").agg(F.count("*").alias("total_docs"))
    lens = lengths(docs, spec)
    if len(fields) > 1:  # several fields of a document count once
        lens = lens.select("shard_id", "doc_id").distinct()
    return lens.groupBy("shard_id").agg(F.count("*").alias("total_docs"))


@dataclass
class Index:
    """An inverted index as DataFrames; docs are the sources, with shard_id, for filters and hydration."""

    spec: Spec
    postings: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    shard_stats: DataFrame
    docs: DataFrame
    edges: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    @staticmethod
    def build(docs: DataFrame, spec: Spec) -> Index:
        """All parts as plans over docs; write() and read() make them tables."""
        field_stats = lengths(docs, spec).groupBy("shard_id", "field").agg(F.sum("doc_len").alias("total_len"), F.count("*").alias("doc_count"))
        return Index(spec, postings_of(docs, spec), term_counts(docs, spec), field_stats, document_counts(docs, spec), sharded(docs, spec))

    def write(self, path: str) -> Index:
        """Parquet; the index read back.

        Texts are analysed once: statistics come from the written postings.
        """
        spark = self.spark
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        name = "spark.sql.maxConcurrentOutputFileWriters"
        before = spark.conf.get(name)
        spark.conf.set(name, OPEN_SHARDS)  # without it, rows would be sorted by shard once more
        try:
            self.postings.write.mode("overwrite").option("parquet.block.size", 16 << 20).partitionBy("shard_id").parquet(f"{path}/postings")
        finally:
            spark.conf.set(name, before)
        posts = spark.read.schema(self.postings.schema).parquet(f"{path}/postings")
        posts.groupBy("shard_id", "field", "term").agg(F.count("*").alias("df")).sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/term_stats")
        lens = posts.groupBy("shard_id", "field", "doc_id").agg(F.first("doc_len").alias("doc_len"))
        lens.write.mode("overwrite").parquet(f"{path}/lengths")
        lens = spark.read.parquet(f"{path}/lengths")
        lens.groupBy("shard_id", "field").agg(F.sum("doc_len").alias("total_len"), F.count("*").alias("doc_count")).write.mode("overwrite").parquet(f"{path}/field_stats")
        one = lens.groupBy("shard_id", "doc_id").agg(F.lit(1).alias("one"))  # several fields of a document count once
        one.groupBy("shard_id").agg(F.count("*").alias("total_docs")).write.mode("overwrite").parquet(f"{path}/shard_stats")
        return Index.read(spark, path, self.spec)

    @staticmethod
    def read(spark: SparkSession, path: str, spec: Spec) -> Index:
        get = lambda n: spark.read.parquet(f"{path}/{n}")
        docs = get("docs")
        posts = spark.read.schema(f"field string, term string, doc_id {docs.schema[spec.key].dataType.simpleString()}, tf int, doc_len int, positions array<int>, shard_id string").parquet(f"{path}/postings")
        return Index(spec, posts, get("term_stats"), get("field_stats"), get("shard_stats"), docs)

    def shards(self) -> DataFrame:
        return self.shard_stats

    def search_hits(self, field_name: str, term: str) -> DataFrame:
        """doc_id, tf, doc_len of a term; positions are not read."""
        return self.postings.where((F.col("field") == field_name) & (F.col("term") == term)).select("shard_id", "doc_id", "tf", "doc_len")

    def by_term_id(self, term_id: str) -> DataFrame:
        """The postings of a term id (field, a zero character, term)."""
        name, _, term = term_id.partition("\0")
        return self.search_hits(name, term)

    def positions(self, field_name: str, term: str, doc_ids: DataFrame) -> DataFrame:
        """Positions of a term in given documents; empty where it is missing."""
        hit = self.postings.where((F.col("field") == field_name) & (F.col("term") == term)).select("doc_id", "positions")
        return doc_ids.join(hit, "doc_id", "left").withColumn("positions", F.coalesce("positions", F.array().cast("array<int>")))
