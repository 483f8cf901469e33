"""Term dictionary: list, prefix, fuzzy, regex, merged DFs, ids and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fuzzy_prefixes, osa, term_hash_id


def merged(stats: DataFrame) -> DataFrame:
    """field, term, df over all shards."""
    return stats.groupBy("field", "term").agg(F.sum("df").alias("df"))


def _field(stats: DataFrame, name: str) -> DataFrame:
    return merged(stats.where(F.col("field") == name) if name else stats)


def listed(stats: DataFrame, name: str = "", offset: int = 0, limit: int = 100) -> DataFrame:
    """One page in (field, term) order, after merging the shards."""
    return _field(stats, name).orderBy("field", "term").offset(offset).limit(limit)


def total(stats: DataFrame, name: str = "") -> DataFrame:
    return _field(stats, name).agg(F.count("*").alias("total"))


def by_prefix(stats: DataFrame, name: str, prefix: str, limit: int | None = None) -> DataFrame:
    out = _field(stats.where(F.col("term").startswith(prefix)), name).orderBy("field", "term")
    return out.limit(limit) if limit else out


def by_regex(stats: DataFrame, name: str, pattern: str, limit: int | None = None) -> DataFrame:
    """Unanchored."""
    out = _field(stats.where(F.col("term").rlike(pattern)), name).orderBy("field", "term")
    return out.limit(limit) if limit else out


def fuzzy(stats: DataFrame, name: str, query: str, distance: int, limit: int | None = None) -> DataFrame:
    """Terms within 1 to 3 edits among those that share a query prefix, by DF descending.

    Prefixes and length differences are tested first, so the edit distance sees few terms.
    """
    d = max(1, min(3, distance))
    if len(query.encode()) < 2:
        return _field(stats, name).limit(0)
    near = F.lit(False)
    for p in fuzzy_prefixes(query, d):
        near |= F.col("term").startswith(p)
    rows = _field(stats.where(near & (F.abs(F.octet_length("term") - len(query.encode())) <= d)), name)
    # an edit of the bytes with swaps is at most two without; this test is bounded and runs in generated code
    rows = rows.where(F.levenshtein(F.col("term"), F.lit(query), 2 * d) >= 0)
    out = rows.where(osa(F.col("term"), F.lit(query)) <= d).orderBy(F.desc("df"), "field", "term")
    return out.limit(limit) if limit else out


def lookup(stats: DataFrame, name: str = "", prefix: str = "", fuzzy_query: str = "", regex: str = "", distance: int = 1, offset: int = 0, limit: int = 100) -> DataFrame:
    """The first mode given wins: regex, fuzzy, prefix, list. Offsets apply after the merge."""
    if regex:
        out = by_regex(stats, name, regex)
    elif fuzzy_query:
        out = fuzzy(stats, name, fuzzy_query, distance)
    else:
        return (by_prefix(stats, name, prefix) if prefix else _field(stats, name).orderBy("field", "term")).offset(offset).limit(min(limit, 1000))
    return out.offset(offset).limit(min(limit, 1000))


def cluster_lookup(stats: DataFrame, start: str = "", end: str = "", **asked) -> DataFrame:
    """lookup() over the shards whose dates overlap [start, end]; shards whose names are no dates always take part."""
    from .sharding import prune

    return lookup(prune(stats, start or "0001-01-01", end or "9999-12-31") if start or end else stats, **asked)


def with_ids(stats: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """field, term, term_id: stable ids from the key; aliases (field, alias, term) share their term's id."""
    out = merged(stats).select("field", "term", term_hash_id(F.col("field"), F.col("term")).alias("term_id"))
    if aliases is not None:
        same = aliases.select("field", F.col("alias").alias("term"), term_hash_id(F.col("field"), F.col("term")).alias("term_id"))
        out = out.unionByName(same).withColumn("n", F.row_number().over(Window.partitionBy("field", "term").orderBy("term_id"))).where("n = 1").drop("n")
    return out


def ingest_deltas(stats: DataFrame, deltas: DataFrame) -> DataFrame:
    """DFs after increments (field, term, df)."""
    return merged(stats.select("field", "term", "df").unionByName(deltas.select("field", "term", "df")))
