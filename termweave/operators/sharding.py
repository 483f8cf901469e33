"""Shard keys as partition columns: automatic (hash), date and computed strategies, and pruning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import date_bucket, fnv1a, sanitize_key, shard_date


@dataclass(frozen=True)
class Sharding:
    """strategy: automatic, date or computed. fields: where the key comes from."""

    strategy: str = "automatic"
    count: int = 1
    fields: tuple[str, ...] = ()
    unit: str = "month"


def hash_shard(seed: Column, count: int) -> Column:
    """hNN by FNV-1a modulo the count; one shard is called default."""
    one = F.substring(F.concat(F.lit("default"), F.coalesce(seed, F.lit(""))), 1, 7)  # no literal: joins on it stay equi-joins
    return one if count <= 1 else F.concat(F.lit("h"), F.lpad((fnv1a(seed) % count).cast("string"), 2, "0"))


def shard_key(sharding: Sharding, doc_id: Column, get, routing=None) -> Column:
    """get(field) gives a payload value as a string column; routing(field) stands in where that is blank."""
    if routing is not None:
        given = get
        get = lambda f: F.coalesce(F.when(F.trim(given(f)) != "", given(f)), routing(f))
    if sharding.strategy == "automatic":
        seed = F.trim(doc_id.cast("string"))
        if sharding.fields:
            given = get(sharding.fields[0])
            seed = F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(seed)
        return hash_shard(seed, sharding.count)
    if sharding.strategy == "date":
        return date_bucket(shard_date(get(sharding.fields[0])), sharding.unit)
    if sharding.strategy == "computed":
        return F.concat_ws("-", *(sanitize_key(get(f)) for f in sharding.fields))
    raise ValueError(f"unknown strategy {sharding.strategy!r}")


def initial_shards(sharding: Sharding, seeds: list[str] = [], now: str = "") -> list[str]:  # noqa: B006
    """Names a new index starts with."""
    clean = list(dict.fromkeys(s.strip() for s in seeds if s.strip()))
    if sharding.strategy == "automatic":
        return [f"h{i:02d}" for i in range(sharding.count)] if sharding.count > 1 else ["default"]
    return clean or ([now] if sharding.strategy == "date" and now else ["default"])


def prune(rows: DataFrame, start: str, end: str, key: str = "shard_id") -> DataFrame:
    """Rows whose date shard overlaps [start, end]; keys that are no dates stay."""
    k = F.col(key)
    first = F.try_to_timestamp(F.when(F.length(k) == 4, F.concat(k, F.lit("-01-01"))).when(F.length(k) == 7, F.concat(k, F.lit("-01"))).when(F.length(k) == 10, k))
    after = F.when(F.length(k) == 4, first + F.expr("interval 1 year")).when(F.length(k) == 7, first + F.expr("interval 1 month")).otherwise(first + F.expr("interval 1 day"))
    keep = first.isNull() | ((first <= F.lit(end).cast("timestamp")) & (after >= F.lit(start).cast("timestamp")))
    return rows.where(keep)
