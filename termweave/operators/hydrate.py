"""Hits joined to their source documents by pluggable connectors."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Connector = Callable[[DataFrame], DataFrame]


def internal(docs: DataFrame, key: str = "doc_id") -> Connector:
    """Documents of a DataFrame, as JSON."""
    return lambda keys: docs.select(F.col(key).alias("doc_id"), F.to_json(F.struct(*docs.columns)).alias("source")).join(keys, "doc_id", "left_semi")


class Store:
    """Source documents kept as Parquet: store replaces by key, delete removes, connector serves hydration."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.version = spark, path, 0

    def _now(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/v{self.version}") if self.version else None

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}")
        self.version += 1

    def store(self, docs: DataFrame, key: str = "doc_id") -> None:
        """Documents as JSON under their key; of several with one key in a call, the smallest JSON stays."""
        new = docs.groupBy(F.col(key).cast("string").alias("doc_id")).agg(F.min(F.to_json(F.struct(*docs.columns))).alias("source"))
        old = self._now()
        self._write(new if old is None else old.join(new, "doc_id", "left_anti").unionByName(new))

    def delete(self, keys: DataFrame) -> None:
        old = self._now()
        if old is not None:
            self._write(old.join(keys.select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_anti"))

    def connector(self) -> Connector:
        def fetch(keys: DataFrame) -> DataFrame:
            kind, now = keys.schema["doc_id"].dataType, self._now()
            if now is None:
                return keys.select("doc_id", F.lit(None).cast("string").alias("source")).limit(0)
            return now.withColumn("doc_id", F.col("doc_id").cast(kind)).join(keys, "doc_id", "left_semi")

        return fetch


def http(url: str, headers: dict[str, str] | None = None, timeout: float = 10.0) -> Connector:
    """GET of url with {key} replaced, in tasks; 404 and errors count as not found."""

    def get(key: object) -> str | None:
        try:
            with urllib.request.urlopen(urllib.request.Request(url.replace("{key}", str(key)), headers=headers or {}), timeout=timeout) as r:
                return json.dumps(json.loads(r.read()))
        except (urllib.error.URLError, ValueError, OSError):
            return None

    def fetch(keys: DataFrame) -> DataFrame:
        kind = keys.schema["doc_id"].dataType.simpleString()

        def run(batches):
            for p in batches:
                yield pd.DataFrame({"doc_id": p.doc_id, "source": [get(k) for k in p.doc_id]})

        return keys.select("doc_id").distinct().mapInPandas(run, f"doc_id {kind}, source string").where("source is not null")

    return fetch


REGISTRY: dict[str, Callable[..., Connector]] = {"http": http, "internal": internal}


def register(name: str, factory: Callable[..., Connector]) -> None:
    REGISTRY[name] = factory


def create(name: str, *args, **settings) -> Connector:
    """A connector by name."""
    if name not in REGISTRY:
        raise ValueError(f"unknown connector {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](*args, **settings)


def hydrate(hits: DataFrame, connector: Connector | None) -> DataFrame:
    """hits with source JSON and found; without a connector there is no source."""
    if connector is None:
        return hits.withColumn("source", F.lit(None).cast("string")).withColumn("found", F.lit(False))
    docs = connector(hits.select("doc_id").distinct())
    return hits.join(docs, "doc_id", "left").withColumn("found", F.col("source").isNotNull())
