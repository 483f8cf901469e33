"""Raw JSON documents to typed rows: routing extraction, validation, coercion, bad-row split, flattening."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans.catalog import Mapping

_COERCE = {"integer": scalars.coerce_integer, "long": scalars.coerce_integer, "date": scalars.coerce_date}


def extracted(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """document_id, routing map and body of raw requests, without reading the body's fields."""
    p = F.col(payload)
    return raw.select(
        F.get_json_object(p, "$.document_id").alias("document_id"),
        F.from_json(F.get_json_object(p, "$.routing"), "map<string,string>").alias("routing"),
        F.coalesce(F.get_json_object(p, "$.payload"), p).alias("payload"),
    )


def coerced(rows: DataFrame, mapping: Mapping, payload: str = "payload", strict: bool = False) -> DataFrame:
    """Typed columns of the mapped fields plus errors array<string>; strict also reports unmapped fields."""
    p = F.col(payload)
    cols, errors = [], []
    for f in mapping.fields:
        raw = F.get_json_object(p, scalars.json_path(f.name))
        if f.name in mapping.required:
            errors.append(F.when(scalars.missing(raw), F.lit(f"{f.name}: required")))
        if f.kind in _COERCE:
            value = _COERCE[f.kind](raw)
            cols.append(value["value"].alias(f.name))
            errors.append(F.when(value["error"].isNotNull(), F.concat(F.lit(f"{f.name}: "), value["error"])))
        else:
            cols.append((raw.try_cast({"float": "double", "boolean": "boolean"}[f.kind]) if f.kind in ("float", "boolean") else scalars.coerce_text(raw)).alias(f.name))
    if strict:
        extra = F.array_except(F.coalesce(F.json_object_keys(p), F.array().cast("array<string>")), F.array(*(F.lit(f.name) for f in mapping.fields)))
        errors.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown: "), F.array_join(extra, ","))))
    bad_json = F.when(F.json_object_keys(p).isNull() & (F.trim(p) != ""), F.lit("payload: not an object"))
    found = F.filter(F.array(bad_json, *errors), lambda x: x.isNotNull())
    return rows.select("*", *cols, found.alias("errors"))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their errors): good rows proceed whatever happens to others."""
    return rows.where(F.size("errors") == 0).drop("errors"), rows.where(F.size("errors") > 0)


def bulk(raw: DataFrame, column: str = "body") -> DataFrame:
    """input_index, payload, error: the elements of JSON arrays, one row each; a body that is no array is one row with an error."""
    item = F.posexplode_outer(F.from_json(column, "array<string>")).alias("input_index", "payload")
    rows = raw.select(F.col(column).alias("_body"), item)
    empty = F.regexp_replace("_body", r"\s", "") == "[]"
    error = F.when(F.col("input_index").isNull(), F.lit("body: not a JSON array")).when(F.json_object_keys("payload").isNull(), F.lit("payload: not an object"))
    return rows.where(F.col("input_index").isNotNull() | ~F.coalesce(empty, F.lit(False))).select("input_index", "payload", error.alias("error"))


def bulk_status(results: DataFrame) -> DataFrame:
    """One row: total, failed and the status of a bulk request: 200 all good, 207 some, 400 none."""
    out = results.agg(F.count("*").alias("total"), F.count("error").alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == 0, 200).when(F.col("failed") < F.col("total"), 207).otherwise(400))


def flattened(rows: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """key, path, value: dotted leaf paths of nested JSON, values as JSON text."""
    kind = rows.schema[key].dataType.simpleString()

    def walk(prefix: str, x: object) -> list[tuple[str, str]]:
        if isinstance(x, dict):
            return [leaf for k, v in x.items() for leaf in walk(f"{prefix}.{k}" if prefix else k, v)]
        return [(prefix, json.dumps(x, ensure_ascii=False))]

    def run(batches):
        for p in batches:
            out = []
            for k, text in zip(p[key], p[payload], strict=True):
                try:
                    out += [(k, *leaf) for leaf in walk("", json.loads(text or "{}")) if leaf[0]]
                except ValueError:
                    continue
            yield pd.DataFrame(out, columns=[key, "path", "value"])

    return rows.select(key, payload).mapInPandas(run, f"`{key}` {kind}, path string, value string")


def inferred(leaves: DataFrame) -> DataFrame:
    """path, kind: the commonest inferred type of each path (ties by name); arrays take their first element's."""
    first = F.when(F.col("value").startswith("["), F.get_json_object("value", "$[0]")).otherwise(F.col("value"))
    quoted = F.when(F.col("value").rlike(r'^\[\s*"'), F.concat(F.lit('"'), first, F.lit('"'))).otherwise(first)
    counts = leaves.withColumn("kind", scalars.infer_type(quoted)).groupBy("path", "kind").agg(F.count("*").alias("n"))
    best = counts.groupBy("path").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("b"))
    return best.select("path", F.col("b.kind").alias("kind"))
