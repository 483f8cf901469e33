"""String, date, JSON and hash functions of the engine, as Columns unless Python is needed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

SOURCES = ("pmi", "idf", "agent", "user", "gnn", "llr", "dice", "ml_weight")


def osa_distance(a: str | bytes, b: str | bytes) -> int:
    """Optimal string alignment over bytes: insert, delete, substitute, swap neighbours once."""
    a, b = (x.encode() if isinstance(x, str) else x for x in (a, b))
    rows = [list(range(len(b) + 1))]
    for i in range(len(a)):
        row = [i + 1]
        for j in range(len(b)):
            best = min(rows[-1][j + 1] + 1, row[j] + 1, rows[-1][j] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                best = min(best, rows[-2][j - 1] + (a[i] != b[j]))
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


@F.pandas_udf(IntegerType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    """osa_distance of two columns."""
    return pd.Series([None if x is None or y is None else osa_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def fuzzy_prefixes(query: str, distance: int) -> list[str]:
    """Prefixes that candidates of a fuzzy lookup may have."""
    n = len(query)
    if n < 2:
        return [query]
    found = {query[:k] for k in range(max(2, 4 - distance), min(n, 4) + 1)}
    found.add(query[1] + query[0] + query[2:3])
    if n >= 3:
        found.add(query[1:4])
    return sorted(found)


def auto_distance(term: str) -> int:
    """Edit distance allowed for a term of this many bytes."""
    n = len(term.encode())
    return 0 if n <= 2 else 1 if n <= 5 else 2 if n <= 8 else 3


def term_key(field: Column, term: Column) -> Column:
    return F.concat(field, F.lit("\u0000"), term)


def term_number_id(number: Column) -> Column:
    """The t<N> form of a term id."""
    return F.concat(F.lit("t"), number.cast("string"))


def key_of(*parts: Column) -> Column:
    """A storage key: parts joined by a zero character."""
    return F.concat_ws("\u0000", *parts)


def key_parts(key: Column) -> Column:
    """array<string>: the parts of a storage key."""
    return F.split(key, "\u0000")


def term_hash_id(field: Column, term: Column) -> Column:
    return F.concat(F.lit("t_"), F.substring(F.sha2(term_key(field, term), 256), 1, 16))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the bytes, as a long."""
    raw = F.hex(F.encode(text, "utf-8"))
    steps = F.transform(F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2)), lambda i: F.conv(raw.substr(i, F.lit(2)), 16, 10).cast("long"))
    fold = F.aggregate(steps, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(F.length(text) > 0, fold).otherwise(F.lit(2166136261).cast("long"))


def fnv1a_python(text: str) -> int:
    h = 2166136261
    for x in text.encode():
        h = (h ^ x) * 16777619 & 0xFFFFFFFF
    return h


def sanitize_key(x: Column) -> Column:
    return F.translate(F.lower(F.trim(x)), " /", "--")


def date_bucket(ts: Column, unit: str = "month") -> Column:
    return F.date_format(ts, {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}.get(unit, "yyyy-MM"))


def _layouts(s: Column, formats: list[str]) -> Column:
    return F.coalesce(F.try_to_timestamp(s), *(F.try_to_timestamp(s, F.lit(f)) for f in formats))


def shard_date(s: Column) -> Column:
    """Timestamp of a shard key's value: whole numbers by length (13 ms, 16 us, else s), else layouts."""
    s = F.trim(s)
    n = s.try_cast("long")
    number = F.when(F.length(s) == 13, F.timestamp_millis(n)).when(F.length(s) == 16, F.timestamp_micros(n)).otherwise(F.timestamp_seconds(n))
    return F.when(s.rlike(r"^[+-]?\d+$"), number).otherwise(_layouts(s, ["yyyy/MM/dd", "yyyy/MM", "yyyy-MM"]))


def payload_date(s: Column) -> Column:
    """Timestamp of a payload value: numbers by magnitude (1e15 us, 1e12 ms, else s), else layouts."""
    s = F.trim(s)
    n = F.coalesce(s.try_cast("long"), s.try_cast("double").cast("long"))
    size = F.abs(n)
    number = F.when(size >= 10**15, F.timestamp_micros(n)).when(size >= 10**12, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))
    return F.when(s.try_cast("double").isNotNull(), number).otherwise(_layouts(s, ["yyyy/MM/dd", "yyyy/MM", "yyyy-MM"]))


def coerce_integer(s: Column) -> Column:
    """struct<value long, error string>: whole numbers and base-10 strings; null is 0."""
    t = F.trim(s)
    d = t.try_cast("double")
    whole = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long")).when(t.rlike(r"^[+-]?\d+\.0*$") & (d == F.floor(d)), d.cast("long"))
    value = F.when(s.isNull(), F.lit(0).cast("long")).otherwise(whole)
    return F.struct(value.alias("value"), F.when(value.isNull(), F.lit("not an integer")).alias("error"))


def coerce_date(s: Column) -> Column:
    """struct<value timestamp, error string>."""
    value = payload_date(s)
    return F.struct(value.alias("value"), F.when(value.isNull() & s.isNotNull(), F.lit("not a date")).alias("error"))


def coerce_text(s: Column) -> Column:
    return F.coalesce(s.cast("string"), F.lit(""))


def missing(s: Column) -> Column:
    """Whether a required JSON value counts as absent: null, blank, [] or {}."""
    return s.isNull() | F.trim(s).isin("", "[]", "{}", "null")


def json_path(field: str) -> str:
    """The path of a top-level field, whatever dots or brackets its name has."""
    return f"$['{field}']"


def json_value(payload: Column, field: str) -> Column:
    """A top-level value as text: strings trimmed, other values in Spark's notation of numbers, null as ""."""
    return F.coalesce(F.trim(F.get_json_object(payload, json_path(field))), F.lit(""))


def infer_type(value: Column) -> Column:
    """Mapping type of one JSON value given as text: see the tests' table."""
    v = F.trim(value)
    is_text = v.startswith('"') & v.endswith('"')
    s = F.when(is_text, F.regexp_replace(v, '^"|"$', ""))
    date = s.rlike(r"^\d{4}-\d{2}-\d{2}") & F.try_to_timestamp(s).isNotNull()
    spaces = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    text = (
        F.when(F.lower(s).isin("true", "false"), "boolean")
        .when(date, "date")
        .when((F.octet_length(s) < 256) & ~s.rlike(r"\s"), "keyword")
        .when(spaces >= 2, "text")
        .otherwise("keyword")
    )
    number = v.try_cast("double")
    return (
        F.when(v.isNull() | (v == "null") | (v == "[]"), "keyword")
        .when(is_text, text)
        .when(v.isin("true", "false"), "boolean")
        .when(v.startswith("{"), "object")
        .when(number.isNotNull(), F.when(number == F.floor(number), "long").otherwise("float"))
        .otherwise("keyword")
    )


def json_kind(source: Column) -> Column:
    """Known edge source names stay, others become empty."""
    return F.when(source.isin(*SOURCES), source).otherwise("")
