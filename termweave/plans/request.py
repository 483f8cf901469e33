"""Search requests: clause tree, normalisation, validation and layered pipeline settings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

DEFAULT_LIMIT, MAX_LIMIT = 20, 100
TERMS_DEFAULT, TERMS_MAX = 100, 1000
KINDS = ("term", "match", "prefix", "range", "hybrid", "bool")


class ValidationError(ValueError):
    """A field of a request that cannot be accepted."""

    def __init__(self, where: str, message: str) -> None:
        super().__init__(f"{where}: {message}")
        self.field, self.message = where, message


def printed(value: Any) -> str:
    """A value as indexed text: whole numbers without a fraction, booleans in lower case."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


@dataclass(frozen=True)
class Clause:
    """One node: its kind and the settings of that kind."""

    kind: str
    field: str = ""
    value: str = ""
    boost: float = 1.0
    operator: str = "or"
    fuzziness: int = 0
    gte: Any = None
    gt: Any = None
    lte: Any = None
    lt: Any = None
    hops: int = 0
    blend: float = 0.0
    must: tuple[Clause, ...] = ()
    should: tuple[Clause, ...] = ()
    must_not: tuple[Clause, ...] = ()


@dataclass(frozen=True)
class Pipeline:
    """Scoring and traversal settings; zero means not set, except in the defaults."""

    k1: float = 1.2
    b: float = 0.75
    coord_weight: float = 2.0
    ordering_factor: float = 0.5
    blend: float = 0.3
    max_hops: int = 3
    decay: float = 0.7
    fan_out: int = 15
    epsilon: float = 0.0
    energy_threshold: float = 0.01
    max_expansions: int = 10
    max_df: int = 5000
    expansion_cap: float = 0.3

    def merged(self, *layers: Mapping[str, float] | None) -> Pipeline:
        """Later layers win where they set a value other than zero."""
        known, out = {f.name for f in fields(self)}, self
        for layer in layers:
            if unknown := set(layer or ()) - known:
                raise ValidationError("pipeline", f"unknown settings {sorted(unknown)}")
            out = replace(out, **{k: v for k, v in (layer or {}).items() if v})
        return out


@dataclass(frozen=True)
class Request:
    """A normalised request."""

    query: Clause
    index_id: str = ""
    shard_ids: tuple[str, ...] = ()
    filters: tuple[Clause, ...] = ()
    pipeline: Mapping[str, float] = field(default_factory=dict)
    limit: int = DEFAULT_LIMIT
    cursor: tuple[float, str] | None = None


def boosted_field(name: str, boost: float | None) -> tuple[str, float]:
    """`title^3` with an explicit boost multiplies both."""
    base, sep, factor = name.strip().partition("^")
    try:
        power = float(factor) if sep else 1.0
    except ValueError:
        base, power = name.strip(), 1.0
    return base.strip(), power * (boost if boost else 1.0)


def _clause(where: str, raw: Any, allowed: tuple[str, ...] = KINDS) -> Clause:
    if not isinstance(raw, Mapping) or len(raw) != 1:
        raise ValidationError(where, "exactly one operator is needed")
    kind, body = next(iter(raw.items()))
    if kind not in allowed or not isinstance(body, Mapping):
        raise ValidationError(where, f"operator {kind!r} is not allowed here")
    if kind == "bool":
        parts = {k: tuple(_clause(f"{where}.{k}[{i}]", c, ("term", "range") if k == "must_not" else KINDS) for i, c in enumerate(body.get(k) or ())) for k in ("must", "should", "must_not")}
        if not any(parts.values()):
            raise ValidationError(where, "bool needs a clause")
        return Clause("bool", **parts)
    name, boost = boosted_field(str(body.get("field", "")), body.get("boost"))
    if not name:
        raise ValidationError(f"{where}.field", "is required")
    value = printed(body.get("value", body.get("query", ""))).strip()
    if kind == "range":
        bounds = {k: body[k] for k in ("gte", "gt", "lte", "lt") if body.get(k) is not None}
        if not bounds:
            raise ValidationError(where, "range needs a bound")
        return Clause("range", name, boost=boost, **bounds)
    if not value:
        raise ValidationError(f"{where}.value", "is required")
    operator = str(body.get("operator") or "or").strip().lower()
    if operator not in ("or", "and"):
        raise ValidationError(f"{where}.operator", "must be and or or")
    fuzziness, hops = int(body.get("fuzziness") or 0), int(body.get("max_hops") or 0)
    if not 0 <= fuzziness <= 3 or not 0 <= hops <= 3:
        raise ValidationError(where, "fuzziness and max_hops go from 0 to 3")
    return Clause(kind, name, value, boost, operator, fuzziness, hops=hops, blend=float(body.get("blend") or 0.0))


def parse(raw: Mapping[str, Any]) -> Request:
    """Validate and normalise a request given as a mapping."""
    if unknown := set(raw) - {"index_id", "shard_ids", "query", "filters", "pipeline", "limit", "cursor"}:
        raise ValidationError("request", f"unknown fields {sorted(unknown)}")
    index_id = str(raw.get("index_id") or "").strip()
    shard_ids = tuple(dict.fromkeys(s.strip() for s in raw.get("shard_ids") or () if s.strip()))
    if bool(index_id) == bool(shard_ids):
        raise ValidationError("index_id", "give either index_id or shard_ids")
    limit = int(raw.get("limit") or DEFAULT_LIMIT)
    if not 1 <= limit <= MAX_LIMIT:
        raise ValidationError("limit", f"must be 1 to {MAX_LIMIT}")
    filters = tuple(_clause(f"filters[{i}]", c, ("term", "range")) for i, c in enumerate(raw.get("filters") or ()))
    cursor = raw.get("cursor")
    return Request(_clause("query", raw.get("query")), index_id, shard_ids, filters, dict(raw.get("pipeline") or {}), limit, (float(cursor[0]), str(cursor[1])) if cursor else None)


def query_type(clause: Clause) -> str:
    """Label for metrics; bool has none of its own."""
    return clause.kind if clause.kind != "bool" else "unknown"


def scoring_field(clause: Clause) -> str:
    """The first field of a clause; in bool clauses must comes before should."""
    if clause.kind != "bool":
        return clause.field
    return next((f for c in (*clause.must, *clause.should) if (f := scoring_field(c))), "")
