"""Index definitions, mappings with versions and dynamic modes, and their tabular views."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.index import Field, Spec
from ..operators.sharding import Sharding, initial_shards
from .request import ValidationError

_NUMBERS, _STRINGS = {"long", "integer", "float"}, {"text", "keyword"}
KINDS = {"text", "keyword", "integer", "date", "long", "float", "boolean", "object"}


def compatible(old: str, new: str) -> bool:
    """Whether a value of one type fits a field of the other."""
    return old == new or {old, new} <= _NUMBERS or {old, new} <= _STRINGS


@dataclass(frozen=True)
class Mapping:
    """Fields of an index; mode is true (grow), false (ignore new fields) or strict (refuse them)."""

    fields: tuple[Field, ...]
    required: tuple[str, ...] = ()
    mode: str = "true"
    version: int = 1


@dataclass(frozen=True)
class Definition:
    """One index. default_analyzer serves text fields that name none."""

    name: str
    mapping: Mapping
    sharding: Sharding = field(default_factory=Sharding)
    default_analyzer: str = "standard"

    def spec(self, key: str = "doc_id") -> Spec:
        return Spec(self.mapping.fields, key, self.sharding, default_analyzer=self.default_analyzer)


class Catalog:
    """Definitions by name; small driver-side metadata only."""

    def __init__(self) -> None:
        self._all: dict[str, Definition] = {}

    def create(self, d: Definition) -> list[str]:
        """Store a definition; returns the names of its first shards."""
        if not d.name.strip() or d.name in self._all:
            raise ValidationError("name", "must be new and not blank")
        if bad := [f.name for f in d.mapping.fields if f.kind not in KINDS or not f.name.strip()]:
            raise ValidationError("fields", f"unknown types or blank names: {bad}")
        names = [f.name for f in d.mapping.fields]
        if len(set(names)) != len(names) or set(d.mapping.required) - set(names):
            raise ValidationError("fields", "names must differ, required fields must exist")
        if d.sharding.strategy not in ("automatic", "date", "computed") or d.sharding.strategy != "automatic" and not d.sharding.fields:
            raise ValidationError("sharding", "unknown strategy or no fields")
        if d.sharding.count < 1:
            raise ValidationError("sharding.count", "must be positive")
        from ..functions.analysis import analyzer

        for a in {d.default_analyzer, *(f.analyzer for f in d.mapping.fields)}:
            analyzer(a)
        self._all[d.name] = d
        return initial_shards(d.sharding)

    def get(self, name: str) -> Definition:
        if name not in self._all:
            raise KeyError(name)
        return self._all[name]

    def names(self) -> list[str]:
        return sorted(self._all)

    def delete(self, name: str) -> None:
        del self._all[name]

    def process(self, name: str, found: dict[str, str]) -> Mapping:
        """Apply inferred fields (name to type) of new documents under the mapping's mode."""
        d = self.get(name)
        known = {f.name: f for f in d.mapping.fields}
        for f, kind in found.items():
            if f in known and not compatible(known[f].kind, kind):
                raise ValidationError(f, f"{kind} does not fit {known[f].kind}")
        new = {f: k for f, k in found.items() if f not in known and k != "object"}
        if not new or d.mapping.mode == "false":
            return d.mapping
        if d.mapping.mode == "strict":
            raise ValidationError(sorted(new)[0], "unknown field in strict mode")
        return self.add_fields(name, [Field(f, k) for f, k in sorted(new.items())])

    def add_fields(self, name: str, fields: list[Field]) -> Mapping:
        """New fields raise the version; existing ones cannot change."""
        d = self.get(name)
        known = {f.name: f for f in d.mapping.fields}
        for f in fields:
            if f.name in known and known[f.name].kind != f.kind:
                raise ValidationError(f.name, "a field's type cannot change")
        fresh = tuple(f for f in fields if f.name not in known)
        if fresh:
            self._all[name] = replace(d, mapping=replace(d.mapping, fields=d.mapping.fields + fresh, version=d.mapping.version + 1))
        return self.get(name).mapping

    def set_mode(self, name: str, mode: str) -> Mapping:
        if mode not in ("true", "false", "strict"):
            raise ValidationError("mode", "must be true, false or strict")
        d = self.get(name)
        self._all[name] = replace(d, mapping=replace(d.mapping, mode=mode))
        return self.get(name).mapping

    def mapping(self, name: str) -> dict[str, object]:
        """The mapping as a response body."""
        m = self.get(name).mapping
        return {"version": m.version, "dynamic": m.mode, "fields": {f.name: {"type": f.kind, "analyzer": f.analyzer, "indexed": f.indexed, "required": f.name in m.required} for f in m.fields}}

    def put_mapping(self, name: str, body: dict[str, object]) -> dict[str, object]:
        """Add the fields and set the mode of a request body; the mapping after it."""
        if unknown := set(body) - {"fields", "dynamic"}:
            raise ValidationError("mapping", f"unknown settings {sorted(unknown)}")
        if body.get("dynamic"):
            self.set_mode(name, str(body["dynamic"]))
        new = [Field(f, str(x["type"]), str(x.get("analyzer", "")), bool(x.get("indexed", True))) for f, x in (body.get("fields") or {}).items()]
        if bad := [f.name for f in new if f.kind not in KINDS or not f.name.strip()]:
            raise ValidationError("fields", f"unknown types or blank names: {bad}")
        self.add_fields(name, new)
        return self.mapping(name)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The catalog as DataFrames: indexes and their fields."""
        rows = [(d.name, d.sharding.strategy, d.sharding.count, d.default_analyzer, d.mapping.mode, d.mapping.version) for d in self._all.values()]
        fields = [(d.name, f.name, f.kind, f.analyzer, f.indexed, f.name in d.mapping.required) for d in self._all.values() for f in d.mapping.fields]
        return {
            "indexes": spark.createDataFrame(rows, "name string, strategy string, shards int, analyzer string, mode string, version int"),
            "index_fields": spark.createDataFrame(fields, "name string, field string, kind string, analyzer string, indexed boolean, required boolean"),
        }
