"""Types with parents, properties and edge rules; nodes and edges are checked against them as DataFrames.

An ontology is a small driver value: a few hundred types at most. Its closure becomes a DataFrame.
"""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASTS = {"int": "bigint", "float": "double", "bool": "boolean"}


@dataclass
class Property:
    name: str
    kind: str = "str"
    required: bool = False


@dataclass
class Type:
    name: str
    parent: str = ""
    properties: list[Property] = field(default_factory=list)


@dataclass
class Rule:
    """Edges of a kind go from one of the domains to one of the ranges; an empty list allows all."""

    edge: str
    domains: list[str] = field(default_factory=list)
    ranges: list[str] = field(default_factory=list)


class Ontology:
    def __init__(self, types: list[Type] | None = None, rules: list[Rule] | None = None):
        self.types = {t.name: t for t in types or []}
        self.rules = list(rules or [])

    def define(self, new: Type) -> None:
        self.types[new.name] = new

    def ancestors(self, name: str) -> list[str]:
        """Parent, its parent and so on; a cycle ends the walk."""
        out: list[str] = []
        while (t := self.types.get(name)) and t.parent and t.parent not in out:
            out.append(name := t.parent)
        return out

    def is_a(self, name: str, other: str) -> bool:
        return name == other or other in self.ancestors(name)

    def subtypes(self, name: str) -> list[str]:
        return [t for t in self.types if t != name and self.is_a(t, name)]

    def properties(self, name: str) -> dict[str, Property]:
        """Those of the root first; a child's property takes the place of an inherited one."""
        line = [*reversed(self.ancestors(name)), name]
        return {p.name: p for t in line if t in self.types for p in self.types[t].properties}

    def closure(self, spark: SparkSession) -> DataFrame:
        """Rows (type, ancestor), every type with itself."""
        return spark.createDataFrame([(t, a) for t in self.types for a in (t, *self.ancestors(t))], "type string, ancestor string")

    def to_json(self) -> str:
        return json.dumps({"types": [asdict(t) for t in self.types.values()], "rules": [asdict(r) for r in self.rules]}, ensure_ascii=False)

    @classmethod
    def of(cls, data: dict) -> Ontology:
        types = [Type(t["name"], t.get("parent", ""), [Property(**p) for p in t.get("properties", [])]) for t in data.get("types", [])]
        return cls(types, [Rule(**r) for r in data.get("rules", [])])

    @classmethod
    def from_json(cls, text: str) -> Ontology:
        return cls.of(json.loads(text))

    @classmethod
    def from_toml(cls, text: str) -> Ontology:
        return cls.of(tomllib.loads(text))

    def node_errors(self, kind: Column, properties: Column) -> Column:
        """The errors of a node of a kind with a map of properties, inherited rules included."""
        found = []
        for name in self.types:
            for p in self.properties(name).values():
                value, here = F.try_element_at(properties, F.lit(p.name)), kind == name
                if p.required:
                    found.append(F.when(here & value.isNull(), F.lit(f"missing {p.name}")))
                if p.kind in CASTS:
                    found.append(F.when(here & value.isNotNull() & value.try_cast(CASTS[p.kind]).isNull(), F.lit(f"{p.name} is not {p.kind}")))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    def validate_nodes(self, nodes: DataFrame) -> DataFrame:
        """Rows (id, errors) of nodes that break a rule of their kind."""
        errors = self.node_errors(F.col("kind"), F.coalesce("properties", F.create_map().cast("map<string,string>")))
        return nodes.select("id", F.array_join(errors, "; ").alias("errors")).where("errors <> ''")

    def _within(self, kind: Column, allowed: list[str]) -> Column:
        """Whether a kind is one of the allowed ones or below one: their closure is a short list of names."""
        names = {n for a in allowed for n in (a, *self.subtypes(a))}
        return kind.isin(*sorted(names)) if allowed else F.lit(True)

    def validate_edges(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        """Rows (source_id, target_id, kind, errors) of edges that break a rule; all rules of a kind must hold."""
        kinds = nodes.select("id", F.col("kind").alias("k"))
        both = edges.join(kinds.select(F.col("id").alias("source_id"), F.col("k").alias("from_kind")), "source_id")
        both = both.join(kinds.select(F.col("id").alias("target_id"), F.col("k").alias("to_kind")), "target_id")
        found = []
        for r in self.rules:
            here = F.col("kind") == r.edge
            found.append(F.when(here & ~self._within(F.col("from_kind"), r.domains), F.concat(F.lit(f"{r.edge}: source "), "from_kind")))
            found.append(F.when(here & ~self._within(F.col("to_kind"), r.ranges), F.concat(F.lit(f"{r.edge}: target "), "to_kind")))
        errors = F.concat_ws("; ", *found) if found else F.lit("")
        return both.select("source_id", "target_id", "kind", errors.alias("errors")).where("errors <> ''")

    def of_type(self, nodes: DataFrame, name: str) -> DataFrame:
        """Nodes of a type or of one below it."""
        return nodes.where(F.col("kind").isin(name, *self.subtypes(name)))
