"""Labelled property graphs as RDF: nodes, labels, edges, properties, and properties of edges on triple terms.

nodes(id LONG, labels ARRAY<STRING>, props MAP<STRING,STRING>), edges(id, src, dst, label, props).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.terms import Desc, Term, literal
from graphloom.plans import algebra as A
from graphloom.sources.turtle import Graph
from graphloom.sources.views import Member, Rows, View


@dataclass(frozen=True)
class NameMap:
    """Names to terms: by a prefix (all names, or those that a regex matches), a single pair, or as literals."""

    prefix: str = ""
    pattern: str | None = None
    single: tuple[str, str] | None = None
    as_literal: bool = False
    as_blank: bool = False
    parts: tuple[NameMap, ...] = ()

    def column(self, name: Column) -> Column:
        """The IRI, label or identifier; NULL for a name that is not covered."""
        if self.parts:
            return F.coalesce(*[p.column(name) for p in self.parts])
        if self.single:
            return F.when(name == self.single[0], F.lit(self.single[1]))
        made = name if self.as_literal else F.concat(F.lit("_:" if self.as_blank else self.prefix), name)
        return F.when(name.rlike(f"^(?:{self.pattern})$"), made) if self.pattern else made

    @property
    def desc(self) -> Desc:
        first = self.parts[0] if self.parts else self
        return literal(T.STRING) if first.as_literal else T.BLANK if first.as_blank else T.PLAIN_IRI

    def iri(self, name: str) -> str | None:
        """The IRI of one name, as column() gives it."""
        if self.parts:
            return next((x for p in self.parts if (x := p.iri(name)) is not None), None)
        if self.single:
            return self.single[1] if name == self.single[0] else None
        if self.pattern and not re.fullmatch(self.pattern, name):
            return None
        return self.prefix + name


@dataclass(frozen=True)
class Config:
    node: str  # prefix of node IRIs
    label_predicate: str
    labels: NameMap
    edges: NameMap
    properties: NameMap


def read_config(triples: list[A.Triple]) -> Config:
    """A configuration from Turtle: label predicate, prefix of nodes, maps of node labels, edge labels, properties."""
    g = Graph(triples)
    root = next(s for s in g.by_subject if g.one(s, "labelPredicate") is not None)

    def names(node) -> NameMap:
        if (parts := g.one(node, "componentMappings")) is not None:
            return NameMap(parts=tuple(names(x) for x in g.items(parts)))
        literals = any("LiteralBased" in o.value for o in g.all(node, "type") if isinstance(o, A.Iri))
        label = g.value(node, "label") or g.value(node, "propertyName")
        if label is not None and g.one(node, "iri") is not None:
            return NameMap(single=(label, g.value(node, "iri")))
        return NameMap(g.value(node, "prefixOfIRIs", ""), g.value(node, "regex"), as_literal=literals)

    return Config(
        g.value(g.one(root, "nodeMapping"), "prefixOfIRIs", ""),
        g.value(root, "labelPredicate"),
        names(g.one(root, "nodeLabelMapping")),
        names(g.one(root, "edgeLabelMapping")),
        names(g.one(root, "propertyNameMapping")),
    )


def member(nodes: DataFrame, edges: DataFrame, config: Config) -> Member:
    """Triples: node label, node property, edge (its label as predicate), and << edge >> property.

    Property values are strings. Labels and properties that no map covers make no triples.
    """
    node = lambda c: Term(Desc("iri", template=(config.node, ""), integral=True), F.col(c))
    labelled = nodes.select("id", F.explode("labels").alias("label"))
    valued = nodes.select("id", F.explode("props").alias("name", "value"))
    edge_valued = edges.select("src", "dst", "label", F.explode("props").alias("name", "value"))
    edge_term = Term(T.PLAIN_IRI, config.edges.column(F.col("label")))
    property_term = Term(T.PLAIN_IRI, config.properties.column(F.col("name")))
    value = Term(literal(T.STRING), F.col("value"))
    triple = Term(Desc("triple"), F.struct(T.dynamic(node("src")), T.dynamic(edge_term), T.dynamic(node("dst"))), (node("src"), edge_term, node("dst")))
    views = [
        View(Rows("labels", labelled), node("id"), config.label_predicate, Term(config.labels.desc, config.labels.column(F.col("label"))), unique=False),
        View(Rows("properties", valued), node("id"), property_term, value, unique=False),
        View(Rows("edges", edges), node("src"), edge_term, node("dst"), unique=False, repeats=True),
        View(Rows("edge properties", edge_valued), triple, property_term, value, unique=False, repeats=True),
    ]
    return Member(views)
