"""GraphQL types as RDF: an object is a blank node with its type, its scalars, and links to other objects."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.terms import Term
from graphloom.plans import algebra as A
from graphloom.sources.views import Member, Rows, View, literal_of


@dataclass
class ObjectType:
    """Objects of a type, one row each; links: field -> (column of an id or an array of ids, target type)."""

    df: DataFrame
    id: str
    fields: list[str]
    links: dict[str, tuple[str, str]] = field(default_factory=dict)


def member(types: dict[str, ObjectType], prefix: str) -> Member:
    """Classes are prefix + type, properties prefix + type_field; nulls make no triples."""
    views = []

    def node(kind: str, c):
        return Term(T.BLANK, F.concat(F.lit(f"_:{kind}/"), c.cast("string")))

    for name, t in types.items():
        kinds = dict(t.df.dtypes)
        rows = Rows(name, t.df)
        s = node(name, F.col(t.id))
        views.append(View(rows, s, A.RDF_TYPE, Term(T.PLAIN_IRI, F.lit(prefix + name))))
        for f in t.fields:
            views.append(View(rows, s, f"{prefix}{name}_{f}", Term(literal_of(kinds[f]), F.col(f))))
        for f, (column, target) in t.links.items():
            if kinds[column].startswith("array"):
                many = Rows(f"{name}.{f}", t.df.select(t.id, F.explode(column).alias("_target")))
                views.append(View(many, s, f"{prefix}{name}_{f}", node(target, F.col("_target")), unique=False, repeats=True))
            else:
                views.append(View(rows, s, f"{prefix}{name}_{f}", node(target, F.col(column))))
    return Member(views)
