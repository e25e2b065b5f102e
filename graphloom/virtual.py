"""The relational test tables as graphs: what the registered queries run over."""

from __future__ import annotations

from pyspark.sql import SparkSession

from graphloom.plans.algebra import OWL, RDFS
from graphloom.sources import stub
from graphloom.sources.fragments import FragmentMember
from graphloom.sources.remote import WAYS, RemoteMember
from graphloom.sources.views import Member, SingleMember, TableSpec, table_member
from graphloom.sources.vocabulary import Rule, Vocabulary

EX = "http://ex.org/"

#: table -> (key, columns that are links: column -> (predicate, table))
TABLES: dict[str, tuple[str | None, dict[str, tuple[str, str]]]] = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"n_regionkey": ("n_region", "region")}),
    "customer": ("c_custkey", {"c_nationkey": ("c_nation", "nation")}),
    "supplier": ("s_suppkey", {"s_nationkey": ("s_nation", "nation")}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"o_custkey": ("o_customer", "customer")}),
    "lineitem": (None, {"l_orderkey": ("l_order", "orders"), "l_partkey": ("l_part", "part"), "l_suppkey": ("l_supplier", "supplier")}),
    "events": ("event_id", {"user_id": ("event_user", "customer")}),
    "documents": ("doc_id", {}),
    "embeddings": ("vec_id", {}),
    "labels": ("doc_id", {}),
}
#: Tables whose rows are about another table's subjects.
ABOUT = {"labels": "documents"}


def member(spark: SparkSession, sf_dir: str, *names: str, vocabulary: Vocabulary | None = None) -> Member:
    """A member of some tables; predicates are EX + column, types EX + Table."""
    specs, tables = [], {}
    for name in names:
        key, links = TABLES[name]
        tables[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        columns = {c: EX + c for c in tables[name].columns}
        specs.append(TableSpec(name, key, columns, {c: (EX + p, t) for c, (p, t) in links.items()}, EX + name.capitalize(), ABOUT.get(name)))
    return table_member(spark, tables, specs, EX, vocabulary)


#: Global terms for some of the local ones above.
GLOBAL = "http://global.org/"
VOCABULARY = Vocabulary(
    (
        Rule(OWL + "equivalentProperty", EX + "n_name", GLOBAL + "name"),
        Rule(OWL + "equivalentProperty", EX + "r_name", GLOBAL + "name"),
        Rule(OWL + "equivalentProperty", EX + "n_region", GLOBAL + "partOf"),
        Rule(RDFS + "subClassOf", EX + "Nation", GLOBAL + "Place"),
        Rule(RDFS + "subClassOf", EX + "Region", GLOBAL + "Place"),
        Rule(OWL + "sameAs", EX + "region/0", GLOBAL + "Africa"),
    )
)


class Federation(dict):
    """Members by IRI, made when they are first asked for."""

    def __init__(self, makers: dict):
        super().__init__()
        self.makers = makers

    def __missing__(self, iri: str) -> Member:
        self[iri] = self.makers[iri]()
        return self[iri]

    def __contains__(self, iri: object) -> bool:
        return iri in self.makers


def federation(spark: SparkSession, sf_dir: str) -> Federation:
    """EX + m/ + table for each table; m/all for all; m/geo-global, nations and regions in global terms; m/remote..., m/tpf, m/brtpf: customers and nations, asked by requests."""
    one = lambda name: lambda: member(spark, sf_dir, name)
    makers = {f"{EX}m/{name}": one(name) for name in TABLES}
    makers[f"{EX}m/tpch"] = lambda: member(spark, sf_dir, "region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    makers[f"{EX}m/geo"] = lambda: member(spark, sf_dir, "region", "nation")
    makers[f"{EX}m/geo-global"] = lambda: member(spark, sf_dir, "region", "nation", vocabulary=VOCABULARY)
    makers[f"{EX}m/supplier-single"] = lambda: SingleMember(member(spark, sf_dir, "supplier").views)
    makers[f"{EX}m/docs"] = lambda: member(spark, sf_dir, "documents", "labels")
    for way in WAYS:  # endpoints that are asked, each with bindings sent another way
        makers[f"{EX}m/remote-{way}"] = lambda way=way: RemoteMember(f"stub:{sf_dir}", stub.endpoint, bindings=way)
    makers[f"{EX}m/remote"] = makers[f"{EX}m/remote-values"]
    makers[f"{EX}m/remote-no-values"] = lambda: RemoteMember(f"stub:{sf_dir}#novalues", stub.endpoint, bindings="values-or-filter")
    makers[f"{EX}m/remote-short"] = lambda: RemoteMember(f"stub:{sf_dir}#short", stub.endpoint)
    makers[f"{EX}m/remote-failing"] = lambda: RemoteMember(f"stub:{sf_dir}#fail", stub.endpoint)
    makers[f"{EX}m/tpf"] = lambda: FragmentMember(f"stub:{sf_dir}", False, stub.fragment)
    makers[f"{EX}m/brtpf"] = lambda: FragmentMember(f"stub:{sf_dir}", True, stub.fragment)
    return Federation(makers)
