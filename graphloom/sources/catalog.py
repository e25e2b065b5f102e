"""Federation descriptions in Turtle: which members there are, how they are reached, how they are viewed.

Properties and classes are known by the last part of their names, whatever the namespace. A description names
members; where their data are is given by loaders, functions from an endpoint's address to a DataFrame of
triples (SPARQL, fragments) or by `get`, a function from a URL to a document (Web APIs).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans import algebra as A
from graphloom.sources import mapping
from graphloom.sources.fragments import FragmentMember
from graphloom.sources.remote import RemoteMember
from graphloom.sources.turtle import Graph, read
from graphloom.sources.views import LookUpMember, Member, triple_member, url_fetch
from graphloom.sources.vocabulary import Vocabulary

#: Protocols by the last part of their names, and what they take: whole patterns, single triples, triples with bindings.
PROTOCOLS = {"SPARQLProtocol": "patterns", "TPFProtocol": "single", "brTPFProtocol": "single", "GenericWebAPIProtocol": "documents", "BoltProtocol": "property graph", "GraphQLProtocol": "objects"}


@dataclass
class Description:
    iri: str
    protocol: str
    address: str
    params: dict[str, tuple[str, bool]] = field(default_factory=dict)
    maps: list = field(default_factory=list)
    vocabulary_file: str | None = None


def descriptions(texts: list[str]) -> tuple[list[Description], Graph]:
    """The members that some Turtle texts describe together."""
    g = Graph([t for i, text in enumerate(texts) for t in _apart(read(text), i)])
    out = []
    for s in g.by_subject:
        iri = g.value(s, "serviceURI")
        interface = g.one(s, "interface")
        if iri is None or interface is None:
            continue
        protocol = Graph.local(g.value(interface, "supportedProtocol", ""))
        if protocol not in PROTOCOLS:
            raise ValueError(f"{iri}: no protocol {protocol}")
        address = g.value(interface, "endpointAddress") or g.value(interface, "exampleFragmentAddress") or ""
        d = Description(iri, protocol, address, vocabulary_file=g.value(s, "vocabularyMappingsFile"))
        if (template := g.one(interface, "uriTemplate")) is not None:
            d.address = g.value(template, "template")
            for m in g.all(template, "mapping"):
                d.params[g.value(m, "variable")] = (g.value(m, "paramType", ""), g.value(m, "required", "false") == "true")
        if (wrapper := g.one(s, "wrapper")) is not None:
            d.maps = g.items(g.one(wrapper, "rmlTriplesMaps"))
        out.append(d)
    return out, g


def _apart(triples: list[A.Triple], i: int) -> list[A.Triple]:
    """Blank nodes of one text kept apart from those of others."""
    name = lambda x: A.Var(f"{x.name}-{i}") if isinstance(x, A.Var) else x
    return [A.Triple(name(t.s), t.p, name(t.o)) for t in triples]


def load(
    spark: SparkSession,
    texts: list[str],
    triples: Callable[[str], DataFrame] | None = None,
    get: Callable[[str], str | None] | None = None,
    others: dict[str, Member] | None = None,
    folder: str = ".",
    remote: bool = False,
) -> dict[str, Member]:
    """Members by service IRI. others: members of protocols that need a configuration of their own.

    remote: SPARQL endpoints are asked over the network, if there is no loader for their triples.
    """
    found, g = descriptions(texts)
    maps = mapping.read_rml(g)
    out: dict[str, Member] = dict(others or {})
    for d in found:
        vocabulary = None
        if d.vocabulary_file:
            vocabulary = Vocabulary.from_triples(read(Path(folder, d.vocabulary_file).read_text()))
        kind = PROTOCOLS[d.protocol]
        if kind == "patterns" and triples is None and remote:
            out[d.iri] = RemoteMember(d.address, vocabulary=vocabulary)
        elif kind == "single" and triples is None and remote:
            out[d.iri] = FragmentMember(d.address, d.protocol == "brTPFProtocol", vocabulary=vocabulary)
        elif kind in ("patterns", "single") and triples is not None:
            out[d.iri] = triple_member(triples(d.address), single=kind == "single", vocabulary=vocabulary)
        elif kind == "documents" and get is not None:
            out[d.iri] = _documents(spark, d, maps, get, vocabulary)
    return out


def _documents(spark: SparkSession, d: Description, maps: dict, get: Callable, vocabulary) -> Member:
    scope = d.iri
    if d.params:
        view = lambda rows: mapping.rml_views(maps, lambda _: (rows.df, "doc", rows.keys), scope, only=d.maps)
        return LookUpMember(d.params, url_fetch(d.address, get), view, vocabulary)
    one = url_fetch(d.address, get)(spark.range(1).select(F.lit("").alias("none")))
    return Member(mapping.rml_views(maps, lambda _: (one, "doc", ()), scope, only=d.maps), vocabulary)


def rml_files(spark: SparkSession, text: str, folder: str) -> Member:
    """A member of RML mappings whose sources are JSON files, by paths relative to the mapping's folder."""
    g = Graph(read(text))

    def documents(source):
        path = str(Path(folder, g.value(source, "path")))
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("doc")), "doc", ()

    return Member(mapping.rml_views(mapping.read_rml(g), documents, "file"))
