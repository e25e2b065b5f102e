"""Mappings between a member's local vocabulary and the global one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.terms import Term
from graphloom.operators import relation as R
from graphloom.plans import algebra as A

_SAME = {A.OWL + "sameAs", A.OWL + "equivalentClass", A.OWL + "equivalentProperty"}
_SUB = {A.RDFS + "subClassOf", A.RDFS + "subPropertyOf"}
_SCHEMA = {A.OWL + "equivalentClass", A.OWL + "equivalentProperty", *_SUB}


@dataclass(frozen=True)
class Rule:
    kind: str  # the property's IRI, or owl:unionOf
    local: str
    to: str  # global


@dataclass(frozen=True)
class Vocabulary:
    """Rules local -> global, a bounded configuration. Equivalences hold both ways; the others from local to global."""

    rules: tuple[Rule, ...] = field(default_factory=tuple)

    @classmethod
    def from_triples(cls, triples: list[A.Triple]) -> Vocabulary:
        """Triples (local, rule, global); owl:unionOf lists the local classes that make up a global one."""
        rest = {t.s: t.o for t in triples if t.p == A.Iri(A.RDF + "rest")}
        first = {t.s: t.o for t in triples if t.p == A.Iri(A.RDF + "first")}
        rules = []
        for t in triples:
            if t.p.value in _SAME | _SUB and isinstance(t.s, A.Iri) and isinstance(t.o, A.Iri):
                rules.append(Rule(t.p.value, t.s.value, t.o.value))
            elif t.p.value == A.OWL + "unionOf" and isinstance(t.s, A.Iri):
                cell = t.o
                while cell in first:
                    rules.append(Rule(t.p.value, first[cell].value, t.s.value))
                    cell = rest.get(cell)
        return cls(tuple(rules))

    @property
    def equivalences_only(self) -> bool:
        return all(r.kind in _SAME for r in self.rules)

    def locals_of(self, iri: str, entities: bool) -> list[str]:
        """Local terms that a global term of a pattern stands for: itself if there is none."""
        kinds = {A.OWL + "sameAs"} if entities else _SCHEMA | {A.OWL + "unionOf"}
        return [r.local for r in self.rules if r.to == iri and r.kind in kinds] or [iri]

    def mapping(self, to_global: bool) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for r in self.rules:
            if to_global:
                out.setdefault(r.local, []).append(r.to)
            elif r.kind in _SAME:
                out.setdefault(r.to, []).append(r.local)
        return out

    def patterns(self, t: A.Triple) -> list[A.Triple]:
        """The local triple patterns that a global one stands for."""
        subjects = [A.Iri(x) for x in self.locals_of(t.s.value, True)] if isinstance(t.s, A.Iri) else [t.s]
        predicates = [A.Iri(x) for x in self.locals_of(t.p.value, False)] if isinstance(t.p, A.Iri) else [t.p]
        objects = [t.o]
        if isinstance(t.o, A.Iri):
            classes = t.p == A.Iri(A.RDF_TYPE)
            objects = [A.Iri(x) for x in self.locals_of(t.o.value, not classes)]
        return [A.Triple(s, p, o) for s in subjects for p in predicates for o in objects]


def rewritten(vocabulary: Vocabulary, member: str, triples: tuple[A.Triple, ...]) -> A.Op:
    """A pattern in global terms as requests in local ones."""
    parts: list[A.Op] = []
    plain: list[A.Triple] = []
    for t in triples:
        found = vocabulary.patterns(t)
        if len(found) == 1:
            plain.append(found[0])
        else:
            parts.append(A.Union(tuple(A.Request(member, (f,)) for f in found)))
    if plain:
        parts.insert(0, A.Request(member, tuple(plain)))
    return parts[0] if len(parts) == 1 else A.Join(tuple(parts))


def translate(rel: R.Rel, vocabulary: Vocabulary, to_global: bool) -> R.Rel:
    """IRIs of all variables rewritten; a term with several counterparts gives a row for each."""
    mapping = vocabulary.mapping(to_global)
    if not mapping:
        return rel
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    terms = {}
    for v, t in rel.env().items():
        if t.desc.kind == "iri":
            if t.desc.template and not any(T.key_of(k, t.desc) is not None for k in mapping):
                terms[v] = t
                continue
            iri = T.iri_string(t)
            terms[v] = Term(T.PLAIN_IRI, F.explode_outer(F.coalesce(F.try_element_at(table, iri), F.array(iri))))
        elif t.desc.kind == "dyn":
            iris = F.when(t.col["k"] == T.IRI, F.try_element_at(table, t.col["v"]))
            new = F.transform(iris, lambda x: F.struct(F.lit(T.IRI).cast("tinyint").alias("k"), x.alias("v"), F.lit("").alias("dt"), F.lit("").alias("lang")))
            terms[v] = Term(T.DYN, F.explode_outer(F.coalesce(new, F.array(t.col))))
        else:
            terms[v] = t
    # a select takes one generator: the variables are rewritten one after another
    out = rel
    for v, t in terms.items():
        if t is not rel.env().get(v) and str(t.col) != str(rel.term(v).col):
            out = R.made(out.df, out.env() | {v: t}, out.certain)
    return out
