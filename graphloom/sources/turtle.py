"""A reader of Turtle and N-Triples for configuration files; they are small, so it reads whole texts."""

from __future__ import annotations

from graphloom.plans import algebra as A
from graphloom.sparql.parser import Parser


class _Turtle(Parser):
    def __init__(self, text: str, base: str = ""):
        super().__init__(text, base)
        self.nodes: dict[str, A.Iri] = {}

    def document(self) -> list[A.Triple]:
        triples: list[A.Triple] = []
        while self.tok.kind != "END":
            if self.directive():
                continue
            s = self.term(triples)
            if s is None:
                self.fail("a subject")
            if not self.at("."):
                self.property_list(s, triples)
            self.need(".")
        return triples

    def directive(self) -> bool:
        at = self.tok
        if at.kind == "LANG" and at.text in ("@prefix", "@base"):
            self.i += 1
            if at.text == "@prefix":
                name = (self.kind("PNAME") or self.fail("a prefix")).text
                self.prefixes[name[:-1]] = self.iri().value
            else:
                self.base = self.iri().value
            self.need(".")
            return True
        if self.at("PREFIX", "BASE"):
            self.prologue()
            return True
        return False


def read(text: str, base: str = "") -> list[A.Triple]:
    """Triples of a Turtle text; blank nodes are hidden variables."""
    return _Turtle(text, base).document()


class Graph:
    """Triples by subject, with properties found by the last part of their name, whatever the namespace."""

    def __init__(self, triples: list[A.Triple]):
        self.triples = triples
        self.by_subject: dict = {}
        for t in triples:
            self.by_subject.setdefault(t.s, []).append((t.p.value, t.o))

    @staticmethod
    def local(iri: str) -> str:
        return iri.replace("/", "#").rpartition("#")[2]

    def all(self, s, name: str) -> list:
        return [o for p, o in self.by_subject.get(s, []) if self.local(p) == name]

    def one(self, s, name: str, default=None):
        return next(iter(self.all(s, name)), default)

    def value(self, s, name: str, default=None):
        x = self.one(s, name)
        return default if x is None else x.value

    def items(self, cell) -> list:
        out = []
        while cell is not None and cell != A.Iri(A.RDF + "nil"):
            out.append(self.one(cell, "first"))
            cell = self.one(cell, "rest")
        return out

    def of_type(self, name: str) -> list:
        return [s for s in self.by_subject if any(isinstance(o, A.Iri) and self.local(o.value) == name for o in self.all(s, "type"))]
