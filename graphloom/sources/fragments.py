"""Triple pattern fragments as members: one triple pattern a request, answered in pages of Turtle.

A fragment's page holds the matching triples and, about itself, its controls and counts; pages are followed
until there is no next one. Servers that take bindings with a pattern get those of a bind join, BATCH at a time.
"""

from __future__ import annotations

import sys
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.terms import Term
from graphloom.operators import relation as R
from graphloom.plans import algebra as A
from graphloom.sources import turtle
from graphloom.sources.remote import BATCH, PAGE, PARALLEL, written_term
from graphloom.sources.views import Member

_NEXT = ("http://www.w3.org/ns/hydra/core#next", "http://www.w3.org/ns/hydra/core#nextPage")
#: Vocabularies in which a page speaks about itself.
_ABOUT = ("http://www.w3.org/ns/hydra/core#", "http://rdfs.org/ns/void#", "http://xmlns.com/foaf/0.1/primaryTopic")


def fetch(url: str) -> str:
    request = urllib.request.Request(url, headers={"Accept": "text/turtle"})  # noqa: S310
    with urllib.request.urlopen(request, timeout=60) as answer:  # noqa: S310
        return answer.read().decode()


def parameter(x) -> str | None:
    """A term of a pattern as a request's parameter; nothing for a variable."""
    if isinstance(x, A.Iri):
        return x.value
    if isinstance(x, A.Lit):
        return f'"{x.value}"' + (f"@{x.lang}" if x.lang else "" if x.dt == A.XSD + "string" else f"^^{x.dt}")
    return None


def address(base: str, t: A.Triple, values: str | None = None) -> str:
    given = {k: parameter(x) for k, x in (("subject", t.s), ("predicate", t.p), ("object", t.o))}
    query = urllib.parse.urlencode({k: v for k, v in given.items() if v is not None} | ({"values": values} if values else {}))
    return base + ("&" if "?" in base else "?") + query if query else base


def _matches(x, wanted, binds: dict) -> bool:
    if isinstance(wanted, A.Var):
        return binds.setdefault(wanted.name, x) == x
    return x == wanted


def pages(base: str, t: A.Triple, get: Callable[[str], str], values: str | None = None) -> Iterator[list[dict]]:
    """The bindings on each page of a pattern's fragment."""
    url: str | None = address(base, t, values)
    while url:
        found, after = [], None
        for x in turtle.read(get(url), url):
            if x.p.value in _NEXT:
                after = x.o.value
            if any(x.p.value.startswith(a) for a in _ABOUT) or (isinstance(x.s, A.Iri) and x.s.value == url):
                continue
            binds: dict = {}
            if all(_matches(y, w, binds) for y, w in ((x.s, t.s), (x.p, t.p), (x.o, t.o))):
                found.append(binds)
        yield found
        url = after


def _cell(x) -> dict:
    if isinstance(x, A.Iri):
        return {"k": 2, "v": x.value, "dt": "", "lang": ""}
    if isinstance(x, A.Lit):
        return {"k": 3, "v": x.value, "dt": x.dt, "lang": x.lang}
    return {"k": 1, "v": x.name, "dt": "", "lang": ""}


class FragmentMember(Member):
    """A fragment server. bindings: whether it takes bindings with a pattern.

    parallel: tasks that ask the server with bindings at a time, each one request after the other.
    """

    single = True

    def __init__(self, base: str, bindings: bool = False, get: Callable[[str], str] = fetch, vocabulary=None, parallel: int = PARALLEL):
        super().__init__([], vocabulary)
        self.base, self.bindings, self.get, self.parallel = base, bindings, get, parallel
        for name in [m for m in sys.modules if m.startswith("graphloom.")] + [getattr(get, "__module__", "__main__")]:
            if name in sys.modules and name != "__main__":  # executors need not have the modules
                cloudpickle.register_pickle_by_value(sys.modules[name])

    def matching(self, t: A.Triple) -> list:
        return [self]

    def _read(self, source, run, variables: list[str]) -> R.Rel:
        schema = ", ".join(f"`{R.column_name(v)}` {T.DYNAMIC}" for v in variables) or "unit boolean"
        df = source.mapInPandas(run, schema)
        return R.made(df, {v: Term(T.DYN, F.col(R.column_name(v))) for v in variables}, variables)

    def evaluate(self, spark: SparkSession, triples: tuple[A.Triple, ...]) -> R.Rel:
        parts = []
        for t in triples:
            variables = sorted(t.variables())
            parts.append(self._read(spark.range(0, 1, 1, 1), _reader(self.base, t, self.get, variables), variables))
        out = parts[0]
        for p in parts[1:]:
            out = R.join(out, p)
        return out

    def bind(self, left: R.Rel, triples: tuple[A.Triple, ...]) -> R.Rel | None:
        """The pattern's triples that can join with left, where the server takes bindings."""
        variables = sorted(triples[0].variables())
        shared = [v for v in variables if v in left.certain]
        if not self.bindings or len(triples) != 1 or not shared:
            return None
        keys = left.df.select(*[T.dynamic(left.term(v)).alias(f"k{i}") for i, v in enumerate(shared)]).distinct()
        for i in range(len(shared)):
            keys = keys.filter(F.col(f"k{i}.k") != T.BNODE)
        return self._read(keys.repartition(self.parallel), _reader(self.base, triples[0], self.get, variables, shared), variables)


def _reader(base: str, t: A.Triple, get: Callable[[str], str], variables: list[str], shared: list[str] | None = None):
    columns = [R.column_name(v) for v in variables] or ["unit"]

    def asked(batches):
        """The bindings on each page."""
        for b in batches:
            if shared is None:
                yield from pages(base, t, get)
                continue
            records = b.to_dict("records")
            for i in range(0, len(records), BATCH):
                rows = " ".join("(" + " ".join(written_term(r[c]) for c in b.columns) + ")" for r in records[i : i + BATCH])
                yield from pages(base, t, get, f"({' '.join('?' + v for v in shared)}) {{ {rows} }}")

    def run(batches):
        held: list[list] = []  # pages are small, and each frame costs its own conversion
        for found in asked(batches):
            held += [[_cell(b[v]) for v in variables] or [True] for b in found]
            if len(held) >= PAGE:
                yield pd.DataFrame(held, columns=columns)
                held = []
        if held:
            yield pd.DataFrame(held, columns=columns)

    return run
