"""Remote SPARQL endpoints as members: whole patterns as paged requests, or bind joins in batches.

Requests run on the executors. An endpoint gets the whole body of a SERVICE clause, its filters, options and
unions included, with the bindings of what it is joined with, some distinct ones at a time, so that only what can
join is fetched; without a variable that the input always binds, it is asked for the whole pattern once.

How bindings are sent (`bindings`): in a VALUES clause (values), as a disjunction (filter), as a branch of a union
each (union), as such branches with variables of their own (rename), one a request (nested), or in VALUES and, where
an endpoint fails on that, as a disjunction (values-or-filter). A request that fails is tried with fewer bindings.
"""

from __future__ import annotations

import json
import sys
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.terms import Term
from graphloom.operators import relation as R
from graphloom.plans import algebra as A
from graphloom.sources.views import Member
from graphloom.sparql import writer

#: Rows of a page; bindings of a bind-join request, and the fewest to which failures bring it down.
PAGE, BATCH, LEAST = 10000, 30, 5
#: How often a request is sent before it counts as failed, the first pause in seconds, and requests at a time.
TRIES, PAUSE, PARALLEL = 3, 0.5, 10
#: Ways to send bindings.
WAYS = ("values", "filter", "union", "rename", "nested", "values-or-filter")


def ask(endpoint: str, query: str, timeout: float = 60.0) -> dict:
    """One request by the SPARQL protocol, answered in the JSON results format."""
    data = urllib.parse.urlencode({"query": query}).encode()
    request = urllib.request.Request(endpoint, data, {"Accept": "application/sparql-results+json"})  # noqa: S310
    for n in range(TRIES):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code < 500 and e.code != 429 or n == TRIES - 1:  # the request itself is at fault
                raise
        except OSError:
            if n == TRIES - 1:
                raise
        time.sleep(PAUSE * 2**n)
    raise AssertionError


def as_dynamic(cell: dict | None) -> dict | None:
    """A term of the JSON results format in dynamic form."""
    if cell is None:
        return None
    kind, value = cell["type"], cell["value"]
    if kind == "uri":
        return {"k": 2, "v": value, "dt": "", "lang": ""}
    if kind == "bnode":
        return {"k": 1, "v": f"_:{value}", "dt": "", "lang": ""}
    lang = cell.get("xml:lang", "").lower()
    base = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString" if lang else "http://www.w3.org/2001/XMLSchema#string"
    return {"k": 3, "v": value, "dt": cell.get("datatype", base), "lang": lang}


def written_term(t) -> str:
    """A dynamic term as SPARQL writes it; UNDEF for an unbound one."""
    if t is None:
        return "UNDEF"
    if t["k"] == 2:
        return f"<{t['v']}>"
    return writer.literal(t["v"], t["dt"], t["lang"])


def _given(t) -> A.Iri | A.Lit:
    return A.Iri(t["v"]) if t["k"] == 2 else A.Lit(t["v"], t["dt"], t["lang"])


def _rows(answer: dict, names: list[str]) -> list[list]:
    return [[as_dynamic(b.get(n)) for n in names] for b in answer["results"]["bindings"]]


class Requests:
    """The requests of a bind join: texts for some bindings of `shared`, and rows of `variables` from their answers."""

    def __init__(self, body: A.Op, variables: list[str], shared: list[str], way: str):
        self.body, self.variables, self.shared, self.way = body, variables, shared, way
        if way in ("union", "rename", "nested"):
            try:  # where a term cannot stand in place of a variable, VALUES can still bind it
                writer.pattern(self._with([{"k": 2, "v": "x:x", "dt": "", "lang": ""}] * len(shared), 0))
            except writer.Unwritable:
                self.way = "values"
        self.size = 1 if self.way == "nested" else BATCH

    def _with(self, given: list[dict], row: int) -> A.Op:
        """The body with terms for the shared variables; for `rename` with names of the row for the others."""
        terms = {v: _given(t) for v, t in zip(self.shared, given, strict=True)}
        own = (lambda v: A.Var(f"{v.name}_{row}")) if self.way == "rename" else (lambda v: v)
        return writer.changed(self.body, lambda v: terms.get(v.name) or own(v))

    def text(self, rows: list[list[dict]], way: str | None = None) -> str:
        way = way or self.way
        names = [writer.name_of(v) for v in self.variables]
        head = " ".join(f"?{n}" for n in names)
        if way in ("values", "values-or-filter"):
            values = " ".join("(" + " ".join(map(written_term, r)) + ")" for r in rows)
            bound = " ".join(f"?{writer.name_of(v)}" for v in self.shared)
            return f"SELECT {head} WHERE {{ VALUES ({bound}) {{ {values} }} {writer._inner(self.body)} }}"
        if way == "filter":
            one = lambda r: " && ".join(f"sameTerm(?{writer.name_of(v)}, {written_term(t)})" for v, t in zip(self.shared, r, strict=True))
            return f"SELECT {head} WHERE {{ {writer._inner(self.body)} FILTER({' || '.join(f'({one(r)})' for r in rows)}) }}"
        branches = []
        for i, r in enumerate(rows):
            binds = "" if way != "union" else "".join(f" BIND({written_term(t)} AS ?{writer.name_of(v)})" for v, t in zip(self.shared, r, strict=True))
            mark = "" if way == "union" else f" BIND({i} AS ?row_)"
            branches.append(f"{{ {writer._inner(self._with(r, i))}{binds}{mark} }}")
        return f"SELECT {head if way == 'union' else '*'} WHERE {{ {' UNION '.join(branches)} }}"

    def read(self, answer: dict, rows: list[list[dict]]) -> list[list]:
        if self.way not in ("rename", "nested"):
            return _rows(answer, [writer.name_of(v) for v in self.variables])
        out = []
        for b in answer["results"]["bindings"]:
            i = int(b["row_"]["value"])
            given = dict(zip(self.shared, rows[i], strict=True))
            name = lambda v, i=i: writer.name_of(f"{v}_{i}" if self.way == "rename" else v)
            out.append([given[v] if v in given else as_dynamic(b.get(name(v))) for v in self.variables])
        return out

    def answered(self, request: Callable[[str], dict], rows: list[list[dict]], silent: bool):
        """Rows of the answers for all bindings; fewer are sent at a time when a request fails."""
        at = 0
        while at < len(rows):
            part = rows[at : at + self.size]
            try:
                found = self.read(request(self.text(part)), part)
            except Exception:
                if self.way == "values-or-filter":
                    self.way = "filter"
                    continue
                if self.size > LEAST:
                    self.size = max(LEAST, self.size // 2)
                    continue
                if not silent:
                    raise
                found = [[dict(zip(self.shared, r, strict=True)).get(v) for v in self.variables] for r in part]
            yield found
            at += len(part)


class RemoteMember(Member):
    """An endpoint by its address. request: how it is asked, ask() unless another way is given (as in tests).

    bindings: one of WAYS. parallel: tasks that ask the endpoint at a time, each one request after the other.
    """

    #: SERVICE clauses are sent as they are.
    whole = True

    def __init__(self, endpoint: str, request: Callable[[str, str], dict] = ask, vocabulary=None, bindings: str = "values", parallel: int = PARALLEL):
        super().__init__([], vocabulary)
        if bindings not in WAYS:
            raise ValueError(f"bindings are sent by one of {WAYS}")
        self.endpoint, self.request, self.way, self.parallel = endpoint, request, bindings, parallel
        for f in (ask, request, writer.pattern, A.Iri):  # executors need not have the modules
            name = getattr(f, "__module__", None)
            if name in sys.modules and name != "__main__":
                cloudpickle.register_pickle_by_value(sys.modules[name])

    def matching(self, t: A.Triple) -> list:
        return [self]  # what the endpoint has is not known here

    def _read(self, source: DataFrame, run, variables: list[str], certain: set[str]) -> R.Rel:
        schema = ", ".join(f"`{R.column_name(v)}` {T.DYNAMIC}" for v in variables) or "unit boolean"
        df = source.mapInPandas(run, schema)
        # blank nodes of different members never meet
        terms = {}
        for v in variables:
            c = F.col(R.column_name(v))
            scoped = F.struct(c["k"].alias("k"), F.concat(F.lit(f"_:{zlib.crc32(self.endpoint.encode())}-"), c["v"]).alias("v"), c["dt"].alias("dt"), c["lang"].alias("lang"))
            terms[v] = Term(T.DYN, F.when(c["k"] == T.BNODE, scoped).otherwise(c))
        return R.made(df, terms, certain)

    def evaluate(self, spark: SparkSession, triples: tuple[A.Triple, ...]) -> R.Rel:
        return self.fetch(spark, A.Bgp(triples))

    def bind(self, left: R.Rel, triples: tuple[A.Triple, ...]) -> R.Rel | None:
        return self.bind_body(left, A.Bgp(triples))

    def fetch(self, spark: SparkSession, body: A.Op, silent: bool = False) -> R.Rel:
        """All solutions of a pattern, page by page. silent: one without bindings where the endpoint fails."""
        variables = sorted(A.possible(body))
        names = [writer.name_of(v) for v in variables]
        endpoint, request, columns = self.endpoint, self.request, [R.column_name(v) for v in variables] or ["unit"]
        head = " ".join(f"?{n}" for n in names) or "*"
        query = f"SELECT {head} WHERE {{ {writer.pattern(body)} }}" + (f" ORDER BY {head}" if names else "")

        def run(batches):
            for _ in batches:
                offset = 0
                while True:
                    try:
                        rows = _rows(request(endpoint, f"{query} LIMIT {PAGE} OFFSET {offset}"), names)
                    except Exception:
                        if not silent or offset:
                            raise
                        rows = [[None] * len(names)]
                    yield pd.DataFrame([r or [True] for r in rows], columns=columns)
                    if len(rows) < PAGE:
                        break
                    offset += PAGE

        return self._read(spark.range(0, 1, 1, 1), run, variables, set() if silent else A.certain(body))

    def bind_body(self, left: R.Rel, body: A.Op, silent: bool = False) -> R.Rel | None:
        """The pattern's solutions that can join with left; None if no variable lends itself to that."""
        variables = sorted(A.possible(body))
        shared = [v for v in variables if v in left.certain]
        if not shared:
            return None
        keys = left.df.select(*[T.dynamic(left.term(v)).alias(f"k{i}") for i, v in enumerate(shared)]).distinct()
        for i in range(len(shared)):
            keys = keys.filter(F.col(f"k{i}.k") != T.BNODE)
        made = Requests(body, variables, shared, self.way)
        endpoint, request, columns = self.endpoint, self.request, [R.column_name(v) for v in variables]

        def run(batches):
            held: list[list] = []  # answers are small, and each frame costs its own conversion
            for b in batches:
                rows = [list(r) for r in b.itertuples(index=False, name=None)]
                for found in made.answered(lambda text: request(endpoint, text), rows, silent):
                    held += found
                    if len(held) >= PAGE:
                        yield pd.DataFrame(held, columns=columns)
                        held = []
            if held:
                yield pd.DataFrame(held, columns=columns)

        certain = set(shared) | (set() if silent else A.certain(body))
        return self._read(keys.repartition(self.parallel), run, variables, certain)

    def cardinality(self, spark: SparkSession, triples: tuple[A.Triple, ...]) -> int:
        """How many solutions a pattern has: the endpoint counts."""
        text = f"SELECT (COUNT(*) AS ?n) WHERE {{ {writer.pattern(A.Bgp(triples))} }}"
        return int(self.request(self.endpoint, text)["results"]["bindings"][0]["n"]["value"])
