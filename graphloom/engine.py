"""Queries over a federation: text in, DataFrame out."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.terms import Term
from graphloom.operators import relation as R
from graphloom.operators.lower import Lowering
from graphloom.plans import algebra as A
from graphloom.plans import rules
from graphloom.sparql.parser import parse

TRIPLE_COLUMNS = ["s", "p", "o", "dt", "lang"]


class Engine:
    """members: IRI -> member; default: members that answer patterns outside of any SERVICE.

    counting: joins are ordered by the number of solutions of each request, which the members are asked for once
    (a job each); otherwise by a guess from the patterns, and AQE does the rest. join: a hint for how inner joins
    are made (merge, shuffle_hash, shuffle_replicate_nl); Spark chooses by itself without one.
    """

    def __init__(self, spark: SparkSession, members: dict, default: tuple[str, ...] = (), optimize: bool = True, counting: bool = False, join: str | None = None):
        self.spark, self.members, self.default, self.rewriting, self.counting = spark, members, tuple(default), optimize, counting
        self.counts: dict[A.Request, int] = {}
        self.join = join
        self.measured: dict[str, float] = {}

    # ---- planning

    def assigned(self, query: A.Query) -> A.Op:
        """The plan with its requests, before rewriting."""
        return rules.assign(rules.expand_services(query.body), self.members, self.default)

    def plan(self, query: A.Query) -> A.Op:
        op = self.assigned(query)
        if self.rewriting:
            return rules.optimize(op, self.members, self._count if self.counting else None)
        return rules.apply_vocabularies(op, self.members)

    def _count(self, request: A.Request) -> int:
        if request not in self.counts:
            self.counts[request] = self.members[request.member].cardinality(self.spark, request.triples)
        return self.counts[request]

    def lower(self, op: A.Op) -> R.Rel:
        return Lowering(self.spark, self.members, self.join).rel(op)

    def explain(self, text: str) -> str:
        query = parse(text)
        return f"assigned\n{A.show(self.assigned(query))}\n\noptimized\n{A.show(self.plan(query))}"

    # ---- results

    def select(self, text: str) -> DataFrame:
        """A SELECT query's solutions, one column per variable: native literals, other terms as strings."""
        began = time.perf_counter()
        query = parse(text)
        if query.form != "SELECT":
            raise ValueError(f"a {query.form} query")
        planned = time.perf_counter()
        plan = self.plan(query)
        lowered = time.perf_counter()
        rel = self.lower(plan)
        self.measured = {"parse": planned - began, "plan": lowered - planned, "lower": time.perf_counter() - lowered}
        return rel.df.select(*[T.shown(rel.term(v)).alias(v) for v in rel.descs if not v.startswith("_:")])

    def terms(self, text: str) -> DataFrame:
        """A SELECT query's solutions with all terms in dynamic form: struct<k,v,dt,lang>."""
        rel = self.lower(self.plan(parse(text)))
        return rel.df.select(*[T.dynamic(rel.term(v)).alias(v) for v in rel.descs if not v.startswith("_:")])

    def ask(self, text: str) -> bool:
        """Whether an ASK query has a solution."""
        return not self.lower(self.plan(parse(text))).df.limit(1).isEmpty()

    def construct(self, text: str) -> DataFrame:
        """The triples of a CONSTRUCT query, each once: s, p, o, and o's datatype and language."""
        query = parse(text)
        return self._triples(self.lower(self.plan(query)), query.template)

    def _triples(self, rel: R.Rel, template: list[A.Triple]) -> DataFrame:
        row = F.monotonically_increasing_id().cast("string")
        fresh = any(isinstance(x, A.Var) and x.hidden and x.name not in rel.descs for t in template for x in (t.s, t.p, t.o))
        df = rel.df.withColumn("_row", row) if fresh else rel.df

        def term(x) -> Term:
            if isinstance(x, A.Var):
                if x.name in rel.descs:
                    return rel.term(x.name)
                return Term(T.BLANK, F.concat(F.lit(x.name + "-"), F.col("_row"))) if x.hidden else T.null()
            return T.constant(x)

        made = []
        for t in template:
            s, p, o = (T.dynamic(term(x)) for x in (t.s, t.p, t.o))
            fits = (s["k"] != T.LITERAL) & (p["k"] == T.IRI) & o.isNotNull()
            made.append(F.when(fits, F.struct(s["v"].alias("s"), p["v"].alias("p"), o["v"].alias("o"), o["dt"].alias("dt"), o["lang"].alias("lang"))))
        if not made:
            return self.spark.createDataFrame([], "s string, p string, o string, dt string, lang string")
        out = df.select(F.explode(F.array(*made)).alias("t")).filter("t is not null").select("t.*")
        return out.distinct()

    def describe(self, text: str) -> DataFrame:
        """All triples whose subject is one of the described terms, from every member that has triples."""
        query = parse(text)
        fixed = [x for x in query.described if isinstance(x, A.Iri)]
        names = [x.name for x in query.described if isinstance(x, A.Var)]
        wanted: list[R.Rel] = []
        if fixed:
            wanted.append(self.lower(A.Values(("_:s",), tuple((x,) for x in fixed))))
        if names:
            rel = self.lower(self.plan(query))
            wanted += [R.made(rel.df, {"_:s": Term(T.DYN, T.dynamic(rel.term(n)))}, set()) for n in names if n in rel.descs]
        subjects = R.distinct(R.union(wanted))
        subjects = R.Rel(subjects.df.filter(subjects.term("_:s").col.isNotNull()), subjects.descs, frozenset({"_:s"}))
        pattern = A.Triple(A.Var("_:s"), A.Var("_:p"), A.Var("_:o"))
        found = [R.join(subjects, m.evaluate(self.spark, (pattern,))) for m in self.members.values() if not hasattr(m, "params")]
        return self._triples(R.union(found), [pattern])

    def cardinality(self, member: str, text: str) -> int:
        """How many solutions a member has for a basic pattern, given as the body of a query."""
        body = parse(f"SELECT * WHERE {{ {text} }}").body
        while not isinstance(body, A.Bgp):
            body = body.children()[0]
        return self.members[member].cardinality(self.spark, body.triples)
