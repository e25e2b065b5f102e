"""The algebra as one DataFrame plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.compile import Compiler
from graphloom.functions.terms import Term
from graphloom.operators import paths
from graphloom.operators import relation as R
from graphloom.plans import algebra as A
from graphloom.sources.views import GraphsMember, in_graph, of_graphs
from graphloom.sources.vocabulary import translate


class Lowering:
    def __init__(self, spark: SparkSession, members: dict, hint: str | None = None, graphs: dict | None = None):
        self.spark, self.members, self.hint = spark, members, hint
        #: The members as GRAPH sees them, if FROM clauses give it others.
        self.graphs = members if graphs is None else graphs

    def rel(self, op: A.Op) -> R.Rel:
        return getattr(self, "_" + type(op).__name__.lower())(op)

    # ---- leaves

    def _unit(self, op: A.Unit) -> R.Rel:
        return R.unit(self.spark)

    def _nothing(self, op: A.Nothing) -> R.Rel:
        return R.nothing(self.spark, op.vars)

    def _request(self, op: A.Request) -> R.Rel:
        return self.members[op.member].evaluate(self.spark, op.triples)

    def _remote(self, op: A.Remote) -> R.Rel:
        return self.members[op.member].fetch(self.spark, op.body.op, op.silent)

    def _pathscan(self, op: A.PathScan) -> R.Rel:
        return paths.scan(self.spark, self.members[op.member], op.triple)

    def _values(self, op: A.Values) -> R.Rel:
        """Rows of constants; UNDEF is unbound."""
        if not op.rows:
            return R.nothing(self.spark, op.vars)
        descs = {}
        for i, v in enumerate(op.vars):
            given = [T.constant(r[i]).desc for r in op.rows if r[i] is not None]
            descs[v] = T.aligned(given) if given else T.literal(T.STRING)
        rows = []
        for r in op.rows:
            cells = [(T.as_(T.constant(x), descs[v]) if x is not None else T.null_of(descs[v])).alias(R.column_name(v)) for v, x in zip(op.vars, r, strict=True)]
            rows.append(F.struct(*cells) if cells else F.struct(F.lit(True).alias("unit")))
        df = self.spark.range(1).select(F.inline(F.array(*rows)))
        return R.Rel(df, descs, frozenset(A.certain(op)))

    def _graph(self, op: A.Graph) -> R.Rel:
        """The pattern in one named graph, or, for a variable, in each of those that the members have.

        A variable is a column like others: the graph that a triple is in, by which patterns are joined.
        """
        if isinstance(op.target, A.Iri):
            return Lowering(self.spark, _Graphs(self.graphs, op.target.value), self.hint).rel(op.child)
        if _paths_in(op.child):  # a path stays within one graph: a branch for each graph's name
            names = sorted(r["g"] for r in self._graph_names().collect())
            parts = [A.Extend(op.target.name, A.Const(A.Iri(n)), A.Graph(A.Iri(n), op.child)) for n in names]
            return R.union([self.rel(p) for p in parts]) if parts else R.nothing(self.spark, A.possible(op))
        inside = Lowering(self.spark, _Graphs(self.graphs, A.Var(op.target.name)), self.hint).rel(op.child)
        if op.target.name in inside.certain:
            return inside
        every = R.made(self._graph_names(), {op.target.name: Term(T.PLAIN_IRI, F.col("g"))}, {op.target.name})
        return R.join(inside, every)

    def _dataset(self, op: A.Dataset) -> R.Rel:
        """Members with named graphs show those that FROM names, merged, and to GRAPH those of FROM NAMED."""
        of = lambda names, merged: {k: of_graphs(m, names, merged) for k, m in self.members.items()}
        return Lowering(self.spark, of(op.default, True), self.hint, of(op.named, False)).rel(op.child)

    def _graph_names(self) -> DataFrame:
        """The names of all graphs of the members (a column g), each once."""
        found = [v.rows.df.select(v.graph.alias("g")) for m in self.graphs.values() for v in m.views if v.graph is not None]
        return reduce(DataFrame.unionByName, found, self.spark.createDataFrame([], "g string")).filter("g is not null").distinct()

    # ---- joins

    def _join(self, op: A.Join) -> R.Rel:
        """Parts joined in turn; a remote member's part is asked with the bindings of those before it."""
        out = None
        for p in op.parts:
            out = self.rel(p) if out is None else R.join(out, self._bound(out, p), self.hint)
        return R.unit(self.spark) if out is None else out

    def _bound(self, left: R.Rel, op: A.Op) -> R.Rel:
        found = None
        if isinstance(op, A.Remote):
            found = self.members[op.member].bind_body(left, op.body.op, op.silent)
        elif isinstance(op, A.Request) and hasattr(member := self.members[op.member], "bind"):
            found = member.bind(left, op.triples)
        return self.rel(op) if found is None else found

    def _leftjoin(self, op: A.LeftJoin) -> R.Rel:
        left = self.rel(op.left)
        right = self._bound(left, op.right)
        conditions = (lambda env: [Compiler(env).condition(c) for c in op.conditions]) if op.conditions else None
        return R.left_join(left, right, conditions)

    def _minus(self, op: A.Minus) -> R.Rel:
        return R.minus(self.rel(op.left), self.rel(op.right))

    def _union(self, op: A.Union) -> R.Rel:
        return R.union([self.rel(p) for p in op.parts])

    def _lookup(self, op: A.LookUp) -> R.Rel:
        """The distinct parameters of the input, documents for them, the pattern over those, joined back."""
        member = self.members[op.member]
        left = self.rel(op.child)
        given = {name: var for var, name in op.params}
        if missing := [n for n, (_, required) in member.params.items() if required and n not in given]:
            raise ValueError(f"{op.member} needs the parameters {missing}")
        names = [n for n in member.params if n in given]
        keys = {}
        for n in names:
            t = left.term(given[n]) if given[n] in left.descs else T.null()
            ok = t.col.isNotNull()
            if (dt := member.params[n][0]) and t.desc.kind == "lit" and dt != T.STRING and t.desc.dt != dt and not (t.numeric and dt in T.NUMERIC):
                ok = F.lit(False)  # a value of another type is none
            keys[n] = F.when(ok, T.lexical(t))
        df = left.df.select("*", *[k.alias(f"_key_{n}") for n, k in keys.items()])
        for n in names:
            if member.params[n][1]:
                df = df.filter(F.col(f"_key_{n}").isNotNull())
        asked = df.select(*[F.coalesce(F.col(f"_key_{n}"), F.lit("")).alias(n) for n in names]).distinct()
        local = dict(self.members) | {op.member: member.member(asked)}
        right = Lowering(self.spark, local, self.hint).rel(op.body)
        terms = left.env() | {f"_key_{n}": Term(T.literal(T.STRING), F.coalesce(F.col(f"_key_{n}"), F.lit(""))) for n in names}
        keyed = R.made(df, terms, left.certain | {f"_key_{n}" for n in names})
        back = R.made(right.df, {(f"_key_{v}" if v in names and v in right.descs else v): t for v, t in right.env().items()}, {(f"_key_{v}" if v in names else v) for v in right.certain})
        out = R.left_join(keyed, back) if op.optional else R.join(keyed, back)
        return R.project(out, [v for v in out.descs if not v.startswith("_key_")])

    # ---- unary

    def _filter(self, op: A.Filter) -> R.Rel:
        rel = self.rel(op.child)
        plain: list[Column] = []
        for c in op.conditions:
            negated, e = (True, c.args[0]) if isinstance(c, A.Call) and c.name == "!" and isinstance(c.args[0], A.Exists) else (False, c)
            if isinstance(e, A.Exists):
                rel = self._exists(rel, e.pattern, e.negated != negated)
            else:
                rel, env = self._flagged(rel, e)
                plain.append(Compiler(env[0], env[1]).condition(e))
        out = R.filter_(rel, plain)
        return R.project(out, [v for v in out.descs if not v.startswith("_flag")])

    def _exists(self, rel: R.Rel, pattern: A.Op, negated: bool) -> R.Rel:
        """A semi-join; conditions of the pattern that speak of outer variables join its condition."""
        inner: tuple = ()
        if isinstance(pattern, A.Filter):
            own = A.possible(pattern.child)
            inner = tuple(c for c in pattern.conditions if not A.expr_vars(c) <= own)
            rest = tuple(c for c in pattern.conditions if c not in inner)
            pattern = A.Filter(rest, pattern.child) if rest else pattern.child
        condition = (lambda env: [Compiler(env).condition(c) for c in inner]) if inner else None
        return R.semi_join(rel, self.rel(pattern), negated, condition)

    def _flagged(self, rel: R.Rel, e) -> tuple[R.Rel, tuple]:
        """rel with a column for each EXISTS inside an expression, and how to compile it with them."""
        found: list[A.Exists] = []

        def look(x):
            if isinstance(x, A.Exists):
                found.append(x)
            elif isinstance(x, A.Call):
                for a in x.args:
                    look(a)

        look(e)
        flags = {}
        for i, x in enumerate(found):
            right = self.rel(x.pattern)
            shared = [v for v in rel.descs if v in right.descs]
            flag, seen = f"_flag{i}", Term(T.literal(T.BOOLEAN), F.lit(True))
            if all(v in rel.certain and v in right.certain for v in shared):
                keys = R.distinct(R.project(right, shared))
                rel = R.left_join(rel, R.extend(keys, flag, seen, True))
            else:  # variables that may be unbound: rows with a partner, and those without
                rel = R.union([R.extend(R.semi_join(rel, right), flag, seen), R.semi_join(rel, right, True)])
            flags[x] = (flag, x.negated)

        def exists(x: A.Exists) -> Term:
            flag, negated = flags[x]
            seen = rel.term(flag).col.isNotNull()
            return Term(T.literal(T.BOOLEAN), ~seen if negated else seen)

        return rel, (rel.env(), exists)

    def _extend(self, op: A.Extend) -> R.Rel:
        rel = self.rel(op.child)
        rel, (env, exists) = self._flagged(rel, op.expr)
        out = R.extend(rel, op.var, Compiler(env, exists).term(op.expr), op.var in A.certain(op))
        return R.project(out, [v for v in out.descs if not v.startswith("_flag")])

    def _unfold(self, op: A.Unfold) -> R.Rel:
        rel = self.rel(op.child)
        return R.unfold(rel, Compiler(rel.env()).term(op.expr), op.first, op.second)

    def _project(self, op: A.Project) -> R.Rel:
        return R.project(self.rel(op.child), list(op.vars))

    def _distinct(self, op: A.Distinct) -> R.Rel:
        return R.distinct(self.rel(op.child))

    def _orderby(self, op: A.OrderBy) -> R.Rel:
        rel = self.rel(op.child)
        compiler = Compiler(rel.env())
        return R.order(rel, [(compiler.term(e), up) for e, up in op.keys])

    def _slice(self, op: A.Slice) -> R.Rel:
        return R.slice_(self.rel(op.child), op.offset, op.limit)

    def _group(self, op: A.Group) -> R.Rel:
        rel = self.rel(op.child)
        for name, e in op.keys:
            if e is not None:
                rel = R.extend(rel, name, Compiler(rel.env()).term(e))
        return R.group(rel, [k for k, _ in op.keys], list(op.aggs))

    def _translate(self, op: A.Translate) -> R.Rel:
        return translate(self.rel(op.child), op.mapping, op.to_global)


class _Graphs(dict):
    """Members seen through one named graph, or with a variable for the graph of each triple."""

    def __init__(self, members, graph: str | A.Var):
        if isinstance(graph, A.Var):
            super().__init__({k: GraphsMember(m, graph.name) for k, m in members.items()})
        else:
            super().__init__({k: in_graph(m, graph) for k, m in members.items()})


def _paths_in(op: A.Op) -> bool:
    return isinstance(op, A.PathScan) or any(_paths_in(c) for c in op.children())
