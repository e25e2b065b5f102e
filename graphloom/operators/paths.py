"""Property paths over a member, as joins, unions and fix points of pairs of terms."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.terms import Term
from graphloom.operators import relation as R
from graphloom.operators.scratch import discard, written
from graphloom.plans import algebra as A
from graphloom.sources.views import Member

S, O = "_:s", "_:o"  # noqa: E741  the ends of a path


def _renamed(rel: R.Rel, names: dict[str, str]) -> R.Rel:
    return R.made(rel.df, {names.get(v, v): t for v, t in rel.env().items() if names.get(v, v)}, {names.get(v, v) for v in rel.certain})


def pairs(spark: SparkSession, member: Member, path, start: Term | None = None, end: Term | None = None) -> R.Rel:
    """Bindings of S and O; a bag but for repetitions, which are sets. A fixed start or end narrows repetitions."""
    if isinstance(path, A.Iri):
        return member.evaluate(spark, (A.Triple(A.Var(S), path, A.Var(O)),))
    if isinstance(path, A.PInv):
        return _renamed(pairs(spark, member, path.part, end, start), {S: O, O: S})
    if isinstance(path, A.PAlt):
        return R.union([pairs(spark, member, p, start, end) for p in path.parts])
    if isinstance(path, A.PNeg):
        found = []
        for names, ends in ((path.forward, (S, O)), (path.inverse, (O, S))):
            if not names and not (ends == (S, O) and not path.inverse):
                continue
            every = member.evaluate(spark, (A.Triple(A.Var(ends[0]), A.Var("_:p"), A.Var(ends[1])),))
            p = T.lexical(every.term("_:p"))
            kept = R.filter_(every, [~p.isin(*names)] if names else [])
            found.append(R.project(kept, [S, O]))
        return R.union(found)
    if isinstance(path, A.PSeq):
        out = None
        for i, part in enumerate(path.parts):
            last = i == len(path.parts) - 1
            step = pairs(spark, member, part, start if not i else None, end if last else None)
            step = _renamed(step, {S: f"_:m{i}" if i else S, O: O if last else f"_:m{i + 1}"})
            out = step if out is None else R.join(out, step)
        return R.project(out, [S, O])
    if isinstance(path, A.PRep):
        return _repeated(spark, member, path, start, end)
    raise NotImplementedError(f"path {path}")


def _repeated(spark: SparkSession, member: Member, path: A.PRep, start: Term | None, end: Term | None) -> R.Rel:
    once = R.distinct(_dynamic(pairs(spark, member, path.part)))
    if not path.many:
        return R.distinct(R.union([once, _same(spark, member, start, end)]))
    if start is not None or end is not None:
        reached = _reached(once, start if start is not None else end, start is None)
    else:
        reached = _closure(once)
    if path.least:
        return reached
    return R.distinct(R.union([reached, _same(spark, member, start, end)]))


def _dynamic(rel: R.Rel) -> R.Rel:
    return R.made(rel.df, {v: Term(T.DYN, T.dynamic(rel.term(v))) for v in (S, O)}, {S, O})


def _same(spark: SparkSession, member: Member, start: Term | None, end: Term | None) -> R.Rel:
    """Pairs of a term with itself: of the fixed end, or of all subjects and objects."""
    fixed = start if start is not None else end
    if fixed is not None:
        one = Term(T.DYN, T.dynamic(fixed))
        return R.made(spark.range(1), {S: one, O: one}, {S, O})
    every = _dynamic(R.project(member.evaluate(spark, (A.Triple(A.Var(S), A.Var("_:p"), A.Var(O)),)), [S, O]))
    nodes = [R.made(every.df, {S: every.term(v), O: every.term(v)}, {S, O}) for v in (S, O)]
    return R.distinct(R.union(nodes))


def _closure(edges: R.Rel) -> R.Rel:
    """All pairs that one or more edges connect: paths double in length with each round."""
    a, b = R.column_name(S), R.column_name(O)
    now = written(edges.df.select(a, b), "closure")
    size = now.count()
    while True:
        longer = now.alias("x").join(now.alias("y"), F.col(f"x.{b}") == F.col(f"y.{a}")).select(F.col(f"x.{a}"), F.col(f"y.{b}"))
        after = written(now.unionByName(longer).distinct(), "closure")
        n = after.count()
        discard(now)
        if n == size:
            return R.Rel(after, dict(edges.descs), frozenset({S, O}))
        now, size = after, n


def _reached(edges: R.Rel, fixed: Term, backwards: bool) -> R.Rel:
    """Pairs of a fixed term with all that edges lead to from it (or from which they lead to it)."""
    a, b = R.column_name(S), R.column_name(O)
    near, far = (b, a) if backwards else (a, b)
    edge = written(edges.df.select(a, b), "edges")
    seen = written(edge.filter(F.col(near) == T.dynamic(fixed)).select(F.col(far).alias("t")).distinct(), "seen")
    front = seen
    while not front.isEmpty():
        step = front.join(edge, F.col("t") == F.col(near)).select(F.col(far).alias("t")).distinct()
        new = written(step.join(seen.withColumnRenamed("t", "k"), F.col("t") == F.col("k"), "left_anti"), "front")
        longer = written(seen.unionByName(new), "seen")
        if front is not seen:
            discard(front)
        discard(seen)
        front, seen = new, longer
    if front is not seen:
        discard(front)
    discard(edge)
    one = Term(T.DYN, T.dynamic(fixed))
    ends = {near: one, far: Term(T.DYN, F.col("t"))}
    return R.made(seen, {S: ends[a], O: ends[b]}, {S, O})


def scan(spark: SparkSession, member: Member, t: A.Triple) -> R.Rel:
    """A triple whose predicate is a path: its ends matched with the pairs of the path."""
    fixed = [T.constant(x) if isinstance(x, (A.Iri, A.Lit)) else None for x in (t.s, t.o)]
    found = pairs(spark, member, t.p, *fixed)
    conditions, terms = [], {}
    for x, v in ((t.s, S), (t.o, O)):
        term = found.term(v)
        if isinstance(x, A.Var):
            if x.name in terms:
                same = T.same(terms[x.name], term)
                conditions.append(F.lit(False) if same is None else same)
            else:
                terms[x.name] = term
        else:
            c = T.is_constant(term, x)
            conditions.append(F.lit(False) if c is False else c)
    kept = R.filter_(found, conditions)
    return R.made(kept.df, terms, terms)
