"""Bags of solution mappings as DataFrames, and the operators on them.

A relation has a nullable column per variable (NULL: unbound) and knows which variables every row binds. Those
give plain equi-joins; the others make a join's condition weaker, and are split off into branches where that
saves a nested loop.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.compile import Compiler, collection, number
from graphloom.functions.terms import Desc, Term
from graphloom.plans import algebra as A


def column_name(var: str) -> str:
    """A column name that differs from others by more than case."""
    return "v_" + "".join(c if c.islower() or c.isdigit() else f"_{ord(c):x}_" for c in var)


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    descs: dict[str, Desc]
    certain: frozenset

    def term(self, var: str, mark: str = "") -> Term:
        return Term(self.descs[var], F.col(column_name(var) + mark))

    def env(self, mark: str = "") -> dict[str, Term]:
        return {v: self.term(v, mark) for v in self.descs}

    def marked(self, mark: str) -> DataFrame:
        return self.df.select(*(self.cols(mark) or [F.lit(True).alias("unit" + mark)]))

    def cols(self, mark: str = "") -> list[Column]:
        return [F.col(column_name(v)).alias(column_name(v) + mark) for v in self.descs]


def made(df: DataFrame, terms: dict[str, Term], certain) -> Rel:
    """A relation of these terms over df; a triple term is kept in dynamic form."""
    cols, descs = [], {}
    for v, t in terms.items():
        if t.desc.kind == "triple":
            t = Term(T.DYN, T.dynamic(t))
        cols.append(t.col.alias(column_name(v)))
        descs[v] = t.desc
    return Rel(df.select(*(cols or [F.lit(True).alias("unit")])), descs, frozenset(certain) & set(descs))


def unit(spark: SparkSession) -> Rel:
    return Rel(spark.range(1).select(F.lit(True).alias("unit")), {}, frozenset())


def nothing(spark: SparkSession, variables) -> Rel:
    df = spark.range(0)
    return made(df, {v: T.null() for v in variables}, variables)


def _rel(df: DataFrame, terms: dict[str, Term], certain) -> Rel:
    return made(df, terms, certain)


# ---- joins


def _matching(left: Rel, right: Rel, mark: str) -> tuple[list[Column] | None, list[Column]]:
    """(equalities of variables that both sides always bind, conditions on others); None if nothing can match."""
    hard, soft = [], []
    for v in left.descs:
        if v not in right.descs:
            continue
        a, b = left.term(v), right.term(v, mark)
        equal = T.same(a, b)
        if v in left.certain and v in right.certain:
            if equal is None:
                return None, []
            hard.append(equal)
        else:
            either = a.col.isNull() | b.col.isNull()
            soft.append(either if equal is None else either | equal)
    return hard, soft


def _merged(left: Rel, right: Rel, mark: str) -> dict[str, Term]:
    out = {}
    for v in left.descs:
        a = left.term(v)
        if v in right.descs and v not in left.certain:
            b = right.term(v, mark)
            d = T.aligned([a.desc, b.desc])
            a = Term(d, F.coalesce(T.as_(a, d), T.as_(b, d)))
        out[v] = a
    for v in right.descs:
        if v not in left.descs:
            out[v] = right.term(v, mark)
    return out


def _split(rel: Rel, var: str) -> tuple[Rel, Rel]:
    """The rows that bind a variable, and those that do not, without it."""
    bound = Rel(rel.df.filter(rel.term(var).col.isNotNull()), rel.descs, rel.certain | {var})
    rest = {v: d for v, d in rel.descs.items() if v != var}
    free = rel.df.filter(rel.term(var).col.isNull())
    return bound, Rel(free.select(*[F.col(column_name(v)) for v in rest] or [F.lit(True).alias("unit")]), rest, rel.certain - {var})


def join(left: Rel, right: Rel, hint: str | None = None) -> Rel:
    mark = "__r"
    spark = left.df.sparkSession
    hard, soft = _matching(left, right, mark)
    variables = [*left.descs, *[v for v in right.descs if v not in left.descs]]
    certain = left.certain | right.certain
    if hard is None:
        return nothing(spark, variables)
    if soft and not hard:
        var = next(v for v in left.descs if v in right.descs)
        parts = [(a, b) for a in ([left] if var in left.certain else _split(left, var)) for b in ([right] if var in right.certain else _split(right, var))]
        out = union([join(a, b) for a, b in parts])
        return Rel(out.df, out.descs, frozenset(certain))
    r = right.marked(mark)
    if hint:
        r = r.hint(hint)
    conditions = hard + soft
    df = left.df.join(r, reduce(lambda x, y: x & y, conditions)) if conditions else left.df.crossJoin(r)
    return _rel(df, _merged(left, right, mark), certain)


Condition = Callable[[dict[str, Term]], list[Column]] | None


def _sides(left: Rel, right: Rel) -> tuple[list[Rel], list[Rel]]:
    """Both relations split by the first variable that they share and that one of them may leave unbound.

    In each pair of parts the variable is certain on both sides, and so an equality, or not shared any more.
    """
    var = next(v for v in left.descs if v in right.descs and not (v in left.certain and v in right.certain))
    return tuple([r] if var in r.certain else list(_split(r, var)) for r in (left, right))


def left_join(left: Rel, right: Rel, condition: Condition = None) -> Rel:
    mark = "__r"
    hard, soft = _matching(left, right, mark)
    if hard is None:
        terms = left.env() | {v: T.null() for v in right.descs if v not in left.descs}
        return _rel(left.df, terms, left.certain)
    if soft and not hard:
        # what joins, and what finds no partner: both by parts that meet by equality
        joined = join(left, right)
        met = filter_(joined, condition(joined.env())) if condition else joined
        out = union([met, semi_join(left, right, True, condition)])
        return Rel(out.df, out.descs, left.certain)
    conditions = hard + soft
    if condition:
        conditions = conditions + condition(_merged(left, right, mark))
    on = reduce(lambda x, y: x & y, conditions) if conditions else F.lit(True)
    df = left.df.join(right.marked(mark), on, "left")
    return _rel(df, _merged(left, right, mark), left.certain)


def semi_join(left: Rel, right: Rel, negated: bool = False, condition: Condition = None) -> Rel:
    """Rows of left with (without, if negated) a compatible row of right."""
    mark = "__r"
    hard, soft = _matching(left, right, mark)
    if hard is None:
        return left if negated else Rel(left.df.limit(0), left.descs, left.certain)
    if soft and not hard:
        lefts, rights = _sides(left, right)
        found = []
        for part in lefts:
            for r in rights:  # a row goes with the first part of right that has a partner for it
                if not negated:
                    found.append(semi_join(part, r, False, condition))
                part = semi_join(part, r, True, condition)
            if negated:
                found.append(part)
        out = union(found)
        missing = {v: T.null_of(d).alias(column_name(v)) for v, d in left.descs.items() if v not in out.descs}
        return Rel(out.df.select("*", *missing.values()), {v: out.descs.get(v, d) for v, d in left.descs.items()}, left.certain)
    conditions = hard + soft + (condition(_merged(left, right, mark)) if condition else [])
    if not conditions:  # whether right has rows at all: one of them tells
        right = replace(right, df=right.df.limit(1))
    on = reduce(lambda x, y: x & y, conditions) if conditions else F.lit(True)
    return Rel(left.df.join(right.marked(mark), on, "left_anti" if negated else "left_semi"), left.descs, left.certain)


def minus(left: Rel, right: Rel) -> Rel:
    """Rows of left without a compatible row of right that shares a bound variable with it."""
    shared = [v for v in left.descs if v in right.descs]
    if not shared:
        return left
    hard, soft = _matching(left, right, "__r")
    if hard is None:
        return left
    if hard:
        return semi_join(left, right, True)
    # split by a variable: where both sides bind it, it is shared; elsewhere the other variables decide
    var = shared[0]
    bound, *free = [left] if var in left.certain else _split(left, var)
    given, *open_ = [right] if var in right.certain else _split(right, var)
    bound = semi_join(bound, given, True)
    for r in open_:
        bound = minus(bound, r)
    out = union([bound, *(minus(part, right) for part in free)])
    return Rel(out.df, out.descs, left.certain)


# ---- others


def union(rels: list[Rel]) -> Rel:
    if len(rels) == 1:
        return rels[0]
    variables = list(dict.fromkeys(v for r in rels for v in r.descs))
    descs = {v: T.aligned([r.descs[v] for r in rels if v in r.descs]) for v in variables}
    dfs = []
    for r in rels:
        cols = [(T.as_(r.term(v), descs[v]) if v in r.descs else T.null_of(descs[v])).alias(column_name(v)) for v in variables]
        dfs.append(r.df.select(*(cols or [F.lit(True).alias("unit")])))
    certain = frozenset.intersection(*[r.certain for r in rels])
    return Rel(reduce(lambda a, b: a.unionByName(b), dfs), descs, certain)


def filter_(rel: Rel, conditions: list[Column]) -> Rel:
    return replace(rel, df=rel.df.filter(reduce(lambda x, y: x & y, conditions))) if conditions else rel


def extend(rel: Rel, var: str, term: Term, certain: bool = False) -> Rel:
    return _rel(rel.df, rel.env() | {var: term}, rel.certain | ({var} if certain else set()))


def unfold(rel: Rel, term: Term, first: str, second: str | None) -> Rel:
    """List members with their positions from 1, map entries; an empty one gives no row, other terms keep theirs.

    A list's members go to `first` and positions to `second`; a map's keys go to `first`, values to `second`.
    """
    parts = []
    keep = rel.env()
    dynamic = term.desc.kind == "dyn"
    if dynamic or term.is_(T.LIST):
        c = collection(term, T.LIST)
        df = rel.df.select("*", F.posexplode(c).alias("_at", "_item")).filter(c.isNotNull())
        new = {first: _element(term, F.col("_item"), dynamic)}
        if second:
            new[second] = Term(T.literal(A.XSD + "integer"), (F.col("_at") + 1).cast("long"))
        parts.append(_rel(df, keep | new, rel.certain))
    if dynamic or term.is_(T.MAP):
        c = collection(term, T.MAP)
        df = rel.df.select("*", F.explode(c).alias("_key", "_value"))
        new = {first: Term(T.literal(T.STRING), F.col("_key"))}
        if second:
            new[second] = _element(term, F.col("_value"), dynamic)
        parts.append(_rel(df, keep | new, rel.certain))
    whole = [collection(term, k).isNotNull() for k in (T.LIST, T.MAP) if dynamic or term.is_(k)]
    other = rel.df.filter(~reduce(lambda x, y: x | y, whole)) if whole else rel.df
    parts.append(_rel(other, keep, rel.certain))
    return union(parts)


def _element(term: Term, c: Column, dynamic: bool) -> Term:
    return Term(Desc("lit", T.STRING) if dynamic else Desc("lit", term.desc.lang or A.XSD + "double"), c)


def distinct(rel: Rel) -> Rel:
    """Rows once each; maps are compared by their lexical form."""
    terms = {v: Term(T.DYN, T.dynamic(t)) if t.is_(T.MAP) else t for v, t in rel.env().items()}
    out = _rel(rel.df, terms, rel.certain)
    return replace(out, df=out.df.distinct())


def project(rel: Rel, variables: list[str]) -> Rel:
    terms = {v: rel.term(v) if v in rel.descs else T.null() for v in variables}
    return _rel(rel.df, terms, rel.certain & set(variables))


def order_keys(t: Term) -> list[Column]:
    """Columns that sort terms: unbound, blank nodes, IRIs, literals; numbers by value."""
    if t.desc.kind != "dyn":
        return [T.plain(t).col if t.desc.kind == "iri" else t.col]
    value = F.when(t.col["dt"].isin(*T.NUMERIC), t.col["v"].try_cast("double"))
    exact = F.when(value.isNotNull(), t.col["v"].try_cast("decimal(38,10)"))  # whole numbers that doubles cannot tell apart
    return [t.col["k"], value, exact, t.col["v"], t.col["dt"], t.col["lang"]]


def order(rel: Rel, keys: list[tuple[Term, bool]]) -> Rel:
    by = [c.asc_nulls_first() if up else c.desc_nulls_last() for t, up in keys for c in order_keys(t)]
    return replace(rel, df=rel.df.orderBy(*by))


def slice_(rel: Rel, offset: int, limit: int | None) -> Rel:
    df = rel.df.offset(offset) if offset else rel.df
    return replace(rel, df=df.limit(limit) if limit is not None else df)


# ---- groups

#: Aggregates by IRI: callables from a numeric column to an aggregate column (a double).
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "http://jena.apache.org/ARQ/function/aggregate#stdev": F.stddev_samp,
    "http://jena.apache.org/ARQ/function/aggregate#stdevp": F.stddev_pop,
    "http://jena.apache.org/ARQ/function/aggregate#variance": F.var_samp,
    "http://jena.apache.org/ARQ/function/aggregate#varp": F.var_pop,
    "http://jena.apache.org/ARQ/function/aggregate#median": F.median,
}

A.CUSTOM_AGGREGATES.update(AGGREGATES)


def _moments(name: str, c: Column) -> Column:
    """A custom aggregate over the different values of a group: those of its array, for which it has to have room."""
    values = F.array_sort(F.collect_set(c))
    kind = name.rpartition("#")[2]
    n = F.size(values)
    if kind == "median":
        at = lambda i: F.get(values, i.cast("int"))
        return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)
    if name not in _SPREADS:
        raise NotImplementedError(f"{name} of distinct values")
    least, root = _SPREADS[name]
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), n.cast("double"))
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    variance = F.try_divide(squares, (n - least).cast("double"))
    return F.sqrt(variance) if root else variance


#: Of the measures of spread: what is taken off the number of values, and whether a root is drawn.
_SPREADS = {
    "http://jena.apache.org/ARQ/function/aggregate#stdev": (1, True),
    "http://jena.apache.org/ARQ/function/aggregate#stdevp": (0, True),
    "http://jena.apache.org/ARQ/function/aggregate#variance": (1, False),
    "http://jena.apache.org/ARQ/function/aggregate#varp": (0, False),
}


def _unpoisoned(c: Column, value: Column) -> Column:
    """The aggregate, or NULL where a row of the group gave an error."""
    return F.when(F.count(F.lit(1)) == F.count(value), c)


def aggregate(agg: A.Agg, compiler: Compiler) -> tuple[Term, bool]:
    """(term over a group, whether it is always bound)."""
    integer = T.literal(A.XSD + "integer")
    if agg.name == "COUNT":
        if agg.arg is None:
            if not agg.distinct:
                return Term(integer, F.count(F.lit(1))), True
            row = F.struct(F.lit(1).alias("one"), *[t.col.alias(f"c{i}") for i, t in enumerate(compiler.env.values())])
            return Term(integer, F.count_distinct(row)), True
        t = compiler.term(agg.arg)
        return Term(integer, F.count_distinct(T.plain(t).col) if agg.distinct else F.count(t.col)), True
    t = compiler.term(agg.arg)
    if agg.name in ("SUM", "AVG"):
        got = number(t)
        if got is None:
            return Term(integer, F.when(F.count(F.lit(1)) == 0, F.lit(0)).cast("long")), False
        c, rank = got
        if agg.name == "SUM":
            if rank == 0:  # in 64 bits, as all integers here; beyond them unbound, not an error
                made_ = F.sum_distinct(c.cast("decimal(38,0)")).try_cast("long") if agg.distinct else F.try_sum(c.cast("long"))
            else:
                made_ = F.sum_distinct(c) if agg.distinct else F.try_sum(c)
            d = (integer, T.literal(A.XSD + "decimal"), T.literal(A.XSD + "double"))[rank]
            kind = ("long", "decimal(38,18)", "double")[rank]
            return Term(d, _unpoisoned(F.when(F.count(c) == 0, F.lit(0).cast(kind)).otherwise(made_.cast(kind)), c)), False
        if rank < 2:
            exact = "decimal(38,18)"
            n = (F.count_distinct(c) if agg.distinct else F.count(c)).cast("decimal(20,0)")
            c = c.cast("decimal(20,0)" if rank == 0 else exact)
            total = F.sum_distinct(c) if agg.distinct else F.sum(c)
            mean = F.try_divide(total.try_cast(exact), n).try_cast(exact)
            if rank == 0:  # a total that leaves no room for decimals: the whole part first
                whole = F.floor(F.try_divide(total.try_cast("decimal(28,0)"), n))
                rest = F.try_divide((total - whole * n).try_cast(exact), n).try_cast("decimal(20,18)")
                mean = F.coalesce(mean, (whole.cast("decimal(20,0)") + rest).try_cast(exact))
            return Term(T.literal(A.XSD + "decimal"), _unpoisoned(F.when(F.count(c) == 0, F.lit(0).cast(exact)).otherwise(mean), c)), False
        mean = F.avg(c) if not agg.distinct else F.sum_distinct(c) / F.count_distinct(c)
        return Term(T.literal(A.XSD + "double"), _unpoisoned(F.coalesce(mean, F.lit(0.0)), c)), False
    if agg.name in ("MIN", "MAX", "SAMPLE"):
        pick = F.max if agg.name == "MAX" else F.min  # a sample that reruns repeat: the least
        if t.desc.kind == "dyn":
            keyed = F.when(t.col.isNotNull(), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order_keys(t))], t.col.alias("t")))
            return Term(T.DYN, pick(keyed)["t"]), False
        t = T.plain(t)
        return Term(t.desc, pick(t.col)), False
    if agg.name == "GROUP_CONCAT":
        text = T.lexical(t)
        listed = F.collect_set(text) if agg.distinct else F.collect_list(text)
        return Term(T.literal(T.STRING), _unpoisoned(F.array_join(F.array_sort(listed), agg.separator), text)), False
    if agg.name in AGGREGATES:
        got = number(t)
        c = (got[0] if got else F.lit(None)).cast("double")
        made_ = _moments(agg.name, c) if agg.distinct else AGGREGATES[agg.name](c)
        return Term(T.literal(A.XSD + "double"), _unpoisoned(made_, c)), False
    raise NotImplementedError(f"no aggregate {agg.name}")


def group(rel: Rel, keys: list[str], aggs: list[tuple[str, A.Agg]]) -> Rel:
    compiler = Compiler(rel.env())
    terms, columns, certain = {}, [], set()
    for name, agg in aggs:
        t, always = aggregate(agg, compiler)
        columns.append(t.col.alias(column_name(name)))
        terms[name] = t.desc
        if always:
            certain.add(name)
    known = [k for k in keys if k in rel.descs]
    by = [F.col(column_name(k)) for k in known]
    if columns:
        df = rel.df.groupBy(*by).agg(*columns)
    else:
        df = rel.df.select(*by).distinct()
    descs = {k: rel.descs[k] for k in known} | terms
    out = Rel(df, descs, frozenset((rel.certain & set(known)) | certain))
    return project(out, [*keys, *[n for n, _ in aggs]]) if len(known) < len(keys) else out
