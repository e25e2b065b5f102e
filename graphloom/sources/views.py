"""Members as sets of triple views over DataFrames, and the evaluation of patterns over them.

A view says how each row of a DataFrame makes a triple. Triple patterns of one subject that meet views over the
same rows become a single scan; all others are unions of views, joined in a connected order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.terms import Desc, Term
from graphloom.operators import relation as R
from graphloom.plans import algebra as A


@dataclass(frozen=True)
class Rows:
    """A named DataFrame; views with the same name share their rows."""

    name: str
    df: DataFrame
    keys: tuple[str, ...] = ()  # columns of look-up parameters, carried along


@dataclass(frozen=True)
class View:
    rows: Rows
    s: Term
    p: str | Term  # a fixed IRI, or a term per row
    o: Term
    #: A row's subject is no other row's, and the view gives a row one triple at most.
    unique: bool = True
    #: Rows can make the same triple more than once.
    repeats: bool = False
    graph: Column | None = None


def _match(t: Term, x, binds: dict[str, Term], conditions: list[Column]) -> bool:
    """Matches a pattern's position with a term; False if it cannot match."""
    if isinstance(x, A.Var):
        if x.name in binds:
            c = T.same(binds[x.name], t)
            if c is None:
                return False
            conditions.append(c)
        else:
            binds[x.name] = t
        return True
    if isinstance(x, A.Triple):
        return t.desc.kind == "triple" and len(t.parts) == 3 and all(_match(p, y, binds, conditions) for p, y in zip(t.parts, (x.s, x.p, x.o), strict=True))
    c = T.is_constant(t, x)
    if c is False:
        return False
    conditions.append(c)
    return True


def _predicate(view: View) -> Term:
    return Term(T.PLAIN_IRI, F.lit(view.p)) if isinstance(view.p, str) else view.p


def _could(view: View, t: A.Triple) -> bool:
    """Whether a view can hold matches of a pattern, from descriptions only."""
    if isinstance(t.p, A.Iri) and isinstance(view.p, str) and view.p != t.p.value:
        return False
    return _match(view.s, t.s, {}, []) and _match(_predicate(view), t.p, {}, []) and _match(view.o, t.o, {}, [])


def _scan(pairs: list[tuple[A.Triple, View]], given: dict[str, Term] | None = None) -> R.Rel | None:
    """One pass over shared rows for several patterns, with terms that are given; None if they cannot match."""
    rows = pairs[0][1].rows
    binds: dict[str, Term] = dict(given or {})
    conditions: list[Column] = []
    for t, view in pairs:
        if not (_match(view.s, t.s, binds, conditions) and _match(_predicate(view), t.p, binds, conditions) and _match(view.o, t.o, binds, conditions)):
            return None
        for x in (view.s, view.o, *([] if isinstance(view.p, str) else [view.p])):
            conditions += [p.col.isNotNull() for p in x.parts] if x.desc.kind == "triple" else [x.col.isNotNull()]
    for k in rows.keys:
        binds[k] = Term(Desc("lit", T.STRING), F.col(k))
    unique = list({str(c): c for c in conditions}.values())
    df = rows.df.filter(reduce(lambda a, b: a & b, unique)) if unique else rows.df
    out = R.made(df, binds, binds)
    if any(v.repeats for _, v in pairs):
        out = R.distinct(out)
    return out


def _wide(t: A.Triple, views: list[View]) -> list[R.Rel]:
    """A pattern with a variable predicate: one pass over each set of rows, however many views they have."""
    out = []
    by_rows: dict[str, list[View]] = {}
    for v in views:
        by_rows.setdefault(v.rows.name, []).append(v)
    for shared in by_rows.values():
        plain = [v for v in shared if isinstance(v.p, str) and not v.repeats and v.s == shared[0].s and v.s.desc.kind != "triple"]
        if len(plain) < 2:
            out += [r for v in shared if (r := _scan([(t, v)])) is not None]
            continue
        rest = [v for v in shared if v not in plain]
        out += [r for v in rest if (r := _scan([(t, v)])) is not None]
        rows = plain[0].rows
        d = T.aligned([v.o.desc for v in plain])
        pairs = F.array(*[F.struct(F.lit(v.p).alias("p"), T.as_(v.o, d).alias("o")) for v in plain])
        df = rows.df.select("*", F.inline(pairs).alias("_p", "_o")).filter(F.col("_o").isNotNull())
        one = View(Rows(rows.name + "*", df, rows.keys), plain[0].s, Term(T.PLAIN_IRI, F.col("_p")), Term(d, F.col("_o")))
        if (r := _scan([(t, one)])) is not None:
            out.append(r)
    return out


def ordered_join(parts: list[R.Rel], keys: list[str | None] | None = None) -> R.Rel:
    """Joins relations, each with one that shares a variable with those before it, if there is one.

    keys: the variable that tells a part's rows apart. A part that is joined by its own key, or by that of what there
    is so far, goes first: then rows do not multiply.
    """
    left = list(zip(parts, keys or [None] * len(parts), strict=True))
    out, key = left.pop(0)
    while left:
        shared = [set(r.descs) & set(out.descs) for r, _ in left]
        safe = lambda i: left[i][1] in shared[i] or key in shared[i]  # noqa: B023, E731
        i = next((i for i in range(len(left)) if safe(i)), next((i for i, s in enumerate(shared) if s), 0))
        r, own = left.pop(i)
        # rows of `out` find one partner at most, or rows of r do, or neither
        key = key if own in shared[i] else own if key in shared[i] else None
        out = R.join(out, r)
    return out


class Member:
    """A source that answers basic graph patterns. views: its triples."""

    #: Whether it takes single triple patterns only, as a fragment server does.
    single = False

    def __init__(self, views: list[View], vocabulary=None):
        self.views, self.vocabulary = views, vocabulary

    def matching(self, t: A.Triple) -> list[View]:
        return [v for v in self.views if _could(v, t)]

    def evaluate(self, spark: SparkSession, triples: tuple[A.Triple, ...]) -> R.Rel:
        if not triples:
            return R.unit(spark)
        variables = set().union(*[t.variables() for t in triples])
        stars: dict = {}
        parts: list[R.Rel] = []
        keys: list[str | None] = []
        for t in triples:
            views = self.matching(t)
            if not views:
                return R.nothing(spark, variables)
            if len(views) == 1 and views[0].unique and not views[0].repeats:
                stars.setdefault((t.s, views[0].rows.name), []).append((t, views[0]))
                continue
            found = _wide(t, views) if isinstance(t.p, A.Var) else [r for v in views if (r := _scan([(t, v)])) is not None]
            if not found:
                return R.nothing(spark, variables)
            parts.append(R.union(found))
            keys.append(None)
        for pairs in stars.values():
            r = _scan(pairs)
            if r is None:
                return R.nothing(spark, variables)
            parts.insert(0, r)
            keys.insert(0, s.name if isinstance(s := pairs[0][0].s, A.Var) else None)
        return ordered_join(parts, keys)

    def cardinality(self, spark: SparkSession, triples: tuple[A.Triple, ...]) -> int:
        return self.evaluate(spark, triples).df.count()


class SingleMember(Member):
    """A member of triple patterns only: every pattern is a request of its own."""

    single = True


# ---- tables


@dataclass
class TableSpec:
    """How a table is seen: key columns of its subjects, predicates of its columns, links to other tables."""

    name: str
    key: str | None  # None: a blank node per row
    columns: dict[str, str]  # column -> predicate
    links: dict[str, tuple[str, str]] = field(default_factory=dict)  # column -> (predicate, table it points to)
    type: str | None = None
    about: str | None = None  # the table whose subjects these are, if not its own


_TYPES = {
    "string": T.STRING, "boolean": T.BOOLEAN, "date": T.DATE, "timestamp": T.DATE_TIME, "timestamp_ntz": T.DATE_TIME,
    "double": A.XSD + "double", "float": A.XSD + "double", "tinyint": A.XSD + "integer", "smallint": A.XSD + "integer",
    "int": A.XSD + "integer", "bigint": A.XSD + "integer",
}


def literal_of(kind: str) -> Desc:
    """The description of a native column of a Spark type, given as its simple string."""
    if kind.startswith("decimal"):
        return T.literal(A.XSD + "decimal")
    if kind.startswith("array"):
        return Desc("lit", T.LIST, _TYPES.get(kind[6:-1], T.STRING))
    if kind.startswith("map"):
        return Desc("lit", T.MAP, _TYPES.get(kind.split(",", 1)[1][:-1], T.STRING))
    return T.literal(_TYPES.get(kind, T.STRING))


def table_member(spark: SparkSession, tables: dict[str, DataFrame], specs: list[TableSpec], base: str, vocabulary=None) -> Member:
    """Tables as a graph: subjects base + table/key, a predicate per column, links as IRIs of other tables' rows."""
    views = []
    for spec in specs:
        df = tables[spec.name]
        kinds = dict(df.dtypes)
        if spec.key is None:
            # a row of a file is where it stands: the same in every scan, and free where it is not asked for
            df = df.select("*", F.concat_ws("#", F.lit(spec.name), F.col("_metadata.file_name"), F.col("_metadata.row_index")).alias("_row"))
            s = Term(T.BLANK, F.col("_row"))
        else:
            s = _template(base, spec.about or spec.name, spec.key, kinds[spec.key])
        rows = Rows(spec.name, df)
        if spec.type:
            views.append(View(rows, s, A.RDF_TYPE, Term(T.PLAIN_IRI, F.lit(spec.type))))
        for column, predicate in spec.columns.items():
            views.append(View(rows, s, predicate, Term(literal_of(kinds[column]), F.col(column))))
        for column, (predicate, target) in spec.links.items():
            views.append(View(rows, s, predicate, _template(base, target, column, kinds[column])))
    return Member(views, vocabulary)


def _template(base: str, table: str, column: str, kind: str) -> Term:
    integral = kind in ("tinyint", "smallint", "int", "bigint")
    return Term(Desc("iri", template=(f"{base}{table}/", ""), integral=integral), F.col(column))


# ---- triples


def triple_member(triples: DataFrame, blank_subjects: bool = False, single: bool = False, vocabulary=None) -> Member:
    """A collection of triples: s STRING, p STRING, o STRUCT<k,v,dt,lang>, and g STRING where there are graphs.

    Subjects that start with _: are blank nodes, if there are any.
    """
    rows = Rows("triples", triples)
    s = Term(T.PLAIN_IRI, F.col("s"))
    if blank_subjects:
        k = F.when(F.col("s").startswith("_:"), T.BNODE).otherwise(T.IRI).cast("tinyint")
        s = Term(T.DYN, F.struct(k.alias("k"), F.col("s").alias("v"), F.lit("").alias("dt"), F.lit("").alias("lang")))
    graph = F.col("g") if "g" in triples.columns else None
    view = View(rows, s, Term(T.PLAIN_IRI, F.col("p")), Term(T.DYN, F.col("o")), unique=False, graph=graph)
    return (SingleMember if single else Member)([view], vocabulary)


def in_graph(member: Member, graph: str | None) -> Member:
    """The member restricted to a named graph, or to its default graph."""
    views = []
    for v in member.views:
        if v.graph is None:
            if graph is None:
                views.append(v)
            continue
        test = v.graph.isNull() if graph is None else v.graph == graph
        views.append(View(Rows(f"{v.rows.name}@{graph}", v.rows.df.filter(test), v.rows.keys), v.s, v.p, v.o, v.unique, v.repeats))
    return Member(views, member.vocabulary)


def of_graphs(member: Member, names: tuple[str, ...], merged: bool) -> Member:
    """The member with these of its named graphs only; merged: as one graph, in which a triple is once.

    Members without named graphs stay as they are.
    """
    if not any(v.graph is not None for v in member.views):
        return member
    views = []
    for v in member.views:
        if v.graph is not None:
            rows = Rows(f"{v.rows.name}@{names}", v.rows.df.filter(v.graph.isin(*names)), v.rows.keys)
            views.append(View(rows, v.s, v.p, v.o, v.unique, v.repeats or merged, None if merged else v.graph))
    return Member(views, member.vocabulary)


class GraphsMember(Member):
    """A member's named graphs: each pattern binds a variable to the graph in which it is found."""

    def __init__(self, member: Member, graph: str):
        super().__init__([v for v in member.views if v.graph is not None], member.vocabulary)
        self.graph = graph

    def evaluate(self, spark: SparkSession, triples: tuple[A.Triple, ...]) -> R.Rel:
        parts = []
        for t in triples:
            found = []
            for v in self.matching(t):
                rows = Rows(v.rows.name, v.rows.df.filter(v.graph.isNotNull()).withColumn("_graph", v.graph), v.rows.keys)
                name = A.Var(self.graph)
                marked = View(rows, v.s, v.p, v.o, v.unique, v.repeats)
                r = _scan([(t, marked)], {name.name: Term(T.PLAIN_IRI, F.col("_graph"))})
                if r is not None:
                    found.append(r)
            if not found:
                return R.nothing(spark, set().union(*[t.variables() for t in triples]) | {self.graph})
            parts.append(R.union(found))
        return ordered_join(parts) if parts else R.unit(spark)


# ---- look-ups


class LookUpMember(Member):
    """A source whose documents are found by parameters.

    params: name -> (datatype, required). fetch: from a DataFrame of the distinct parameters (all strings, one
    column per name) to the same rows with a column `doc`; rows it cannot find are left out. view: from Rows of
    documents to views.
    """

    def __init__(self, params: dict[str, tuple[str, bool]], fetch: Callable[[DataFrame], DataFrame], view: Callable[[Rows], list[View]], vocabulary=None):
        super().__init__([], vocabulary)
        self.params, self.fetch, self.view = params, fetch, view

    def member(self, asked: DataFrame) -> Member:
        documents = self.fetch(asked)
        return Member(self.view(Rows("documents", documents, tuple(asked.columns))), None)


def table_fetch(documents: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Documents kept in a table with a column per parameter (strings) and a column `doc`."""
    return lambda asked: documents.join(asked.distinct(), asked.columns)


def url_fetch(template: str, get: Callable[[str], str | None]) -> Callable[[DataFrame], DataFrame]:
    """Documents of a Web API: an expanded URI template per row, fetched on the executors; failures drop the row."""
    import sys

    from pyspark import cloudpickle

    from graphloom.sources import uris

    for name in ("graphloom.sources.uris", getattr(get, "__module__", None)):  # executors need not have them
        if name in sys.modules and name != "__main__":
            cloudpickle.register_pickle_by_value(sys.modules[name])

    def fetch(asked: DataFrame) -> DataFrame:
        names = asked.columns

        def run(batches):
            for b in batches:
                docs = []
                for row in b.to_dict("records"):
                    try:
                        docs.append(get(uris.expand(template, row)))
                    except Exception:  # noqa: BLE001  a request that fails has no document
                        docs.append(None)
                yield b.assign(doc=docs)[b.columns.tolist() + ["doc"]]

        schema = ", ".join(f"`{n}` string" for n in names) + ", doc string"
        return asked.distinct().mapInPandas(run, schema).filter("doc is not null")

    return fetch
