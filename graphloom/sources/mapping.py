"""The mapping algebra: relations of terms extracted from documents, and triples made of them.

A mapping relation is a DataFrame with a term per attribute; the error symbol is NULL. extract() turns JSON
documents into rows, extend() adds attributes by expressions, and a relation with s, p and o is a set of triples.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.compile import cast
from graphloom.functions.terms import Desc, Term, literal
from graphloom.operators import relation as R
from graphloom.plans import algebra as A
from graphloom.sources.turtle import Graph
from graphloom.sources.views import Rows, View

# ---- JSONPath


def json_steps(path: str) -> list[str]:
    """The path cut at its wildcards: what lies between is a plain path within a value."""
    path = path if path.startswith("$") else f"$.{path}"
    parts = re.split(r"\[\*\]|\.\*", path)
    return [parts[0], *[f"${p}" for p in parts[1:]]]


def _values(df: DataFrame, source: Column, path: str, name: str) -> DataFrame:
    """df with the VARIANT values that a path finds in source, a row for each; none where it finds none."""
    steps = json_steps(path)
    df = df.withColumn(name, F.try_variant_get(source, steps[0], "variant"))
    for step in steps[1:]:
        df = df.withColumn(name, F.explode(F.try_variant_get(F.col(name), "$", "array<variant>")))
        if step != "$":
            df = df.withColumn(name, F.try_variant_get(F.col(name), step, "variant"))
    return df.filter(F.col(name).isNotNull() & ~F.is_variant_null(name))


def json_term(v: Column) -> Term:
    """A JSON value as a dynamic term: by its type a number, boolean or string, a list or a map."""
    kind = F.schema_of_variant(v)
    dt = F.when(kind == "BIGINT", A.XSD + "integer").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), A.XSD + "double").when(kind == "BOOLEAN", T.BOOLEAN)
    dt = dt.when(kind.startswith("ARRAY"), T.LIST).when(kind.startswith("OBJECT"), T.MAP).otherwise(T.STRING)
    text = F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))
    return Term(T.DYN, F.when(text.isNotNull(), F.struct(F.lit(T.LITERAL).cast("tinyint").alias("k"), text.alias("v"), dt.alias("dt"), F.lit("").alias("lang"))))


# ---- relations


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    attributes: dict[str, Term]
    keys: tuple[str, ...] = ()


def _kept(df: DataFrame, attributes: dict[str, Term], keys: tuple[str, ...]) -> Relation:
    cols = [t.col.alias(f"a_{R.column_name(a)}") for a, t in attributes.items()]
    named = {a: Term(t.desc, F.col(f"a_{R.column_name(a)}"), t.parts) for a, t in attributes.items()}
    return Relation(df.select(*keys, *cols), named, keys)


def extract(documents: DataFrame, doc: str, root: str, queries: dict[str, str], keys: tuple[str, ...] = ()) -> Relation:
    """For each object that root finds in a document: the cross product of what the attributes' queries find.

    A text that is no JSON has no objects; an attribute without a value leaves no tuple. keys: columns of the
    documents that go along.
    """
    df = documents.select(*keys, F.try_parse_json(F.col(doc).cast("string")).alias("_doc"))
    df = _values(df, F.col("_doc"), root, "_object")
    for i, (_, q) in enumerate(queries.items()):
        df = _values(df, F.col("_object"), q, f"_q{i}")
    return _kept(df, {a: json_term(F.col(f"_q{i}")) for i, a in enumerate(queries)}, keys)


def table(df: DataFrame, columns: list[str]) -> Relation:
    """A table's columns as attributes of native terms."""
    from graphloom.sources.views import literal_of

    kinds = dict(df.dtypes)
    return _kept(df, {c: Term(literal_of(kinds[c]), F.col(c)) for c in columns}, ())


def constant(df_like: DataFrame, rows: list[dict[str, object]]) -> Relation:
    """Fixed tuples of terms."""
    from graphloom.operators.lower import Lowering

    names = tuple(rows[0])
    rel = Lowering(df_like.sparkSession, {})._values(A.Values(names, tuple(tuple(r[n] for n in names) for r in rows)))
    return _kept(rel.df, rel.env(), ())


Expr = Callable[[dict[str, Term]], Term]


def extend(r: Relation, attribute: str, e: Expr) -> Relation:
    if attribute in r.attributes:
        raise ValueError(f"{attribute} is there already")
    return _kept(r.df, r.attributes | {attribute: e(r.attributes)}, r.keys)


def project(r: Relation, attributes: list[str]) -> Relation:
    return _kept(r.df, {a: r.attributes[a] for a in attributes}, r.keys)


def union(relations: list[Relation]) -> Relation:
    """A bag union of relations of the same attributes."""
    names = list(relations[0].attributes)
    if any(set(r.attributes) != set(names) for r in relations):
        raise ValueError("a union of relations with other attributes")
    descs = {a: T.aligned([r.attributes[a].desc for r in relations]) for a in names}
    made = [_kept(r.df, {a: Term(descs[a], T.as_(r.attributes[a], descs[a])) for a in names}, r.keys) for r in relations]
    return Relation(reduce(lambda a, b: a.unionByName(b), [m.df for m in made]), made[0].attributes, made[0].keys)


def join(left: Relation, right: Relation, pairs: list[tuple[str, str]]) -> Relation:
    """Equal terms in the given pairs of attributes; attributes of both must differ in name."""
    if clash := set(left.attributes) & set(right.attributes):
        raise ValueError(f"both sides have {sorted(clash)}")
    mark = "__r"
    moved = {a: Term(t.desc, F.col(f"a_{R.column_name(a)}{mark}")) for a, t in right.attributes.items()}
    df = right.df.select(*[F.col(c).alias(c + mark) for c in right.df.columns])
    conditions = [left.df[k] == F.col(k + mark) for k in left.keys if k in right.keys]
    for a, b in pairs:
        c = T.same(left.attributes[a], moved[b])
        conditions.append(F.lit(False) if c is None else c)
    joined = left.df.join(df, reduce(lambda x, y: x & y, conditions)) if conditions else left.df.crossJoin(df)
    return _kept(joined, left.attributes | moved, left.keys)


# ---- expressions


def attribute(name: str) -> Expr:
    return lambda row: row[name]


def fixed(term) -> Expr:
    return lambda row: T.constant(term)


def concat(*parts: Expr) -> Expr:
    """The strings joined; anything but literals is an error."""

    def run(row: dict[str, Term]) -> Term:
        texts = []
        for p in parts:
            t = p(row)
            text = T.lexical(t)
            texts.append(F.when(t.col["k"] == T.LITERAL, text) if t.desc.kind == "dyn" else text if t.desc.kind == "lit" else F.lit(None).cast("string"))
        return Term(literal(T.STRING), F.concat(*texts))

    return run


def encoded(part: Expr) -> Expr:
    """A value as it stands in an IRI that a template makes."""

    def run(row: dict[str, Term]) -> Term:
        c = F.url_encode(T.lexical(part(row)))
        return Term(literal(T.STRING), F.replace(c, F.lit("+"), F.lit("%20")))

    return run


def to_iri(part: Expr, base: str = "") -> Expr:
    """An absolute IRI as it is, a relative one after the base; with spaces and the like an error."""

    def run(row: dict[str, Term]) -> Term:
        t = part(row)
        text = T.lexical(t)
        absolute = text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
        iri = F.when(absolute, text).otherwise(F.concat(F.lit(base), text) if base else F.lit(None).cast("string"))
        return Term(T.PLAIN_IRI, F.when(~iri.rlike(r'[\s<>"{}|^`\\]'), iri))

    return run


def to_literal(part: Expr, dt: str) -> Expr:
    """A literal of a datatype; one of the same type stays, a string is read, any becomes a string."""

    def run(row: dict[str, Term]) -> Term:
        t = part(row)
        if dt in (T.LIST, T.MAP):
            shape = "array<string>" if dt == T.LIST else "map<string,string>"
            c = F.when(t.col["dt"] == dt, F.from_json(t.col["v"], shape)) if t.desc.kind == "dyn" else t.col if t.is_(dt) else F.lit(None).cast(shape)
            return Term(Desc("lit", dt, T.STRING), c)
        try:
            return cast(t, dt)
        except NotImplementedError:
            return Term(Desc("lit", dt, opaque=True), T.lexical(t))

    return run


def to_bnode(part: Expr, scope: str) -> Expr:
    """A blank node from a string, its own for each member."""
    return lambda row: Term(T.BLANK, F.concat(F.lit(f"_:{scope}-"), T.lexical(part(row))))


def new_bnode(scope: str) -> Expr:
    return lambda row: Term(T.BLANK, F.concat(F.lit(f"_:{scope}-"), F.uuid()))


# ---- RML


def template_parts(template: str) -> list[str]:
    """Texts and references in turn: what stands before, {reference}, what stands between, ..."""
    return [p.replace("\\{", "{").replace("\\}", "}") for p in re.split(r"(?<!\\)\{([^{}]*)(?<!\\)\}", template)]


@dataclass
class TriplesMap:
    """One RML triples map: a source, an iterator, and how subject, predicates and objects are made."""

    source: object
    iterator: str
    subject: dict
    classes: list[str] = field(default_factory=list)
    pairs: list[tuple[dict, dict]] = field(default_factory=list)  # predicate and object maps


def _term_map(g: Graph, node) -> dict:
    """A term map as a dict: constant, reference or template; termType, datatype, language; parent and join."""
    if not isinstance(node, A.Var) and node not in g.by_subject:
        return {"constant": node}
    out = {k: g.one(node, k) for k in ("constant", "reference", "template", "termType", "datatype", "language", "parentTriplesMap") if g.one(node, k) is not None}
    joins = [(g.value(j, "child"), g.value(j, "parent")) for j in g.all(node, "joinCondition")]
    return out | ({"joins": joins} if joins else {})


def read_rml(g: Graph) -> dict:
    """Triples maps by their node, of all subjects that have a logical source."""
    out = {}
    for s in g.by_subject:
        source = g.one(s, "logicalSource")
        if source is None:
            continue
        subject = g.one(s, "subjectMap")
        m = _term_map(g, subject) if subject is not None else {"constant": g.one(s, "subject")}
        t = TriplesMap(g.one(source, "source"), g.value(source, "iterator", "$"), m)
        t.classes = [c.value for c in g.all(subject, "class")] if subject is not None else []
        for po in g.all(s, "predicateObjectMap"):
            predicates = [_term_map(g, x) for x in g.all(po, "predicateMap")] + [{"constant": x} for x in g.all(po, "predicate")]
            objects = [_term_map(g, x) for x in g.all(po, "objectMap")] + [{"constant": x} for x in g.all(po, "object")]
            t.pairs += [(p, o) for p in predicates for o in objects]
        out[s] = t
    return out


def _references(m: dict) -> list[str]:
    if "reference" in m:
        return [m["reference"].value]
    if "template" in m:
        return template_parts(m["template"].value)[1::2]
    return []


def _made(m: dict, default: str, scope: str, base: str, name: Callable[[str], str] = lambda r: r) -> Expr:
    """A term map as an expression over attributes that are named after references."""
    kind = Graph.local(m["termType"].value) if "termType" in m else default
    if "constant" in m:
        return fixed(m["constant"])
    if "reference" in m:
        value: Expr = attribute(name(m["reference"].value))
    else:
        parts = template_parts(m["template"].value)
        pieces = [fixed(A.Lit(p)) if not i % 2 else (encoded(attribute(name(p))) if kind == "IRI" else attribute(name(p))) for i, p in enumerate(parts) if p or i % 2]
        value = concat(*pieces)
    if kind == "BlankNode":
        return to_bnode(value, scope)
    if kind == "IRI":
        return to_iri(value, base)
    if "datatype" in m:
        return to_literal(value, m["datatype"].value)
    if "language" in m:
        tag = m["language"].value.lower()
        return lambda row: Term(literal(A.LANG_STRING, tag), T.lexical(value(row)))
    return value


def relation_of(t: TriplesMap, p: dict, o: dict, maps: dict, documents: Callable[[object], tuple[DataFrame, str, tuple[str, ...]]], scope: str, base: str = "") -> Relation:
    """The triples (s, p, o) of one predicate and object map of a triples map.

    documents: from a source to (DataFrame, column of JSON text, key columns).
    """
    df, doc, keys = documents(t.source)
    refs = list(dict.fromkeys([*_references(t.subject), *_references(p), *_references(o), *[c for c, _ in o.get("joins", [])]]))
    r = extract(df, doc, t.iterator, {x: x for x in refs}, keys)
    parent = maps.get(o.get("parentTriplesMap"))
    if parent is not None:
        pdf, pdoc, pkeys = documents(parent.source)
        prefs = list(dict.fromkeys([*_references(parent.subject), *[q for _, q in o.get("joins", [])]]))
        other = extract(pdf, pdoc, parent.iterator, {f"parent {x}": x for x in prefs}, pkeys)
        r = join(r, other, [(c, f"parent {q}") for c, q in o.get("joins", [])])
        made_o = _made(parent.subject, "IRI", scope, base, lambda x: f"parent {x}")
    else:
        literal_like = "reference" in o or "datatype" in o or "language" in o
        made_o = _made(o, "Literal" if literal_like else "IRI", scope, base)
    r = extend(r, "s", _made(t.subject, "IRI", scope, base))
    r = extend(r, "p", _made(p, "IRI", scope, base))
    return project(extend(r, "o", made_o), ["s", "p", "o"])


def rml_views(maps: dict, documents, scope: str, base: str = "", only: list | None = None, unique: bool = False) -> list[View]:
    """Views of the triples of RML triples maps (of those named, or of all).

    unique: no two context objects of an iterator make the same subject. Maps of one source, iterator and
    subject then share one pass over the documents, and a star of their predicates is one scan.
    """
    views = []
    shared: dict[tuple, list] = {}
    for node in only or list(maps):
        t = maps[node]
        if unique and _single_valued(t):
            shared.setdefault((str(t.source), t.iterator, str(t.subject)), []).append(t)
            continue
        pairs = [({"constant": A.Iri(A.RDF_TYPE)}, {"constant": A.Iri(c)}) for c in t.classes] + t.pairs
        for i, (p, o) in enumerate(pairs):
            r = relation_of(t, p, o, maps, documents, scope, base)
            a = r.attributes
            name = f"{scope}/{node}/{i}"
            predicate = p["constant"].value if "constant" in p else a["p"]
            views.append(View(Rows(name, r.df, r.keys), a["s"], predicate, a["o"], unique=False, repeats=True))
    for i, group in enumerate(shared.values()):
        views += _one_pass(group, documents, scope, base, f"{scope}/shared/{i}")
    return views


def _single_valued(t: TriplesMap) -> bool:
    """Whether all references of a triples map find one value at most, and all predicates are fixed."""
    terms = [t.subject, *[m for pair in t.pairs for m in pair]]
    return not any("parentTriplesMap" in m or any(len(json_steps(r)) > 1 for r in _references(m)) for m in terms) and all("constant" in p for p, _ in t.pairs)


def _one_pass(group: list[TriplesMap], documents, scope: str, base: str, name: str) -> list[View]:
    """Views over one relation with a nullable attribute for every reference of some triples maps."""
    first = group[0]
    df, doc, keys = documents(first.source)
    refs = list(dict.fromkeys(r for t in group for m in [t.subject, *[o for _, o in t.pairs]] for r in _references(m)))
    objects = _values(df.select(*keys, F.try_parse_json(F.col(doc).cast("string")).alias("_doc")), F.col("_doc"), first.iterator, "_object")
    found = [F.try_variant_get(F.col("_object"), json_steps(r)[0], "variant") for r in refs]
    rows = objects.select(*keys, *[F.when(~F.is_variant_null(v), v).alias(f"_q{i}") for i, v in enumerate(found)])
    r = _kept(rows, {x: json_term(F.col(f"_q{i}")) for i, x in enumerate(refs)}, keys)
    shared = Rows(name, r.df, keys)
    s = _made(first.subject, "IRI", scope, base)(r.attributes)
    views = []
    for t in group:
        for c in t.classes:
            views.append(View(shared, s, A.RDF_TYPE, Term(T.PLAIN_IRI, F.lit(c))))
        for p, o in t.pairs:
            literal_like = "reference" in o or "datatype" in o or "language" in o
            views.append(View(shared, s, p["constant"].value, _made(o, "Literal" if literal_like else "IRI", scope, base)(r.attributes)))
    return views


def triples(views: list[View]) -> DataFrame:
    """All triples of views, each once: s, p, o with datatype and language. Rows with errors make none."""
    made = []
    for v in views:
        p = Term(T.PLAIN_IRI, F.lit(v.p)) if isinstance(v.p, str) else v.p
        s, o = T.dynamic(v.s), T.dynamic(v.o)
        made.append(v.rows.df.select(s["v"].alias("s"), T.lexical(p).alias("p"), o["v"].alias("o"), o["dt"].alias("dt"), o["lang"].alias("lang"), o["k"].alias("k")))
    out = reduce(lambda a, b: a.unionByName(b), made)
    return out.filter("s is not null and p is not null and o is not null").distinct()
