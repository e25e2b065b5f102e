"""Expressions of the algebra as columns. Errors are NULL; nothing here throws for a row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.terms import Term, literal
from graphloom.plans import algebra as A

#: Functions by IRI: callables from terms to a term. Users add their own.
REGISTRY: dict[str, Callable[..., Term]] = {}


def register(iri: str, function: Callable[..., Term]) -> None:
    REGISTRY[iri] = function


def _string(c: Column) -> Term:
    return Term(literal(T.STRING), c)


def _bool(c: Column) -> Term:
    return Term(literal(T.BOOLEAN), c)


def _int(c: Column) -> Term:
    return Term(literal(A.XSD + "integer"), c.cast("long"))


class Compiler:
    """Compiles expressions over the terms that variables stand for; unknown variables are unbound."""

    def __init__(self, env: dict[str, Term], exists: Callable | None = None):
        self.env, self.exists = env, exists

    def term(self, e) -> Term:
        if isinstance(e, A.Var):
            return self.env.get(e.name, T.null())
        if isinstance(e, A.Const):
            return T.constant(e.term)
        if isinstance(e, A.Exists):
            if self.exists is None:
                raise NotImplementedError("EXISTS inside of this expression")
            return self.exists(e)
        if e.name in _FORMS:
            return _FORMS[e.name](self, e.args)
        args = [self.term(a) for a in e.args]
        if f := _CALLS.get(e.name) or REGISTRY.get(e.name):
            return f(*args)
        if e.name.startswith(A.XSD):
            return cast(args[0], e.name)
        raise NotImplementedError(f"no function {e.name}")

    def condition(self, e) -> Column:
        """Whether e is true, for a filter or a join: both take an error, NULL, for false."""
        return truth(self.term(e))


# ---- values


def truth(t: Term) -> Column:
    """The effective boolean value; NULL is an error."""
    if t.is_(T.BOOLEAN):
        return t.col
    if t.numeric:
        return (t.col != 0) & ~F.isnan(t.col.cast("double"))
    if t.stringy:
        return F.length(t.col) > 0
    if t.desc.kind == "dyn":
        v, dt = t.col["v"], t.col["dt"]
        number = v.try_cast("double")
        known = F.when(dt == T.BOOLEAN, v.isin("true", "1")).when(dt.isin(*T.NUMERIC), (number != 0) & ~F.isnan(number))
        return F.when(t.col["k"] == T.LITERAL, known.when(dt.isin(T.STRING, A.LANG_STRING), F.length(v) > 0))
    return F.lit(None).cast("boolean")


def number(t: Term) -> tuple[Column, int] | None:
    """(column, rank) of a numeric term: 0 integer, 1 decimal, 2 double; None if it cannot be one."""
    if t.numeric:
        rank = 0 if t.desc.dt in T.INTEGERS else 1 if t.desc.dt == A.XSD + "decimal" else 2
        return t.col, rank
    if t.desc.kind == "dyn":
        return F.when((t.col["k"] == T.LITERAL) & t.col["dt"].isin(*T.NUMERIC), t.col["v"].try_cast("double")), 2
    return None


_RANKS = (A.XSD + "integer", A.XSD + "decimal", A.XSD + "double")
_TYPES = ("bigint", "decimal(38,18)", "double")


def _arithmetic(op: str) -> Callable[[Term, Term], Term]:
    def run(a: Term, b: Term) -> Term:
        x, y = number(a), number(b)
        if not x or not y:
            return Term(literal(_RANKS[2]), F.lit(None).cast("double"))
        rank = max(x[1], y[1], 1 if op == "/" else 0)
        l, r = x[0].try_cast(_TYPES[rank]), y[0].try_cast(_TYPES[rank])  # noqa: E741
        made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op](l, r)
        return Term(literal(_RANKS[rank]), made)

    return run


def _compare(op: str) -> Callable[[Term, Term], Term]:
    act = {
        "=": lambda x, y: x == y,
        "!=": lambda x, y: x != y,
        "<": lambda x, y: x < y,
        ">": lambda x, y: x > y,
        "<=": lambda x, y: x <= y,
        ">=": lambda x, y: x >= y,
    }[op]

    def run(a: Term, b: Term) -> Term:
        if "none" in (a.desc.kind, b.desc.kind):
            return _bool(F.lit(None).cast("boolean"))
        if a.numeric and b.numeric:
            return _bool(act(a.col, b.col))
        for dt in (T.BOOLEAN, T.DATE, T.DATE_TIME):
            if a.is_(dt) and b.is_(dt):
                return _bool(act(a.col, b.col))
        if a.is_(T.STRING) and b.is_(T.STRING):
            return _bool(act(a.col, b.col))
        if {a.desc.dt, b.desc.dt} == {T.DATE, T.DATE_TIME} and a.desc.kind == b.desc.kind == "lit":
            return _bool(act(a.col.cast("timestamp_ntz"), b.col.cast("timestamp_ntz")))
        if "dyn" in (a.desc.kind, b.desc.kind):
            return _bool(_dynamic_compare(op, act, a, b))
        if op in ("=", "!="):
            equal = T.same(a, b)
            if equal is None:
                # literals of different types need not differ in value: an error; other terms do differ
                if a.desc.kind == b.desc.kind == "lit" and (a.desc.opaque or b.desc.opaque or a.desc.dt != A.LANG_STRING and b.desc.dt != A.LANG_STRING):
                    return _bool(F.lit(None).cast("boolean"))
                equal = F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
            return _bool(equal if op == "=" else ~equal)
        return _bool(F.lit(None).cast("boolean"))

    return run


def _dynamic_compare(op: str, act, a: Term, b: Term) -> Column:
    x, y = T.dynamic(a), T.dynamic(b)
    literals = (x["k"] == T.LITERAL) & (y["k"] == T.LITERAL)
    numbers = literals & x["dt"].isin(*T.NUMERIC) & y["dt"].isin(*T.NUMERIC)
    alike = literals & (x["dt"] == y["dt"])
    out = F.when(numbers, act(x["v"].try_cast("double"), y["v"].try_cast("double")))
    out = out.when(alike & (x["dt"] == T.DATE_TIME), act(T.date_time(x["v"]), T.date_time(y["v"])))
    out = out.when(alike & (x["dt"] == T.DATE), act(x["v"].try_cast("date"), y["v"].try_cast("date")))
    out = out.when(alike & x["dt"].isin(T.STRING, T.BOOLEAN), act(x["v"], y["v"]))
    if op in ("=", "!="):
        unsure = literals & (x["dt"] != y["dt"])
        out = out.when(x.isNotNull() & y.isNotNull() & ~unsure, act(x, y))
    return out


def cast(t: Term, dt: str) -> Term:
    v = T.lexical(t)
    if t.desc.kind in ("iri", "bnode") and dt != T.STRING:
        v = F.lit(None).cast("string")
    if dt == T.STRING:
        return _string(v)
    if dt in T.INTEGERS:
        got = number(t)
        if got and got[1] and t.desc.kind != "dyn":
            return Term(literal(A.XSD + "integer"), got[0].try_cast("bigint"))
        whole = F.when(F.trim(v).rlike(r"^[+-]?\d+$"), F.trim(v).try_cast("bigint"))
        if t.desc.kind == "dyn":
            whole = F.when(t.col["dt"].isin(A.XSD + "double", A.XSD + "decimal", A.XSD + "float"), v.try_cast("double").try_cast("bigint")).otherwise(whole)
        if t.is_(T.BOOLEAN):
            whole = t.col.cast("bigint")
        return Term(literal(A.XSD + "integer"), whole)
    if dt in (A.XSD + "decimal", A.XSD + "double", A.XSD + "float"):
        kind = "decimal(38,18)" if dt.endswith("decimal") else "double"
        got = number(t)
        return Term(literal(dt), (got[0] if got and t.desc.kind != "dyn" else t.col.cast("int") if t.is_(T.BOOLEAN) else F.trim(v)).try_cast(kind))
    if dt == T.BOOLEAN:
        if t.numeric:
            return _bool(truth(t))
        return _bool(F.when(F.trim(v).isin("true", "1"), True).when(F.trim(v).isin("false", "0"), False))
    if dt == T.DATE_TIME:
        return Term(literal(dt), t.col if t.is_(T.DATE_TIME) else T.date_time(v))
    if dt == T.DATE:
        return Term(literal(dt), (t.col if t.is_(T.DATE_TIME) else v).try_cast("date"))
    raise NotImplementedError(f"no cast to {dt}")


# ---- strings


def _text(t: Term) -> Column:
    """The characters of a string literal; NULL for anything else."""
    if t.stringy:
        return t.col
    if t.desc.kind == "dyn":
        return F.when((t.col["k"] == T.LITERAL) & t.col["dt"].isin(T.STRING, A.LANG_STRING), t.col["v"])
    return F.lit(None).cast("string")


def _like(t: Term, c: Column) -> Term:
    """A string with the language of t."""
    if t.stringy:
        return Term(t.desc, c)
    return _string(c)


def _text1(f: Callable[..., Column]) -> Callable[..., Term]:
    return lambda t, *more: _like(t, f(_text(t), *[_text(m) for m in more]))


def _test(f: Callable[..., Column]) -> Callable[..., Term]:
    return lambda *ts: _bool(f(*[_text(t) for t in ts]))


def _before(t: Term, mark: Term) -> Term:
    s, m = _text(t), _text(mark)
    place = F.position(m, s)
    return _like(t, F.when(place > 0, F.substring(s, F.lit(1), place - 1)).when(place == 0, F.lit("")))


def _after(t: Term, mark: Term) -> Term:
    s, m = _text(t), _text(mark)
    place = F.position(m, s)
    return _like(t, F.when(place > 0, F.substring(s, place + F.length(m), F.length(s))).when(place == 0, F.lit("")))


def _substr(t: Term, start: Term, size: Term | None = None) -> Term:
    """Characters from position start (1 is the first), counted as XPath does."""
    s = _text(t)
    rounded = lambda x: F.floor(number(x)[0].cast("double") + 0.5)
    begin = rounded(start)
    end = begin + rounded(size) if size is not None else F.length(s) + 1
    first = F.greatest(begin, F.lit(1))
    return _like(t, F.when(s.isNotNull(), F.substring(s, first.cast("int"), F.greatest(end - first, F.lit(0)).cast("int"))))


def _concat(*ts: Term) -> Term:
    if not ts:
        return _string(F.lit(""))
    joined = F.concat(*[_text(t) for t in ts])
    alike = all(t.stringy and t.desc == ts[0].desc for t in ts)
    return Term(ts[0].desc, joined) if alike else _string(joined)


def _pattern(pattern: Term, flags: Term | None) -> Column:
    """A Java pattern with XPath's flags in front."""
    p = _text(pattern)
    if flags is None:
        return p
    f = _text(flags)
    quoted = F.when(f.contains("q"), F.concat(F.lit(r"\Q"), p, F.lit(r"\E"))).otherwise(p)
    marks = F.regexp_replace(f, "[^imsx]", "")
    return F.when(F.length(marks) > 0, F.concat(F.lit("(?"), marks, F.lit(")"), quoted)).otherwise(quoted)


def _regex(t: Term, pattern: Term, flags: Term | None = None) -> Term:
    return _bool(F.rlike(_text(t), _pattern(pattern, flags)))


def _replace(t: Term, pattern: Term, by: Term, flags: Term | None = None) -> Term:
    return _like(t, F.regexp_replace(_text(t), _pattern(pattern, flags), _text(by)))


def _encoded(t: Term) -> Term:
    c = F.url_encode(_text(t))
    for what, to in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        c = F.replace(c, F.lit(what), F.lit(to))
    return _string(c)


def _lang_matches(tag: Term, range_: Term) -> Term:
    t, r = F.lower(_text(tag)), F.lower(_text(range_))
    return _bool(F.when(r == "*", F.length(t) > 0).otherwise((t == r) | t.startswith(F.concat(r, F.lit("-")))))


# ---- terms


def _kind(*kinds: str) -> Callable[[Term], Term]:
    codes = {"iri": T.IRI, "bnode": T.BNODE, "lit": T.LITERAL, "triple": T.TRIPLE}

    def run(t: Term) -> Term:
        if t.desc.kind == "dyn":
            return _bool(t.col["k"].isin(*[codes[k] for k in kinds]))
        return _bool(F.when(t.col.isNotNull(), F.lit(t.desc.kind in kinds)))

    return run


def _is_numeric(t: Term) -> Term:
    if t.desc.kind == "dyn":
        return _bool((t.col["k"] == T.LITERAL) & t.col["dt"].isin(*T.NUMERIC) & t.col["v"].try_cast("double").isNotNull())
    return _bool(F.when(t.col.isNotNull(), F.lit(t.numeric)))


def _lang(t: Term) -> Term:
    if t.desc.kind == "dyn":
        return _string(F.when(t.col["k"] == T.LITERAL, F.regexp_replace(t.col["lang"], "--.*$", "")))
    return _string(F.when(t.col.isNotNull(), F.lit(t.desc.lang.partition("--")[0]) if t.desc.kind == "lit" else F.lit(None).cast("string")))


def _lang_dir(t: Term) -> Term:
    if t.desc.kind == "dyn":
        return _string(F.when(t.col["k"] == T.LITERAL, F.regexp_extract(t.col["lang"], "--(.*)$", 1)))
    return _string(F.when(t.col.isNotNull(), F.lit(t.desc.lang.partition("--")[2]) if t.desc.kind == "lit" else F.lit(None).cast("string")))


def _datatype(t: Term) -> Term:
    if t.desc.kind == "dyn":
        return Term(T.PLAIN_IRI, F.when(t.col["k"] == T.LITERAL, t.col["dt"]))
    return Term(T.PLAIN_IRI, F.when(t.col.isNotNull(), F.lit(t.desc.dt) if t.desc.kind == "lit" else F.lit(None).cast("string")))


def _iri(t: Term) -> Term:
    if t.desc.kind == "iri":
        return t
    if t.desc.kind == "dyn":
        return Term(T.PLAIN_IRI, F.when((t.col["k"] == T.IRI) | (t.col["dt"] == T.STRING), t.col["v"]))
    return Term(T.PLAIN_IRI, _text(t))


def _str_dt(t: Term, dt: Term) -> Term:
    v = _text(t)
    return Term(T.DYN, F.when(v.isNotNull() & T.lexical(dt).isNotNull(), _struct(T.LITERAL, v, T.lexical(dt), F.lit(""))))


def _str_lang(t: Term, lang: Term, way: Term | None = None) -> Term:
    v, tag = _text(t), F.lower(_text(lang))
    tag = F.concat(tag, F.lit("--"), _text(way)) if way is not None else tag
    return Term(T.DYN, F.when(v.isNotNull() & tag.isNotNull(), _struct(T.LITERAL, v, F.lit(A.LANG_STRING), tag)))


def _struct(k: int, v: Column, dt: Column, lang: Column) -> Column:
    return F.struct(F.lit(k).cast("tinyint").alias("k"), v.alias("v"), dt.alias("dt"), lang.alias("lang"))


def _same_term(a: Term, b: Term) -> Term:
    equal = T.same(a, b)
    return _bool(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)) if equal is None else equal)


def _triple(s: Term, p: Term, o: Term) -> Term:
    return Term(T.Desc("triple"), F.when(s.col.isNotNull() & p.col.isNotNull() & o.col.isNotNull(), F.struct(T.dynamic(s), T.dynamic(p), T.dynamic(o))), (s, p, o))


def _part(i: int) -> Callable[[Term], Term]:
    return lambda t: t.parts[i] if t.parts else T.null()


# ---- numbers, dates


def _rounding(f: Callable[[Column], Column]) -> Callable[[Term], Term]:
    """Rounding that keeps the argument's type."""

    def run(t: Term) -> Term:
        got = number(t)
        if got is None:
            return Term(literal(_RANKS[2]), F.lit(None).cast("double"))
        c, rank = got
        return Term(literal(_RANKS[rank]), c if rank == 0 else f(c).cast(_TYPES[rank]))

    return run


def _negative(t: Term) -> Term:
    got = number(t)
    return Term(literal(_RANKS[got[1]]), F.negate(got[0])) if got else Term(literal(_RANKS[2]), F.lit(None).cast("double"))


def _absolute(t: Term) -> Term:
    got = number(t)
    return Term(literal(_RANKS[got[1]]), F.abs(got[0])) if got else Term(literal(_RANKS[2]), F.lit(None).cast("double"))


def _moment(t: Term) -> Column:
    if t.is_(T.DATE_TIME) or t.is_(T.DATE):
        return t.col.cast("timestamp_ntz")
    if t.desc.kind == "dyn":
        return F.when(t.col["dt"].isin(T.DATE_TIME, T.DATE), T.date_time(t.col["v"]))
    return F.lit(None).cast("timestamp_ntz")


def _field(f: Callable[[Column], Column]) -> Callable[[Term], Term]:
    return lambda t: _int(f(_moment(t)))


def _seconds(t: Term) -> Term:
    return Term(literal(A.XSD + "decimal"), F.extract(F.lit("SECOND"), _moment(t)).cast("decimal(38,18)"))


def _tz(t: Term) -> Term:
    v = T.lexical(t)
    return _string(F.when(_moment(t).isNotNull(), F.regexp_extract(v, r"(Z|[+-]\d\d:\d\d)$", 1)))


def _timezone(t: Term) -> Term:
    z = _tz(t).col
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    sign = F.when(z.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    parts = F.concat(sign, F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(F.lit("")), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(F.lit("")))
    text = F.when(z == "Z", F.lit("PT0S")).when(F.length(z) > 1, F.when(hours + minutes == 0, F.lit("PT0S")).otherwise(parts))
    return Term(T.Desc("lit", A.XSD + "dayTimeDuration", opaque=True), text)


# ---- lists and maps


def _list(*ts: Term) -> Term:
    if not ts:
        return Term(literal(T.LIST), F.array().cast("array<string>"))
    d = T.aligned([t.desc for t in ts])
    return Term(literal(T.LIST), F.array(*([t.col for t in ts] if d.kind == "lit" else [T.lexical(t) for t in ts])))


def _map(*ts: Term) -> Term:
    if not ts:
        return Term(literal(T.MAP), F.create_map().cast("map<string,string>"))
    d = T.aligned([t.desc for t in ts[1::2]])
    values = [t.col if d.kind == "lit" else T.lexical(t) for t in ts[1::2]]
    return Term(literal(T.MAP), F.create_map(*[c for k, v in zip(ts[::2], values) for c in (T.lexical(k), v)]))


def collection(t: Term, kind: str) -> Column:
    """A list as an array, a map as a map; NULL for other terms."""
    if t.is_(kind):
        return t.col
    shape = "array<string>" if kind == T.LIST else "map<string,string>"
    if t.desc.kind == "dyn":
        return F.when(t.col["dt"] == kind, F.from_json(t.col["v"], shape))
    return F.lit(None).cast(shape)


def element(c: Column) -> Term:
    """A member of a list or map as a term: its type is only known to Spark."""
    return Term(T.Desc("lit", "", "", None, False, False), c)


def _get(t: Term, key: Term) -> Term:
    if t.is_(T.MAP) or not key.numeric:
        return element(F.try_element_at(collection(t, T.MAP), T.lexical(key)))
    return element(F.try_element_at(collection(t, T.LIST), key.col.cast("int")))


def _size(t: Term) -> Term:
    if t.is_(T.MAP):
        return _int(F.when(t.col.isNotNull(), F.size(t.col)))
    if t.is_(T.LIST):
        return _int(F.when(t.col.isNotNull(), F.size(t.col)))
    sizes = [F.when(collection(t, k).isNotNull(), F.size(collection(t, k))) for k in (T.LIST, T.MAP)]
    return _int(F.coalesce(*sizes))


def _keys(t: Term) -> Term:
    return Term(literal(T.LIST), F.array_sort(F.map_keys(collection(t, T.MAP))))


def _contains_key(t: Term, key: Term) -> Term:
    return _bool(F.map_contains_key(collection(t, T.MAP), T.lexical(key)))


# ---- forms whose arguments are not all evaluated alike


def _and(c: Compiler, args) -> Term:
    return _bool(reduce(lambda x, y: x & y, [truth(c.term(a)) for a in args]))


def _or(c: Compiler, args) -> Term:
    return _bool(reduce(lambda x, y: x | y, [truth(c.term(a)) for a in args]))


def _in(c: Compiler, args) -> Term:
    first, rest = c.term(args[0]), [c.term(a) for a in args[1:]]
    if not rest:
        return _bool(F.lit(False))
    return _bool(reduce(lambda x, y: x | y, [_compare("=")(first, r).col for r in rest]))


def _coalesce(c: Compiler, args) -> Term:
    ts = [c.term(a) for a in args]
    if not ts:
        return T.null()
    d = T.aligned([t.desc for t in ts])
    return Term(d, F.coalesce(*[T.as_(t, d) for t in ts]))


def _if(c: Compiler, args) -> Term:
    test, yes, no = (c.term(a) for a in args)
    d = T.aligned([yes.desc, no.desc])
    t = truth(test)
    return Term(d, F.when(t, T.as_(yes, d)).when(~t, T.as_(no, d)))


def _bound(c: Compiler, args) -> Term:
    return _bool(c.term(args[0]).col.isNotNull())


_FORMS = {"&&": _and, "||": _or, "IN": _in, "COALESCE": _coalesce, "IF": _if, "BOUND": _bound}

_CALLS: dict[str, Callable[..., Term]] = {
    **{op: _arithmetic(op) for op in "+-*/"},
    **{op: _compare(op) for op in ("=", "!=", "<", ">", "<=", ">=")},
    "!": lambda t: _bool(~truth(t)),
    "neg": _negative,
    "pos": lambda t: t if t.numeric else Term(literal(_RANKS[2]), (number(t) or (F.lit(None).cast("double"),))[0]),
    "STR": lambda t: _string(F.when(F.lit(t.desc.kind not in ("bnode", "triple")), T.lexical(t))),
    "LANG": _lang,
    "LANGDIR": _lang_dir,
    "LANGMATCHES": _lang_matches,
    "DATATYPE": _datatype,
    "IRI": _iri,
    "URI": _iri,
    "BNODE": lambda t=None: Term(T.BLANK, F.uuid() if t is None else F.concat(F.lit("b-"), _text(t))),
    "STRDT": _str_dt,
    "STRLANG": _str_lang,
    "STRLANGDIR": _str_lang,
    "SAMETERM": _same_term,
    "ISIRI": _kind("iri"),
    "ISURI": _kind("iri"),
    "ISBLANK": _kind("bnode"),
    "ISLITERAL": _kind("lit"),
    "ISTRIPLE": _kind("triple"),
    "ISNUMERIC": _is_numeric,
    "HASLANG": lambda t: _bool(F.length(_lang(t).col) > 0),
    "HASLANGDIR": lambda t: _bool(F.length(_lang_dir(t).col) > 0),
    "TRIPLE": _triple,
    "SUBJECT": _part(0),
    "PREDICATE": _part(1),
    "OBJECT": _part(2),
    "UUID": lambda: Term(T.PLAIN_IRI, F.concat(F.lit("urn:uuid:"), F.uuid())),
    "STRUUID": lambda: _string(F.uuid()),
    "STRLEN": lambda t: _int(F.char_length(_text(t))),
    "UCASE": _text1(F.upper),
    "LCASE": _text1(F.lower),
    "CONCAT": _concat,
    "SUBSTR": _substr,
    "CONTAINS": _test(F.contains),
    "STRSTARTS": _test(F.startswith),
    "STRENDS": _test(F.endswith),
    "STRBEFORE": _before,
    "STRAFTER": _after,
    "ENCODE_FOR_URI": _encoded,
    "REGEX": _regex,
    "REPLACE": _replace,
    "ABS": _absolute,
    "CEIL": _rounding(F.ceil),
    "FLOOR": _rounding(F.floor),
    "ROUND": _rounding(lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)"))),
    "RAND": lambda: Term(literal(_RANKS[2]), F.rand()),
    "NOW": lambda: Term(literal(T.DATE_TIME), F.current_timestamp().cast("timestamp_ntz")),
    "YEAR": _field(F.year),
    "MONTH": _field(F.month),
    "DAY": _field(F.dayofmonth),
    "HOURS": _field(F.hour),
    "MINUTES": _field(F.minute),
    "SECONDS": _seconds,
    "TZ": _tz,
    "TIMEZONE": _timezone,
    "MD5": lambda t: _string(F.md5(_text(t).cast("binary"))),
    "SHA1": lambda t: _string(F.sha1(_text(t).cast("binary"))),
    **{f"SHA{n}": (lambda n: lambda t: _string(F.sha2(_text(t).cast("binary"), n)))(n) for n in (256, 384, 512)},
    A.CDT + "List": _list,
    A.CDT + "Map": _map,
    A.CDT + "get": _get,
    A.CDT + "size": _size,
    A.CDT + "keys": _keys,
    A.CDT + "containsKey": _contains_key,
}
