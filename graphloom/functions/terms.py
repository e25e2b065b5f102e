"""RDF terms as Spark columns.

A variable whose kind and datatype are known is a native column: an integer stays a LONG, an IRI made from a
template stays its raw key. Others are dynamic: struct<k,v,dt,lang>, with k ordered as ORDER BY wants it. An
unbound variable and an expression's error are both NULL.
"""

from __future__ import annotations

import decimal
from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.plans.algebra import CDT, LANG_STRING, XSD, Iri, Lit, Triple

BNODE, IRI, LITERAL, TRIPLE = 1, 2, 3, 4
DYNAMIC = "struct<k:tinyint,v:string,dt:string,lang:string>"

_INTEGERS = "integer int long short byte nonNegativeInteger positiveInteger negativeInteger nonPositiveInteger unsignedLong unsignedInt unsignedShort unsignedByte".split()
INTEGERS = frozenset(XSD + t for t in _INTEGERS)
NUMERIC = INTEGERS | {XSD + "decimal", XSD + "double", XSD + "float"}
STRING, BOOLEAN, DATE_TIME, DATE = XSD + "string", XSD + "boolean", XSD + "dateTime", XSD + "date"
LIST, MAP = CDT + "List", CDT + "Map"


@dataclass(frozen=True)
class Desc:
    """What is known of a column's terms."""

    kind: str  # iri bnode lit triple dyn; none: never bound
    dt: str = ""
    lang: str = ""
    template: tuple[str, str] | None = None  # what stands before and after the key
    integral: bool = False  # of a template's key: a whole number
    opaque: bool = False  # a literal of a type without native form: the lexical form


PLAIN_IRI, BLANK, DYN, UNBOUND = Desc("iri"), Desc("bnode"), Desc("dyn"), Desc("none")


def literal(dt: str, lang: str = "") -> Desc:
    return Desc("lit", dt, lang)


@dataclass(frozen=True)
class Term:
    desc: Desc
    col: Column
    parts: tuple = ()  # of a triple term: subject, predicate, object

    @property
    def numeric(self) -> bool:
        return self.desc.kind == "lit" and self.desc.dt in NUMERIC and not self.desc.opaque

    @property
    def stringy(self) -> bool:
        return self.desc.kind == "lit" and self.desc.dt in (STRING, LANG_STRING)

    def is_(self, dt: str) -> bool:
        return self.desc.kind == "lit" and self.desc.dt == dt and not self.desc.opaque


def null() -> Term:
    """What nothing binds."""
    return Term(UNBOUND, F.lit(None).cast("string"))


def constant(x: Iri | Lit) -> Term:
    """A constant's term; an ill-typed literal keeps its lexical form."""
    if isinstance(x, Iri):
        return Term(PLAIN_IRI, F.lit(x.value))
    d = literal(x.dt, x.lang)
    try:
        if x.dt in INTEGERS:
            n = int(x.value)
            return Term(d, F.lit(n).cast("bigint") if -(2**63) <= n < 2**63 else F.lit(decimal.Decimal(n)))
        if x.dt == XSD + "decimal":
            return Term(d, F.lit(decimal.Decimal(x.value)).cast("decimal(38,18)"))
        if x.dt in (XSD + "double", XSD + "float"):
            return Term(d, F.lit(float(x.value.replace("INF", "inf"))))
    except (ValueError, decimal.InvalidOperation):
        return Term(replace(d, opaque=True), F.lit(x.value))
    if x.dt == BOOLEAN and x.value in ("true", "false", "1", "0"):
        return Term(d, F.lit(x.value in ("true", "1")))
    if x.dt == DATE_TIME:
        return Term(d, date_time(F.lit(x.value)))
    if x.dt == DATE:
        return Term(d, F.lit(x.value).try_cast("date"))
    if x.dt == LIST:
        return Term(d, F.from_json(F.lit(x.value), "array<string>"))
    if x.dt == MAP:
        return Term(d, F.from_json(F.lit(x.value), "map<string,string>"))
    if x.dt in (STRING, LANG_STRING):
        return Term(d, F.lit(x.value))
    return Term(replace(d, opaque=True), F.lit(x.value))


def date_time(text: Column) -> Column:
    """A lexical xsd:dateTime as TIMESTAMP_NTZ; one with a zone in UTC."""
    zone = F.regexp_extract(text, r"(Z|[+-]\d\d:\d\d)$", 1)
    plain = F.regexp_replace(text, r"(Z|[+-]\d\d:\d\d)$", "").try_cast("timestamp_ntz")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    minutes = sign * (F.coalesce(F.substring(zone, 2, 2).try_cast("int"), F.lit(0)) * 60 + F.coalesce(F.substring(zone, 5, 2).try_cast("int"), F.lit(0)))
    return F.when(zone.isin("", "Z"), plain).otherwise(plain - F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0)))


def iri_string(t: Term) -> Column:
    if t.desc.template is None:
        return t.col
    before, after = t.desc.template
    key = t.col.cast("string") if t.desc.integral else F.replace(F.url_encode(t.col.cast("string")), F.lit("+"), F.lit("%20"))
    parts = [F.lit(before), key] + ([F.lit(after)] if after else [])
    return F.concat(*parts)


def lexical(t: Term) -> Column:
    """The lexical form of a literal, or the identifier of an IRI or blank node."""
    d = t.desc
    if d.kind == "dyn":
        return t.col["v"]
    if d.kind == "iri":
        return iri_string(t)
    if d.kind == "triple":
        s, p, o = (lexical(x) for x in t.parts)
        return F.concat(F.lit("<< "), s, F.lit(" "), p, F.lit(" "), o, F.lit(" >>"))
    if d.kind == "lit" and not d.opaque:
        if d.dt == DATE_TIME:
            return F.replace(t.col.cast("string"), F.lit(" "), F.lit("T"))
        if d.dt in (LIST, MAP):
            return F.to_json(t.col)
        if d.dt == XSD + "decimal":
            return F.regexp_replace(F.regexp_replace(t.col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return t.col.cast("string")


def dynamic(t: Term) -> Column:
    d = t.desc
    if d.kind == "dyn":
        return t.col
    if d.kind == "none":
        return F.lit(None).cast(DYNAMIC)
    k = {"iri": IRI, "bnode": BNODE, "lit": LITERAL, "triple": TRIPLE}[d.kind]
    v = lexical(t)
    return F.when(v.isNotNull(), F.struct(F.lit(k).cast("tinyint").alias("k"), v.alias("v"), F.lit(d.dt).alias("dt"), F.lit(d.lang).alias("lang")))


def plain(t: Term) -> Term:
    """A template IRI with its string in place of its key."""
    return Term(PLAIN_IRI, iri_string(t)) if t.desc.kind == "iri" and t.desc.template else t


def key_of(iri: str, d: Desc) -> str | None:
    """The key that a template IRI must have to be this IRI; None if it cannot be."""
    before, after = d.template
    if not (iri.startswith(before) and iri.endswith(after) and len(iri) > len(before) + len(after)):
        return None
    key = unquote(iri[len(before) : len(iri) - len(after)])
    if d.integral and not key.lstrip("-").isdigit():
        return None
    return key


def _apart(a: tuple[str, str], b: tuple[str, str]) -> bool:
    return not (a[0].startswith(b[0]) or b[0].startswith(a[0])) or not (a[1].endswith(b[1]) or b[1].endswith(a[1]))


def disjoint(a: Desc, b: Desc) -> bool:
    """Whether no term can be of both kinds."""
    if "dyn" in (a.kind, b.kind) or "none" in (a.kind, b.kind):
        return False
    if a.kind != b.kind:
        return True
    if a.kind == "iri" and a.template and b.template and a.template != b.template:
        return _apart(a.template, b.template)
    return a.kind == "lit" and (a.dt, a.lang) != (b.dt, b.lang)


def same(a: Term, b: Term) -> Column | None:
    """Term equality as a condition; None if it cannot hold."""
    if disjoint(a.desc, b.desc):
        return None
    if "none" in (a.desc.kind, b.desc.kind):
        return F.lit(None).cast("boolean")
    if a.desc == b.desc and a.desc.kind != "triple":
        return a.col == b.col
    if a.desc.kind == b.desc.kind == "iri":
        return iri_string(a) == iri_string(b)
    if a.desc.kind == b.desc.kind == "triple" and a.parts and b.parts:
        conditions = [same(x, y) for x, y in zip(a.parts, b.parts, strict=True)]
        return None if any(c is None for c in conditions) else reduce(lambda x, y: x & y, conditions)
    if a.desc.kind == b.desc.kind == "lit":
        return lexical(a) == lexical(b)
    return dynamic(a) == dynamic(b)


def is_constant(t: Term, x) -> Column | bool:
    """Whether t is the constant x: a condition, or False if it cannot be."""
    d = t.desc
    if isinstance(x, Triple):
        if d.kind != "triple":
            return False
        out: Column | bool = F.lit(True)
        for part, y in zip(t.parts, (x.s, x.p, x.o), strict=True):
            if isinstance(y, (Iri, Lit)):
                c = is_constant(part, y)
                if c is False:
                    return False
                out = out & c
        return out
    if isinstance(x, Iri) and d.kind == "iri" and d.template:
        key = key_of(x.value, d)
        if key is None:
            return False
        return t.col == (F.lit(int(key)) if d.integral else F.lit(key))
    c = same(t, constant(x))
    return False if c is None else c


def aligned(descs: list[Desc]) -> Desc:
    """The one description under which terms of all these can stand together."""
    descs = [d for d in descs if d.kind != "none"] or descs[:1]
    if all(d == descs[0] for d in descs) and descs[0].kind != "triple":
        return descs[0]
    if all(d.kind == "iri" for d in descs):
        return PLAIN_IRI
    return DYN


def as_(t: Term, d: Desc) -> Column:
    """t's column under another description, one that aligned() gave."""
    if t.desc == d:
        return t.col
    if t.desc.kind == "none":
        return null_of(d)
    if d.kind == "iri":
        return iri_string(t)
    return dynamic(t)


def null_of(d: Desc) -> Column:
    types = {"dyn": DYNAMIC, "none": "string"}
    return F.lit(None).cast(types.get(d.kind, "void"))


def shown(t: Term) -> Column:
    """How a result column shows a term: literals natively, IRIs and others as strings."""
    d = t.desc
    if d.kind == "iri":
        return iri_string(t)
    if d.kind in ("dyn", "triple"):
        return lexical(t)
    return t.col
