"""Results in the SPARQL formats: rows of dynamic terms as JSON, XML, CSV, TSV, text or N-Triples."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.algebra import LANG_STRING, XSD

BNODE, IRI = 1, 2


def _json_term(t) -> dict:
    if t["k"] == IRI:
        return {"type": "uri", "value": t["v"]}
    if t["k"] == BNODE:
        return {"type": "bnode", "value": t["v"].removeprefix("_:")}
    out = {"type": "literal", "value": t["v"]}
    if t["lang"]:
        return out | {"xml:lang": t["lang"]}
    return out if t["dt"] in ("", XSD + "string") else out | {"datatype": t["dt"]}


def to_json(variables: list[str], rows: Iterable) -> Iterator[str]:
    yield json.dumps({"vars": variables}).join(('{"head":', ',"results":{"bindings":['))
    for i, r in enumerate(rows):
        yield ("," if i else "") + json.dumps({v: _json_term(r[v]) for v in variables if r[v] is not None}, ensure_ascii=False)
    yield "]}}"


def to_xml(variables: list[str], rows: Iterable) -> Iterator[str]:
    yield '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">\n<head>' + "".join(f"<variable name={quoteattr(v)}/>" for v in variables) + "</head>\n<results>\n"
    for r in rows:
        cells = []
        for v in variables:
            if r[v] is None:
                continue
            t = _json_term(r[v])
            extra = f" xml:lang={quoteattr(t['xml:lang'])}" if "xml:lang" in t else f" datatype={quoteattr(t['datatype'])}" if "datatype" in t else ""
            cells.append(f"<binding name={quoteattr(v)}><{t['type']}{extra}>{escape(t['value'])}</{t['type']}></binding>")
        yield f"<result>{''.join(cells)}</result>\n"
    yield "</results>\n</sparql>\n"


def turtle_term(t) -> str:
    """A term as N-Triples writes it."""
    if t is None:
        return ""
    if t["k"] == IRI:
        return f"<{t['v']}>"
    if t["k"] == BNODE:
        return t["v"] if t["v"].startswith("_:") else f"_:{t['v']}"
    text = t["v"].replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    tail = f"@{t['lang']}" if t["lang"] else "" if t["dt"] in ("", XSD + "string") else f"^^<{t['dt']}>"
    return f'"{text}"{tail}'


def _quoted(v: str) -> str:
    return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n\r') else v


def to_csv(variables: list[str], rows: Iterable) -> Iterator[str]:
    yield ",".join(variables) + "\r\n"
    for r in rows:
        yield ",".join(_quoted(r[v]["v"]) if r[v] is not None else "" for v in variables) + "\r\n"


def to_tsv(variables: list[str], rows: Iterable) -> Iterator[str]:
    yield "\t".join(f"?{v}" for v in variables) + "\n"
    for r in rows:
        yield "\t".join(turtle_term(r[v]) for v in variables) + "\n"


def to_text(variables: list[str], rows: Iterable) -> Iterator[str]:
    """A table for people; widths need all rows, so it is for small results."""
    table = [variables, *[[turtle_term(r[v]) for v in variables] for r in rows]]
    widths = [max(len(row[i]) for row in table) for i in range(len(variables))]
    line = "-" * (sum(widths) + 3 * len(widths) + 1)
    for i, row in enumerate(table):
        yield ("" if i else line + "\n") + "| " + " | ".join(x.ljust(w) for x, w in zip(row, widths, strict=True)) + " |\n" + (line.replace("-", "=") + "\n" if not i else "")
    yield line + "\n"


FORMATS = {"json": to_json, "xml": to_xml, "csv": to_csv, "tsv": to_tsv, "text": to_text}
MEDIA = {
    "application/sparql-results+json": "json",
    "application/json": "json",
    "application/sparql-results+xml": "xml",
    "text/csv": "csv",
    "text/tab-separated-values": "tsv",
}


def write(terms: DataFrame, form: str) -> Iterator[str]:
    """A SELECT result (Engine.terms) in a format, row by row as the driver receives partitions."""
    return FORMATS[form](terms.columns, terms.toLocalIterator())


def ask_json(answer: bool) -> str:
    return json.dumps({"head": {}, "boolean": answer})


def n_triples(triples: DataFrame) -> DataFrame:
    """One column `value` of N-Triples lines from s, p, o, dt, lang; ready for df.write.text()."""
    blank = lambda c: F.when(c.startswith("_:"), F.regexp_replace(c, r"[^A-Za-z0-9_:\-]", "_"))
    node = lambda c: F.coalesce(blank(c), F.concat(F.lit("<"), c, F.lit(">")))

    def quoted(c: Column) -> Column:
        for what, to in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            c = F.replace(c, F.lit(what), F.lit(to))
        return F.concat(F.lit('"'), c, F.lit('"'))

    literal = F.concat(quoted(F.col("o")), F.when(F.col("dt") == LANG_STRING, F.concat(F.lit("@"), F.col("lang"))).when(F.col("dt") == XSD + "string", F.lit("")).otherwise(F.concat(F.lit("^^<"), F.col("dt"), F.lit(">"))))
    o = F.when(F.col("dt") != "", literal).otherwise(node(F.col("o")))
    return triples.select(F.concat(node(F.col("s")), F.lit(" "), node(F.col("p")), F.lit(" "), o, F.lit(" .")).alias("value"))
