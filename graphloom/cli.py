"""python -m graphloom.cli: run a query, print its plans, dump mapped sources, or serve the SPARQL protocol."""

from __future__ import annotations

import argparse
import json
import sys
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import SparkSession

from graphloom import results
from graphloom.engine import Engine
from graphloom.plans import algebra as A
from graphloom.sources import catalog, mapping, property_graph
from graphloom.sources.turtle import read
from graphloom.sparql.lexer import SyntaxProblem
from graphloom.sparql.parser import parse
from graphloom.virtual import EX, federation


def engine_of(spark: SparkSession, args: argparse.Namespace) -> Engine:
    """Members of federation descriptions (--fd), or the tables of a folder (--tables)."""
    if args.fd:
        triples = lambda address: spark.read.parquet(f"{args.triples}/{urllib.parse.quote(address, safe='')}")
        members = catalog.load(spark, [Path(f).read_text() for f in args.fd], triples if args.triples else None, _get, folder=str(Path(args.fd[0]).parent), remote=True)
        return Engine(spark, members, default=tuple(args.default or ()), optimize=not args.no_rewriting)
    return Engine(spark, federation(spark, args.tables), default=tuple(args.default or (f"{EX}m/tpch",)), optimize=not args.no_rewriting)


def _get(url: str) -> str:
    import urllib.request

    with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
        return answer.read().decode()


def answered(engine: Engine, text: str, form: str):
    """Chunks of a query's answer in a format."""
    query = parse(text)
    if query.form == "SELECT":
        return results.write(engine.terms(text), form)
    if query.form == "ASK":
        return iter([results.ask_json(engine.ask(text)) if form == "json" else str(engine.ask(text)).lower() + "\n"])
    made = engine.construct(text) if query.form == "CONSTRUCT" else engine.describe(text)
    return (r["value"] + "\n" for r in results.n_triples(made).toLocalIterator())


def inspected(engine: Engine, text: str) -> dict:
    """A query's plans and the time that each step took."""
    query = parse(text)
    began = time.perf_counter()
    assigned = engine.assigned(query)
    middle = time.perf_counter()
    plan = engine.plan(query)
    planned = time.perf_counter()
    df = engine.lower(plan).df
    lowered = time.perf_counter()
    n = df.count()
    return {
        "sourceAssignment": A.show(assigned),
        "logicalPlan": A.show(plan),
        "physicalPlan": df._jdf.queryExecution().executedPlan().toString(),
        "rows": n,
        "seconds": {"assign": middle - began, "plan": planned - middle, "compile": lowered - planned, "run": time.perf_counter() - lowered},
    }


def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        """GET and POST /sparql (results by Accept), /inspect (plans and times as JSON)."""

        def _answer(self, text: str | None) -> None:
            path = urllib.parse.urlparse(self.path).path
            if text is None or path not in ("/sparql", "/inspect"):
                self.send_error(400 if path in ("/sparql", "/inspect") else 404)
                return
            try:
                if path == "/inspect":
                    media, body = "application/json", json.dumps(inspected(engine, text))
                else:
                    wanted = [m.split(";")[0].strip() for m in self.headers.get("Accept", "").split(",")]
                    media = next((m for m in wanted if m in results.MEDIA), "application/sparql-results+json")
                    if parse(text).form in ("CONSTRUCT", "DESCRIBE"):
                        media = "application/n-triples"
                    body = "".join(answered(engine, text, results.MEDIA.get(media, "json")))
            except (SyntaxProblem, ValueError, NotImplementedError) as e:
                self.send_error(400, str(e)[:200].replace("\n", " "))
                return
            data = body.encode()
            self.send_response(200)
            self.send_header("Content-Type", media)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self._answer(urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).get("query", [None])[0])

        def do_POST(self) -> None:  # noqa: N802
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            if self.headers.get("Content-Type", "").startswith("application/sparql-query"):
                self._answer(body)
            else:
                self._answer(urllib.parse.parse_qs(body).get("query", [None])[0])

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(engine: Engine, port: int = 8080) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), handler(engine))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["query", "explain", "inspect", "serve", "rml", "pg"])
    p.add_argument("file", nargs="?", help="a query, an RML mapping, or a property graph's configuration")
    p.add_argument("--fd", action="append", help="a federation description in Turtle; several are merged")
    p.add_argument("--triples", help="a folder of triple tables, one per endpoint address (percent-encoded)")
    p.add_argument("--tables", default=".", help="a folder of Parquet tables")
    p.add_argument("--default", action="append", help="a member for patterns outside of SERVICE")
    p.add_argument("--format", choices=list(results.FORMATS), default="text")
    p.add_argument("--nodes", help="a Parquet table of nodes, for pg")
    p.add_argument("--edges", help="a Parquet table of edges, for pg")
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--no-rewriting", action="store_true")
    p.add_argument("--time", action="store_true", help="print the time that planning took")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if args.command in ("rml", "pg"):
        text = Path(args.file).read_text()
        if args.command == "rml":
            member = catalog.rml_files(spark, text, str(Path(args.file).parent))
        else:
            member = property_graph.member(spark.read.parquet(args.nodes), spark.read.parquet(args.edges), property_graph.read_config(read(text)))
        for row in results.n_triples(mapping.triples(member.views).drop("k")).toLocalIterator():
            print(row["value"])
        return 0
    engine = engine_of(spark, args)
    if args.command == "serve":
        serve(engine, args.port).serve_forever()
        return 0
    text = Path(args.file).read_text()
    if args.command == "explain":
        print(engine.explain(text))
    elif args.command == "inspect":
        print(json.dumps(inspected(engine, text), indent=1))
    else:
        sys.stdout.writelines(answered(engine, text, args.format))
    if args.time:
        print(json.dumps(engine.measured), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
