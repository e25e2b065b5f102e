"""Mapped sources, vocabularies, catalogues, caches, result formats, the service, streams."""

import csv
import io
import json
import threading
import urllib.parse
import urllib.request
from xml.etree import ElementTree

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom import cli, results
from graphloom.engine import Engine
from graphloom.functions import terms as T
from graphloom.functions.terms import Term
from graphloom.operators import relation as R
from graphloom.operators.lower import Lowering
from graphloom.plans import algebra as A
from graphloom.sources import catalog, graphql, mapping, property_graph, uris
from graphloom.sources.cache import CachedMember, RequestCache, StoredMember
from graphloom.sources.turtle import Graph, read
from graphloom.sources.views import LookUpMember, TableSpec, table_fetch, table_member, triple_member
from graphloom.sources.vocabulary import Rule, Vocabulary, rewritten

EX = "http://e/"
TRIPLE = "s string, p string, o struct<k:tinyint,v:string,dt:string,lang:string>, g string"


def iri(x):
    return (T.IRI, EX + x, "", "")


def lit(v, dt="string", lang=""):
    return (T.LITERAL, v, A.LANG_STRING if lang else A.XSD + dt, lang)


@pytest.fixture(scope="module")
def people(spark):
    rows = [("ann", "knows", iri("bob")), ("bob", "knows", iri("cid")), ("cid", "knows", iri("ann")), ("ann", "age", lit("30", "integer")), ("bob", "age", lit("9", "integer")), ("ann", "name", lit("Ann", lang="en")), ("ann", "loves", iri("ann"))]
    return spark.createDataFrame([(EX + s, EX + p, o, None) for s, p, o in rows], TRIPLE)


def ask(spark, members, text, **more):
    return sorted(tuple(r) for r in Engine(spark, members, **more).select(f"PREFIX ex: <{EX}> PREFIX xsd: <{A.XSD}> " + text).collect())


def test_patterns_with_repeated_variables_and_constants(spark, people):
    m = {EX + "m": triple_member(people)}
    run = lambda text: ask(spark, m, text, default=(EX + "m",))
    assert run("SELECT ?x WHERE { ?x ?p ?x }") == [(EX + "ann",)]
    assert run("SELECT ?x WHERE { ?x ex:age 9 }") == [(EX + "bob",)]
    assert run("SELECT ?x WHERE { ?x ex:age ?a FILTER(?a > 10) }") == [(EX + "ann",)]
    assert run('SELECT ?x WHERE { ?x ex:name "Ann"@en }') == [(EX + "ann",)]
    assert run('SELECT ?x WHERE { ?x ex:name "Ann" }') == []
    assert run("SELECT ?x ?y WHERE { ?x ex:knows+ ?y . ?y ex:age 9 }") == [(EX + x, EX + "bob") for x in ("ann", "bob", "cid")]
    assert run("SELECT ?y WHERE { ex:ann ex:knows{} ?y }".replace("{}", "?")) == [(EX + "ann",), (EX + "bob",)]
    assert run("SELECT ?y WHERE { ?y ex:knows* ex:bob }") == [(EX + x,) for x in ("ann", "bob", "cid")]
    assert run("SELECT ?p WHERE { ex:ann !(ex:knows|ex:age) ?o . ex:ann ?p ?o }") == [(EX + "loves",), (EX + "name",)]
    assert run("SELECT (COUNT(*) AS ?n) WHERE { ?x (ex:knows|ex:loves)/ex:knows ?y }") == [(4,)]


def test_single_member_and_two_members(spark, people):
    other = spark.createDataFrame([(EX + "bob", EX + "lives", iri("rome"), None)], TRIPLE)
    m = {EX + "a": triple_member(people, single=True), EX + "b": triple_member(other)}
    got = ask(spark, m, "SELECT ?x ?z WHERE { SERVICE ex:a { ?x ex:knows ?y } SERVICE ex:b { ?y ex:lives ?z } }")
    assert got == [(EX + "ann", EX + "rome")]
    assert ask(spark, m, "SELECT ?x WHERE { ?x ex:knows ?y . ?y ex:lives ?z }", default=(EX + "a", EX + "b")) == [(EX + "ann",)]
    assert ask(spark, m, "SELECT ?x WHERE { ?x ex:age ?y SERVICE SILENT ex:gone { ?x ex:q ?z } }", default=(EX + "a",)) == [(EX + "ann",), (EX + "bob",)]
    with pytest.raises(ValueError, match="no federation member"):
        ask(spark, m, "SELECT * WHERE { SERVICE ex:gone { ?x ex:q ?z } }")


# ---- vocabularies


def test_vocabulary(spark, people):
    v = Vocabulary.from_triples(read(f"""PREFIX ex: <{EX}> PREFIX owl: <{A.OWL}> PREFIX rdfs: <{A.RDFS}>
        ex:knows owl:equivalentProperty ex:g-knows . ex:loves rdfs:subPropertyOf ex:g-knows . ex:bob owl:sameAs ex:g-bob , ex:g-robert . ex:Person owl:unionOf ( ex:Man ex:Woman ) ."""))
    assert Rule(A.OWL + "unionOf", EX + "Man", EX + "Person") in v.rules and not v.equivalences_only
    plan = rewritten(v, "m", (A.Triple(A.Var("x"), A.Iri(EX + "g-knows"), A.Var("y")),))
    assert len(plan.parts) == 2
    m = {EX + "m": triple_member(people, vocabulary=v)}
    got = ask(spark, m, "SELECT ?y WHERE { SERVICE ex:m { ex:ann ex:g-knows ?y } }")
    assert got == [(EX + "ann",), (EX + "g-bob",), (EX + "g-robert",)]
    assert ask(spark, m, "SELECT ?y WHERE { SERVICE ex:m { ex:g-bob ex:g-knows ?y } }") == [(EX + "cid",)]
    assert {r[0] for r in ask(spark, m, "SELECT ?p WHERE { SERVICE ex:m { ex:ann ?p ?o } }")} == {EX + "g-knows", EX + "age", EX + "name"}
    low = Lowering(spark, {}).rel(A.Translate(v, False, A.Values(("x",), ((A.Iri(EX + "g-bob"),), (A.Iri(EX + "z"),)))))
    assert sorted(r[0] for r in low.df.collect()) == [EX + "bob", EX + "z"]


# ---- mapping algebra


def documents(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "doc string")


def test_extract(spark):
    docs = documents(spark, ['{"a":[{"x":1,"y":["p","q"]},{"x":2},{"x":null,"y":["r"]}]}', "no json", None, '{"a":[]}'])
    r = mapping.extract(docs, "doc", "$.a[*]", {"x": "x", "y": "$.y[*]"})
    got = sorted((T_(v["x"]), T_(v["y"])) for v in r.df.select(r.attributes["x"].col.alias("x"), r.attributes["y"].col.alias("y")).collect())
    assert got == [("1", "p"), ("1", "q")]
    kinds = mapping.extract(documents(spark, ['{"v":[1, 2.5, true, "s", [1], {"k":1}]}']), "doc", "$.v[*]", {"v": "$"})
    assert [r["v"]["dt"].rpartition("#")[2].rpartition("/")[2] for r in kinds.df.select(kinds.attributes["v"].col.alias("v")).collect()] == ["integer", "double", "boolean", "string", "List", "Map"]


def T_(term):
    return term["v"]


def test_relation_operators(spark):
    left = mapping.extract(documents(spark, ['[{"k":1,"n":"a"},{"k":2,"n":"b c"}]']), "doc", "$[*]", {"k": "k", "n": "n"})
    right = mapping.extract(documents(spark, ['[{"k":1,"m":"z"},{"k":1,"m":"y"}]']), "doc", "$[*]", {"k2": "k", "m": "m"})
    joined = mapping.join(left, right, [("k", "k2")])
    assert joined.df.count() == 2
    e = mapping.extend(left, "s", mapping.to_iri(mapping.concat(mapping.fixed(A.Lit(EX)), mapping.attribute("n"))))
    assert sorted(map(str, [r[0] for r in e.df.select(e.attributes["s"].col).collect()])) == ["None", EX + "a"]  # a space is an error
    assert mapping.union([mapping.project(left, ["k"]), mapping.project(left, ["k"])]).df.count() == 4
    with pytest.raises(ValueError, match="already"):
        mapping.extend(left, "k", mapping.attribute("n"))
    with pytest.raises(ValueError, match="other attributes"):
        mapping.union([left, right])
    fixed = mapping.constant(spark.range(1), [{"a": A.Lit("1"), "b": A.Iri(EX)}])
    assert fixed.df.count() == 1


RML = f"""PREFIX rml: <http://w3id.org/rml/> PREFIX xsd: <{A.XSD}> PREFIX ex: <{EX}> PREFIX cdt: <{A.CDT}>
_:f a rml:FilePath ; rml:path "cases.json" .
_:one rml:logicalSource [ rml:source _:f ; rml:referenceFormulation rml:JSONPath ; rml:iterator "$" ] ;
  rml:subjectMap [ rml:reference "country" ; rml:termType rml:BlankNode ] ;
  rml:predicateObjectMap [ rml:predicateMap [ rml:constant ex:total ] ; rml:objectMap [ rml:reference "cases" ; rml:datatype xsd:integer ] ] ,
    [ rml:predicate ex:all ; rml:objectMap [ rml:reference "list" ; rml:datatype cdt:List ] ] .
"""


def test_unique_subjects_share_a_scan(spark):
    text = f"""PREFIX rml: <http://w3id.org/rml/> PREFIX ex: <{EX}>
      ex:a rml:logicalSource [ rml:source ex:d ; rml:iterator "$[*]" ] ; rml:subjectMap [ rml:template "{EX}{{id}}" ; rml:class ex:T ] ; rml:predicateObjectMap [ rml:predicate ex:v ; rml:objectMap [ rml:reference "v" ] ] .
      ex:b rml:logicalSource [ rml:source ex:d ; rml:iterator "$[*]" ] ; rml:subjectMap [ rml:template "{EX}{{id}}" ] ; rml:predicateObjectMap [ rml:predicate ex:w ; rml:objectMap [ rml:template "{EX}w/{{w.x}}" ] ] .
      ex:c rml:logicalSource [ rml:source ex:d ; rml:iterator "$[*]" ] ; rml:subjectMap [ rml:template "{EX}{{id}}" ] ; rml:predicateObjectMap [ rml:predicate ex:l ; rml:objectMap [ rml:reference "l[*]" ] ] ."""
    docs = documents(spark, ['[{"id":1,"v":"a","w":{"x":"p"},"l":[1,2]},{"id":2,"v":null},{"id":3,"w":{"x":"q r"}},{"v":"no id"}]', "none"])
    maps = mapping.read_rml(Graph(read(text)))
    answers = []
    for unique in (False, True):
        views = mapping.rml_views(maps, lambda _: (docs, "doc", ()), "u", unique=unique)
        m = {EX + "m": mapping_member(views)}
        run = lambda t: sorted(map(str, Engine(spark, m).select(f"PREFIX ex: <{EX}> SELECT * WHERE {{ SERVICE ex:m {{ {t} }} }}").collect()))  # noqa: B023, E731
        answers.append([run(t) for t in ("?x ex:v ?v ; ex:w ?w", "?x a ex:T", "?x ?p ?o", "?x ex:w ?w OPTIONAL { ?x ex:v ?v }", "?x ex:l ?l ; ex:v ?v")])
    assert answers[0] == answers[1] and len({v.rows.name for v in views}) == 2
    assert [len(a) for a in answers[0]] == [1, 3, 8, 2, 2]


def mapping_member(views):
    from graphloom.sources.views import Member

    return Member(views)


def test_rml_file_dump(spark, tmp_path, capsys):
    (tmp_path / "cases.json").write_text('{"country": "Sweden", "cases": 999, "list": [1, 2]}')
    (tmp_path / "map.ttl").write_text(RML)
    assert cli.main(["rml", str(tmp_path / "map.ttl")]) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert f'_:file-Sweden <{EX}total> "999"^^<{A.XSD}integer> .' in lines and len(lines) == 2
    m = {EX + "m": catalog.rml_files(spark, RML, str(tmp_path))}
    assert ask(spark, m, f"PREFIX cdt: <{A.CDT}> SELECT ?n ?x WHERE {{ SERVICE ex:m {{ ?c ex:total ?n ; ex:all ?l }} UNFOLD(?l AS ?x) }}") == [(999, "1"), (999, "2")]


FD = f"""PREFIX fd: <http://any.org/fd#> PREFIX hydra: <http://www.w3.org/ns/hydra/core#> PREFIX rml: <http://w3id.org/rml/> PREFIX ex: <{EX}> PREFIX xsd: <{A.XSD}>
ex:m1 fd:serviceURI "{EX}sparql"^^xsd:anyURI ; fd:interface [ fd:supportedProtocol fd:SPARQLProtocol ; fd:endpointAddress "http://a"^^xsd:anyURI ] ; fd:vocabularyMappingsFile "v.ttl" .
ex:m2 fd:serviceURI "{EX}tpf"^^xsd:anyURI ; fd:interface [ fd:supportedProtocol fd:TPFProtocol ; fd:exampleFragmentAddress "http://b"^^xsd:anyURI ] .
ex:m3 fd:serviceURI "{EX}api"^^xsd:anyURI ; fd:interface [ fd:supportedProtocol fd:GenericWebAPIProtocol ;
    fd:uriTemplate [ hydra:template "http://c/{{country}}{{?limit}}" ; hydra:mapping [ hydra:variable "country" ; hydra:required true ; fd:paramType xsd:string ] , [ hydra:variable "limit" ; hydra:required false ] ] ] ;
  fd:wrapper [ fd:rmlTriplesMaps ( _:tm ) ] .
_:tm rml:logicalSource [ rml:iterator "$" ] ; rml:subjectMap [ rml:template "{EX}c/{{country}}" ] ; rml:predicateObjectMap [ rml:predicate ex:cases ; rml:objectMap [ rml:reference "cases" ; rml:datatype xsd:integer ] ] .
"""


def fake_get(url: str) -> str:
    if "Nowhere" in url:
        raise OSError("no such page")
    return json.dumps({"country": url.rpartition("/")[2], "cases": len(url)})


def test_federation_description(spark, people, tmp_path):
    (tmp_path / "v.ttl").write_text(f"<{EX}knows> <{A.OWL}equivalentProperty> <{EX}gk> .")
    found, _ = catalog.descriptions([FD])
    assert [d.protocol for d in found] == ["SPARQLProtocol", "TPFProtocol", "GenericWebAPIProtocol"]
    m = catalog.load(spark, [FD], lambda address: people, fake_get, folder=str(tmp_path))
    assert m[EX + "tpf"].single and not m[EX + "sparql"].single
    assert len(ask(spark, m, "SELECT ?x WHERE { SERVICE ex:sparql { ?x ex:gk ?y } }")) == 3
    got = ask(spark, m, 'SELECT ?n ?c WHERE { VALUES ?n { "Oslo" "Nowhere" "New York" } SERVICE ex:api PARAMS(?n AS "country") { ?x ex:cases ?c } }')
    assert got == [("New York", len("http://c/New%20York")), ("Oslo", len("http://c/Oslo"))]
    with pytest.raises(ValueError, match="parameters"):
        ask(spark, m, "SELECT ?c WHERE { BIND(1 AS ?l) SERVICE ex:api PARAMS(?l AS \"limit\") { ?x ex:cases ?c } }")


def test_uri_templates():
    assert uris.expand("http://a/{x}{?b,c}{&d}", {"x": "a b", "b": "1&2", "c": None, "d": "z"}) == "http://a/a%20b?b=1%262&d=z"


def test_look_up_keeps_input_rows(spark):
    docs = spark.createDataFrame([("1", '{"v":"one"}'), ("2", '{"v":"two"}')], "key string, doc string")
    maps = mapping.read_rml(Graph(read(f"""PREFIX rml: <http://w3id.org/rml/> PREFIX ex: <{EX}> ex:t rml:logicalSource [ rml:iterator "$" ] ; rml:subjectMap [ rml:template "{EX}{{v}}" ] ; rml:predicateObjectMap [ rml:predicate ex:v ; rml:objectMap [ rml:reference "v" ] ] .""")))
    m = {EX + "m": LookUpMember({"key": (A.XSD + "integer", True)}, table_fetch(docs), lambda rows: mapping.rml_views(maps, lambda _: (rows.df, "doc", rows.keys), "x"))}
    body = 'SERVICE ex:m PARAMS(?k AS "key") { ?x ex:v ?v }'
    assert ask(spark, m, f"SELECT ?k ?v WHERE {{ VALUES ?k {{ 1 1 2 3 \"2\" <{EX}z> }} {body} }}")[:2] == [("1", "one"), ("1", "one")]
    assert ask(spark, m, f"SELECT ?k ?v WHERE {{ VALUES ?k {{ 1 3 }} OPTIONAL {{ {body} }} }} ORDER BY ?k") == [(1, "one"), (3, None)]


# ---- property graphs, objects


def test_property_graph(spark, tmp_path, capsys):
    nodes = spark.createDataFrame([(1, ["Person", "Actor"], {"name": "Ann"}), (2, ["Film"], {"title": "F"})], "id long, labels array<string>, props map<string,string>")
    edges = spark.createDataFrame([(9, 1, 2, "DIRECTED", {"year": "1999"}), (10, 1, 2, "SAW", {})], "id long, src long, dst long, label string, props map<string,string>")
    text = f"""PREFIX lr: <http://any.org/lpg#> PREFIX ex: <{EX}> PREFIX xsd: <{A.XSD}>
    ex:c lr:labelPredicate "{EX}label"^^xsd:anyURI ; lr:nodeMapping _:n ; lr:nodeLabelMapping _:l ; lr:edgeLabelMapping _:e ; lr:propertyNameMapping _:p .
    _:n lr:prefixOfIRIs "{EX}node/"^^xsd:anyURI . _:l a lr:LiteralBasedNodeLabelMapping .
    _:e lr:componentMappings ( [ lr:label "DIRECTED" ; lr:iri "{EX}directorOf"^^xsd:anyURI ] [ lr:prefixOfIRIs "{EX}edge/"^^xsd:anyURI ; lr:regex "S.*" ] ) . _:p lr:prefixOfIRIs "{EX}prop/"^^xsd:anyURI ."""
    config = property_graph.read_config(read(text))
    assert config.edges.iri("DIRECTED") == EX + "directorOf" and config.edges.iri("SAW") == EX + "edge/SAW" and config.edges.iri("X") is None
    m = {EX + "m": property_graph.member(nodes, edges, config)}
    run = lambda t: ask(spark, m, f"SELECT * WHERE {{ SERVICE ex:m {{ {t} }} }}")
    assert run("?x ex:label \"Actor\"") == [(EX + "node/1",)]
    assert run(f"?x ex:directorOf ?y . ?y <{EX}prop/title> ?t") == [("F", EX + "node/1", EX + "node/2")]
    assert run(f"<< ?x ?e ?y >> <{EX}prop/year> ?v") == [(EX + "directorOf", "1999", EX + "node/1", EX + "node/2")]
    assert len(run(f"<{EX}node/1> ?p ?o")) == 5
    assert run(f"<{EX}node/x> ?p ?o") == []
    (tmp_path / "c.ttl").write_text(text)
    nodes.write.parquet(str(tmp_path / "n"))
    edges.write.parquet(str(tmp_path / "e"))
    assert cli.main(["pg", str(tmp_path / "c.ttl"), "--nodes", str(tmp_path / "n"), "--edges", str(tmp_path / "e")]) == 0
    out = capsys.readouterr().out
    assert f"<{EX}node/1> <{EX}directorOf> <{EX}node/2> ." in out and len(out.splitlines()) == 8


def test_objects(spark):
    authors = spark.createDataFrame([("a1", "Ann", 30, ["b1", "b2"]), ("a2", None, 9, [])], "id string, name string, age int, books array<string>")
    books = spark.createDataFrame([("b1", "One", "a1"), ("b2", "Two", "a1")], "id string, title string, author string")
    m = {EX + "m": graphql.member({"Author": graphql.ObjectType(authors, "id", ["name", "age"], {"books": ("books", "Book")}), "Book": graphql.ObjectType(books, "id", ["title"], {"author": ("author", "Author")})}, EX)}
    assert ask(spark, m, "SELECT ?t WHERE { SERVICE ex:m { ?a ex:Author_name \"Ann\" ; ex:Author_books ?b . ?b ex:Book_title ?t } }") == [("One",), ("Two",)]
    assert ask(spark, m, "SELECT ?n WHERE { SERVICE ex:m { ?b a ex:Book ; ex:Book_author/ex:Author_age ?n } }") == [(30,), (30,)]
    assert ask(spark, m, "SELECT (COUNT(*) AS ?n) WHERE { SERVICE ex:m { ?x ?p ?o } }") == [(13,)]


# ---- caches


def test_request_cache():
    now = [0.0]
    cache = RequestCache(size=2, max_age=10, clock=lambda: now[0])
    made = []
    get = lambda k: cache.get(k, lambda: made.append(k) or k)
    get("a"), get("a"), get("b"), get("a"), get("c"), get("b")
    assert made == ["a", "b", "c", "b"]
    now[0] = 11.0
    get("b")
    assert made[-1] == "b" and len(made) == 5


def test_cached_and_stored_members(spark, people, tmp_path):
    inner = triple_member(people)
    for m in (CachedMember(inner, RequestCache()), StoredMember(inner, str(tmp_path), "people")):
        for _ in range(2):
            assert ask(spark, {EX + "m": m}, "SELECT ?x WHERE { SERVICE ex:m { ?x ex:age 9 } }") == [(EX + "bob",)]
    assert len(list(tmp_path.iterdir())) == 1


# ---- results and the service


def test_formats(spark, people):
    e = Engine(spark, {EX + "m": triple_member(people)}, default=(EX + "m",))
    text = f"PREFIX ex: <{EX}> SELECT ?x ?n ?a WHERE {{ ?x ex:age ?a OPTIONAL {{ ?x ex:name ?n }} }} ORDER BY ?x"
    terms = e.terms(text)
    out = {f: "".join(results.write(terms, f)) for f in results.FORMATS}
    rows = json.loads(out["json"])["results"]["bindings"]
    assert rows[0]["n"] == {"type": "literal", "value": "Ann", "xml:lang": "en"} and "n" not in rows[1] and rows[1]["a"]["datatype"] == A.XSD + "integer"
    assert len(ElementTree.fromstring(out["xml"]).findall(".//{*}result")) == 2  # noqa: S314
    assert list(csv.reader(io.StringIO(out["csv"])))[1:] == [[EX + "ann", "Ann", "30"], [EX + "bob", "", "9"]]
    assert out["tsv"].splitlines()[1] == f'<{EX}ann>\t"Ann"@en\t"30"^^<{A.XSD}integer>'
    assert '"Ann"@en' in out["text"]
    made = e.construct(f"PREFIX ex: <{EX}> CONSTRUCT {{ ?x ex:is [ ex:of ?n ] }} WHERE {{ ?x ex:age ?a OPTIONAL {{ ?x ex:name ?n }} }}")
    lines = [r["value"] for r in results.n_triples(made).collect()]
    assert len(lines) == 3 and sum('"Ann"@en' in x for x in lines) == 1
    assert len([r for r in e.describe(f"DESCRIBE <{EX}ann>").collect()]) == 4


def test_service(spark, people):
    server = cli.serve(Engine(spark, {EX + "m": triple_member(people)}, default=(EX + "m",)), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    text = f"SELECT ?x WHERE {{ ?x <{EX}age> 9 }}"
    get = lambda path, q, **kw: urllib.request.urlopen(urllib.request.Request(f"{url}{path}?" + urllib.parse.urlencode({"query": q}), **kw)).read().decode()  # noqa: E731, S310
    assert json.loads(get("/sparql", text))["results"]["bindings"][0]["x"]["value"] == EX + "bob"
    assert get("/sparql", text, headers={"Accept": "text/csv"}).splitlines() == ["x", EX + "bob"]
    assert json.loads(get("/sparql", f"ASK {{ ?x <{EX}age> 10 }}"))["boolean"] is False
    assert json.loads(get("/inspect", text))["rows"] == 1
    body = urllib.request.Request(f"{url}/sparql", text.encode(), {"Content-Type": "application/sparql-query"})  # noqa: S310
    assert "bob" in urllib.request.urlopen(body).read().decode()  # noqa: S310
    with pytest.raises(urllib.error.HTTPError):
        get("/sparql", "SELECT")
    server.shutdown()


FRAGMENT = [(f"<{EX}ann>", f"<{EX}knows>", f"<{EX}bob>"), (f"<{EX}bob>", f"<{EX}knows>", f"<{EX}cid>"), (f"<{EX}cid>", f"<{EX}knows>", f"<{EX}ann>"), (f"<{EX}bob>", f"<{EX}age>", f'"9"^^<{A.XSD}integer>')]


def fragment(url: str) -> str:
    """A fragment server with two triples a page."""
    given = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(url).query).items()}
    found = [t for t in FRAGMENT if all(k not in given or t[i].replace("<", "").replace(">", "") == given[k] for i, k in enumerate(("subject", "predicate", "object")))]
    if "values" in given:
        found = [t for t in found if t[0] in given["values"]]
    page = int(given.get("page", 0))
    lines = [" ".join(t) + " ." for t in found[2 * page : 2 * page + 2]]
    lines.append(f"<{url}> <http://www.w3.org/ns/hydra/core#totalItems> {len(found)} .")
    if len(found) > 2 * page + 2:
        lines.append(f"<{url}> <http://www.w3.org/ns/hydra/core#next> <{url.split('&page')[0]}&page={page + 1}> .")
    return "\n".join(lines)


@pytest.mark.parametrize("bindings", [False, True])
def test_fragments(spark, bindings):
    from graphloom.sources.fragments import FragmentMember

    other = spark.createDataFrame([(EX + "bob", EX + "lives", iri("rome"), None)], TRIPLE)
    m = {EX + "f": FragmentMember("http://f/?x=1", bindings, fragment), EX + "l": triple_member(other)}
    assert ask(spark, m, "SELECT ?x ?y WHERE { SERVICE ex:f { ?x ex:knows ?y } }") == [(EX + "ann", EX + "bob"), (EX + "bob", EX + "cid"), (EX + "cid", EX + "ann")]
    assert ask(spark, m, "SELECT ?x ?y WHERE { SERVICE ex:f { ?x ex:knows ?y . ?x ex:age 9 } }") == [(EX + "bob", EX + "cid")]
    assert ask(spark, m, "SELECT ?x ?y WHERE { SERVICE ex:l { ?x ex:lives ?c } SERVICE ex:f { ?x ex:knows ?y } }") == [(EX + "bob", EX + "cid")]
    assert ask(spark, m, "SELECT ?p WHERE { SERVICE ex:f { ex:bob ?p ?o } }") == [(EX + "age",), (EX + "knows",)]


def test_remote_endpoint(spark, people):
    """The engine's own service as a remote member: whole requests and bind joins."""
    from graphloom.sources import remote

    asked = []
    handler = cli.handler(Engine(spark, {EX + "m": triple_member(people)}, default=(EX + "m",)))
    plain = handler._answer
    handler._answer = lambda self, text: (asked.append(text), plain(self, text))[1]
    server = cli.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    other = spark.createDataFrame([(EX + x, EX + "lives", iri("rome"), None) for x in ("bob", "dan")], TRIPLE)
    m = {EX + "r": remote.RemoteMember(f"http://127.0.0.1:{server.server_address[1]}/sparql"), EX + "l": triple_member(other)}
    assert ask(spark, m, "SELECT ?x ?n WHERE { SERVICE ex:r { ?x ex:name ?n ; ex:age ?a } }") == [(EX + "ann", "Ann")]
    assert "LIMIT" in asked[-1]
    assert ask(spark, m, "SELECT ?x ?a WHERE { SERVICE ex:l { ?x ex:lives ?c } SERVICE ex:r { ?x ex:age ?a } }") == [(EX + "bob", "9")]
    assert "VALUES" in asked[-1] and "dan" in asked[-1]
    assert ask(spark, m, "SELECT ?x ?a WHERE { SERVICE ex:l { ?x ex:lives ?c } OPTIONAL { SERVICE ex:r { ?x ex:age ?a } } }") == [(EX + "bob", "9"), (EX + "dan", None)]
    server.shutdown()


# ---- streams


def test_pattern_over_a_stream(spark, tmp_path):
    from graphloom import streaming

    rows = spark.createDataFrame([(1, "a", 5.0), (2, "b", 50.0)], "id long, kind string, v double")
    rows.write.parquet(str(tmp_path / "in"))
    spec = TableSpec("events", "id", {"kind": EX + "kind", "v": EX + "v"})
    live = streaming.stream_member(spark, str(tmp_path / "in"), rows.schema, spec, EX)
    names = spark.createDataFrame([("b", "Bee")], "code string, name string")
    table = table_member(spark, {"names": names}, [TableSpec("names", "code", {"code": EX + "code", "name": EX + "name"})], EX)
    e = Engine(spark, {EX + "s": live, EX + "t": table})
    df = e.select(f"PREFIX ex: <{EX}> SELECT ?x ?n WHERE {{ SERVICE ex:s {{ ?x ex:kind ?k ; ex:v ?v }} SERVICE ex:t {{ ?y ex:code ?k ; ex:name ?n }} FILTER(?v > 10) }}")
    assert df.isStreaming
    streaming.run_once(df, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(EX + "events/2", "Bee")]
    assert spark.range(1).select(F.lit(1)).count() == 1


# ---- requests to endpoints

SX = "http://ex.org/"  # of the tables behind the stub


def stubbed(spark, folder, how="", way="values"):
    from graphloom.sources import remote, stub

    spark.createDataFrame([(i, f"N{i}", i % 2) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int").toPandas().to_parquet(f"{folder}/nation.parquet")
    rows = [(i, f"C{i}", i % 4, 100.0 * i, "S") for i in range(80)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").toPandas().to_parquet(f"{folder}/customer.parquet")
    return remote.RemoteMember(f"stub:{folder}{how}", stub.endpoint, bindings=way)


def test_service_bodies_are_sent_whole(spark, tmp_path):
    m = stubbed(spark, tmp_path)
    sent, plain = [], m.request
    m.request = lambda address, text: (sent.append(text), plain(address, text))[1]
    e = Engine(spark, {EX + "r": m})
    text = f"PREFIX ex: <{EX}> PREFIX sx: <{SX}> SELECT ?n ?r WHERE {{ SERVICE ex:r {{ ?c sx:c_name ?n ; sx:c_nation ?x OPTIONAL {{ ?x sx:n_name ?r }} }} SERVICE ex:r {{ ?c sx:c_acctbal ?b }} FILTER(?b > 7000 && ?n != \"C75\") }}"
    shown = e.explain(text).split("optimized")[1]
    assert shown.count("Remote(") == 1 and "Filter(conditions" in shown  # one request, the filter inside of it
    assert sorted(tuple(r) for r in e.select(text).collect()) == sorted((f"C{i}", f"N{i % 4}" if i % 4 < 3 else None) for i in range(71, 80) if i != 75)
    assert m.cardinality(spark, (A.Triple(A.Var("s"), A.Iri(SX + "c_name"), A.Var("o")),)) == 80 and "COUNT" in sent[-1]


@pytest.mark.parametrize(("way", "how", "word"), [("values", "", "VALUES"), ("filter", "", "FILTER"), ("union", "", "UNION"), ("rename", "", "n_3"), ("nested", "", "row_"), ("values-or-filter", "#novalues", "FILTER"), ("values", "#short", "VALUES")])
def test_ways_to_send_bindings(spark, tmp_path, way, how, word):
    from graphloom.sources import remote

    m = stubbed(spark, tmp_path, how, way)
    made = remote.Requests(A.Bgp((A.Triple(A.Var("c"), A.Iri(SX + "c_name"), A.Var("n")),)), ["c", "n"], ["c"], way)
    rows = [[{"k": 2, "v": f"{SX}customer/{i}", "dt": "", "lang": ""}] for i in range(60)]
    sent = []
    got = [r for part in made.answered(lambda text: (sent.append(text), m.request(m.endpoint, text))[1], rows, False) for r in part]
    assert [(c["v"], n["v"]) for c, n in got] == [(f"{SX}customer/{i}", f"C{i}") for i in range(60)]
    assert word in sent[-1] and len(sent) == {"nested": 60}.get(way, {"#short": 5, "#novalues": 3}.get(how, 2))
    left = spark.createDataFrame([(f"{SX}customer/{i}", EX + "seen", iri("x"), None) for i in (1, 2, 99)], TRIPLE)
    members = {EX + "r": m, EX + "l": triple_member(left)}
    assert ask(spark, members, f"SELECT ?n WHERE {{ SERVICE ex:l {{ ?c ex:seen ?x }} SERVICE ex:r {{ ?c <{SX}c_name> ?n }} }}") == [("C1",), ("C2",)]


def test_silent_services(spark, tmp_path):
    left = spark.createDataFrame([(f"{SX}customer/1", EX + "seen", iri("x"), None)], TRIPLE)
    members = {EX + "r": stubbed(spark, tmp_path, "#fail"), EX + "l": triple_member(left)}
    body = f"SELECT ?c ?n WHERE {{{{ SERVICE ex:l {{{{ ?c ex:seen ?x }}}} SERVICE {{}} ex:r {{{{ ?c <{SX}c_name> ?n }}}} }}}}"
    assert ask(spark, members, body.format("SILENT")) == [(SX + "customer/1", None)]
    with pytest.raises(Exception, match="fail"):
        ask(spark, members, body.format(""))


def test_requests_are_sent_again(monkeypatch):
    from graphloom.sources import remote

    sent = []

    class Answer(io.BytesIO):
        def __enter__(self):
            return self

    def urlopen(request, timeout):
        sent.append(request)
        if len(sent) < 3:
            raise urllib.error.URLError("busy")
        return Answer(b"{}")

    monkeypatch.setattr(remote.urllib.request, "urlopen", urlopen)
    monkeypatch.setattr(remote, "PAUSE", 0.0)
    assert remote.ask("http://x/", "ASK {}") == {} and len(sent) == 3


def test_patterns_are_written_as_they_are_read():
    from graphloom.sparql import writer
    from graphloom.sparql.parser import parse

    for text in (
        '?s <x:p> ?o ; <x:q> "a\\"b"@en FILTER(?o > 3 || !(BOUND(?s)) && REGEX(?o, "x") || ?o IN (1, 2))',
        "?s (<x:p>/^<x:q>|<x:r>)* ?o . ?o !(<x:a>|^<x:b>) ?z OPTIONAL { ?o <x:p> ?w FILTER(?w < -1) } MINUS { ?s <x:q> 5 }",
        "{ ?s <x:p> ?o } UNION { ?o <x:p> ?s } VALUES (?s ?z) { (<x:a> UNDEF) } BIND(STRLEN(?s) + 1 AS ?n) GRAPH ?g { ?s ?p ?n } FILTER NOT EXISTS { ?s <x:z> ?q }",
        "{ SELECT DISTINCT ?s WHERE { ?s <x:p> ?o } } ?s a <x:C>",
    ):
        once = writer.pattern(parse(f"SELECT * WHERE {{ {text} }}").body.child)
        assert writer.pattern(parse(f"SELECT * WHERE {{ {once} }}").body.child) == once


def test_a_stub_starts_from_the_bindings_that_a_filter_lists(spark, tmp_path, monkeypatch):
    from graphloom.sources import remote, stub

    m = stubbed(spark, tmp_path, "", "filter")
    asked, plain = [], stub._value
    monkeypatch.setattr(stub, "_value", lambda e, row: (asked.append(e), plain(e, row))[1])
    made = remote.Requests(A.Bgp((A.Triple(A.Var("c"), A.Iri(SX + "c_name"), A.Var("n")),)), ["c", "n"], ["c"], "filter")
    rows = [[{"k": 2, "v": f"{SX}customer/{i}", "dt": "", "lang": ""}] for i in (3, 7, 7, 99)]
    got = made.read(stub.answered(m.endpoint, made.text(rows)), rows)
    assert [n["v"] for _, n in got] == ["C3", "C7"] and not asked  # before: each condition for each of the 80 customers


def test_a_stub_keeps_columns_and_makes_the_rows_of_a_page_only(spark, tmp_path, monkeypatch):
    from graphloom.sources import stub

    m = stubbed(spark, tmp_path)
    made, plain = [], stub._literal
    monkeypatch.setattr(stub, "_literal", lambda v: (made.append(v), plain(v))[1])
    monkeypatch.setattr(stub, "PER_PAGE", 10)
    page = stub.page_of(m.endpoint + "?" + urllib.parse.urlencode({"predicate": SX + "c_name", "page": 3}))
    assert [x.split('"')[1] for x in page.split("\n")[:10]] == [f"C{i}" for i in range(30, 40)] and "totalItems> 80" in page and "page=4" in page
    assert len(made) == 10  # before: a term for each value of each column
    one = stub.answered(m.endpoint, f"SELECT ?n WHERE {{ VALUES (?c) {{ (<{SX}customer/5>) (<{SX}customer/05>) }} ?c <{SX}c_name> ?n }}")
    assert [b["n"]["value"] for b in one["results"]["bindings"]] == ["C5"] and len(made) == 11
    by_value = stub.answered(m.endpoint, f'SELECT ?c WHERE {{ ?c <{SX}c_acctbal> "700.0"^^<{A.XSD}double> }}')
    assert [b["c"]["value"] for b in by_value["results"]["bindings"]] == [f"{SX}customer/7"]
    linked = stub.answered(m.endpoint, f"SELECT ?c WHERE {{ ?c <{SX}c_nation> <{SX}nation/2> }}")
    assert [b["c"]["value"] for b in linked["results"]["bindings"]] == [f"{SX}customer/{i}" for i in range(2, 80, 4)]


def test_small_answers_share_a_frame(spark, tmp_path, monkeypatch):
    """A frame has its own conversion, which one for each binding would pay."""
    from graphloom.sources import fragments, remote, stub

    runs = []
    for kind in (remote.RemoteMember, fragments.FragmentMember):
        monkeypatch.setattr(kind, "_read", lambda self, source, run, *rest: runs.append(run))
    m = stubbed(spark, tmp_path, "", "nested")
    left = R.made(spark.range(60).select(F.concat(F.lit(f"{SX}customer/"), "id").alias("c")), {"c": Term(T.PLAIN_IRI, F.col("c"))}, {"c"})
    t = (A.Triple(A.Var("c"), A.Iri(SX + "c_name"), A.Var("n")),)
    m.bind(left, t)
    f = fragments.FragmentMember(m.endpoint, True, stub.fragment)
    f.bind(left, t)
    keys = pd.DataFrame({"k0": [{"k": 2, "v": f"{SX}customer/{i}", "dt": "", "lang": ""} for i in range(60)]})
    for run in runs:
        frames = list(run([keys]))
        assert len(frames) == 1 and sorted(x["v"] for x in frames[0].iloc[:, 1]) == sorted(f"C{i}" for i in range(60))


def test_joins_of_one_member_go_by_keys(spark, monkeypatch):
    """Customers and suppliers of one nation meet through orders, not all with all."""
    tables = {
        "n": spark.createDataFrame([(1,)], "k long"),
        "s": spark.createDataFrame([(i, 1) for i in range(30)], "k long, n long"),
        "c": spark.createDataFrame([(i, 1) for i in range(30)], "k long, n long"),
        "o": spark.createDataFrame([(i, i, 29 - i) for i in range(30)], "k long, c long, s long"),
    }
    links = {"n": {}, "s": {"n": (EX + "s_n", "n")}, "c": {"n": (EX + "c_n", "n")}, "o": {"c": (EX + "o_c", "c"), "s": (EX + "o_s", "s")}}
    m = table_member(spark, tables, [TableSpec(t, "k", {"k": f"{EX}{t}_k"}, links[t]) for t in tables], EX)
    e = Engine(spark, {EX + "m": m}, default=(EX + "m",))
    text = f"PREFIX ex: <{EX}> SELECT ?o WHERE {{ ?o ex:o_c ?c ; ex:o_s ?s . ?c ex:c_n ?n . ?s ex:s_n ?n . ?n ex:n_k ?k }}"
    assert e.select(text).count() == 30
    order = []
    plain = R.join
    monkeypatch.setattr(R, "join", lambda a, b, *more: (order.append((set(a.descs), set(b.descs))), plain(a, b, *more))[1])
    e.select(text)
    # each join has all of a key of one side: before, suppliers met customers by nation alone
    assert [sorted(a & b) for a, b in order] == [["n"], ["s"], ["c", "n"]]
