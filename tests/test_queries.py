"""The registered queries against DuckDB, with rewriting on and off; plans; parsing."""

import os

import pytest

from graphloom import catalogue, mapped
from graphloom.engine import Engine
from graphloom.plans import algebra as A
from graphloom.plans import rules
from graphloom.sources.views import SingleMember
from graphloom.sparql.lexer import SyntaxProblem
from graphloom.sparql.parser import parse
from graphloom.virtual import EX, federation

TABLES = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")


def value(v):
    if isinstance(v, bool):
        return ("b", v)
    try:
        return ("n", round(float(v), 6)) if not isinstance(v, str) else ("s", v)
    except (TypeError, ValueError):
        return ("s", str(v))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{TABLES}/{f}')")
    return con


@needs_tables
@pytest.mark.parametrize("name", list(catalogue.QUERIES) + list(mapped.QUERIES) + [f.__name__ for f in mapped._OTHERS])
def test_against_duckdb(spark, duck, name):
    df = catalogue.queries()[name](spark, TABLES)
    got = df.collect()
    result = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(value(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    assert sorted(tuple(value(r[c]) for c in sorted(columns)) for r in got) == want


@needs_tables
def test_whole_lists_are_unfolded(spark):
    rows = spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()
    want = sorted((r["vec_id"], i + 1, x) for r in rows for i, x in enumerate(r["embedding"]))
    assert sorted(tuple(r) for r in catalogue.queries()["unfold_list_pos"](spark, TABLES).select("id", "i", "x").collect()) == want


@needs_tables
def test_ordered_queries_return_all_rows(spark):
    table = lambda name: spark.read.parquet(f"{TABLES}/{name}.parquet").collect()
    rows = lambda name, *columns: [tuple(r) for r in catalogue.queries()[name](spark, TABLES).select(*columns).collect()]
    quality = {r["doc_id"]: r["quality"] for r in table("labels")}
    docs = [(r["doc_id"], quality.get(r["doc_id"])) for r in table("documents")]
    got = rows("order_unbound_first", "id", "q")
    assert got == sorted(docs, key=lambda r: (-1 if r[1] is None else r[1], r[0])) and {q for _, q in got} == {None, 0, 1}
    assert rows("distinct_ordered", "s", "b") == sorted({(r["p_size"], r["p_brand"]) for r in table("part")}, key=lambda r: (-r[0], r[1]))
    assert [n for n, _ in rows("triples_numeric_order", "n", "k")] == [r["n_name"] for r in sorted(table("nation"), key=lambda r: -r["n_nationkey"])]


@needs_tables
@pytest.mark.parametrize("name", ["bgp_star_merge", "join_chain3", "left_join_filter", "minus", "exists_correlated", "union_mixed_types", "values_service", "vocab_subclass_union", "vocab_l2g", "subselect"])
def test_rewriting_changes_no_result(spark, name):
    text = catalogue.PREFIXES + catalogue.QUERIES[name][0]
    members = federation(spark, TABLES)
    rows = [sorted(map(str, Engine(spark, members, (f"{EX}m/tpch",), optimize=on).select(text).collect())) for on in (True, False)]
    assert rows[0] == rows[1]


@needs_tables
def test_a_star_is_one_scan_with_pushed_filters(spark):
    text = catalogue.PREFIXES + catalogue.QUERIES["bgp_star_merge"][0]
    plan = catalogue.engine(spark, TABLES).select(text)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert "LessThan(p_size,10)" in plan and "p_retailprice" not in plan


@needs_tables
def test_keys_join_as_numbers(spark):
    text = catalogue.PREFIXES + catalogue.QUERIES["star_join_filter"][0]
    plan = catalogue.engine(spark, TABLES).select(text)._jdf.queryExecution().executedPlan().toString()
    assert "concat" not in plan and "EqualTo(c_mktsegment,BUILDING)" in plan and "GreaterThan(o_totalprice,100000" in plan


@needs_tables
def test_joins_ordered_by_counts(spark):
    e = Engine(spark, federation(spark, TABLES), counting=True)
    text = catalogue.PREFIXES + "SELECT * WHERE { SERVICE m:orders { ?o ex:o_customer ?c } SERVICE m:customer { ?c ex:c_nation ?n } SERVICE m:nation { ?n ex:n_name ?x } }"
    plan = e.plan(parse(text)).child
    assert [p.member.rpartition("/")[2] for p in plan.parts] == ["nation", "customer", "orders"]
    assert sorted(e.counts.values())[0] == 25
    assert e.select(text).count() == Engine(spark, federation(spark, TABLES)).select(text).count()


@needs_tables
@pytest.mark.parametrize(("hint", "node"), [("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin")])
def test_join_hints(spark, hint, node):
    e = Engine(spark, federation(spark, TABLES), join=hint)
    df = e.select(catalogue.PREFIXES + catalogue.QUERIES["join_one_var"][0])
    assert node in df._jdf.queryExecution().executedPlan().toString() and df.count() == 25


@needs_tables
def test_order_survives_distinct(spark):
    df = catalogue.engine(spark, TABLES).select(catalogue.PREFIXES + "SELECT DISTINCT ?s WHERE { ?p ex:p_size ?s } ORDER BY DESC(?s)")
    got = [r["s"] for r in df.collect()]
    assert got == sorted(set(got), reverse=True)


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[0]) >= 100


# ---- plans

a, b, c = (A.Var(x) for x in "abc")
P, Q = A.Iri(EX + "p"), A.Iri(EX + "q")


class Sources(dict):
    pass


class Dummy:
    single, vocabulary = False, None

    def matching(self, t):
        return [1] if t.p != A.Iri(EX + "none") else []


def test_requests_at_one_member_merge():
    members = {"m": Dummy(), "n": Dummy()}
    t, u = A.Triple(a, P, b), A.Triple(a, Q, c)
    plan = A.Join((A.Request("m", (t,)), A.Request("n", (u,)), A.Request("m", (u,))))
    assert rules.merge_requests(plan, members).parts[0] == A.Request("m", (t, u))
    members["m"] = SingleMember([])
    assert len(rules.merge_requests(plan, members).parts) == 3


def test_empty_parts_go():
    none = A.Request("m", (A.Triple(a, A.Iri(EX + "none"), b),))
    some = A.Request("m", (A.Triple(a, P, b),))
    clean = lambda op: rules.remove_empty(op, {"m": Dummy()})
    assert clean(A.Union((none, some))) == some
    assert isinstance(clean(A.Join((none, some))), A.Nothing)
    assert clean(A.Minus(some, none)) == some
    assert clean(A.LeftJoin(some, none)).left == some


def test_filters_move_to_what_binds_their_variables():
    r1, r2 = A.Request("m", (A.Triple(a, P, b),)), A.Request("m", (A.Triple(a, Q, c),))
    cond = A.Call("<", (b, A.Const(A.Lit("1", A.XSD + "integer"))))
    assert rules.push_filters(A.Filter((cond,), A.Join((r1, r2)))) == A.Join((A.Filter((cond,), r1), r2))
    assert rules.push_filters(A.Filter((cond,), A.LeftJoin(r2, r1))) == A.Filter((cond,), A.LeftJoin(r2, r1))
    assert rules.push_filters(A.Filter((cond,), A.LeftJoin(r1, r2))) == A.LeftJoin(A.Filter((cond,), r1), r2)
    assert rules.push_filters(A.Filter((cond,), A.Union((r1, r1)))) == A.Union((A.Filter((cond,), r1),) * 2)


def test_joins_avoid_cross_products():
    r1, r2, r3 = A.Request("m", (A.Triple(a, P, A.Lit("x")),)), A.Request("m", (A.Triple(A.Var("z"), Q, c),)), A.Request("m", (A.Triple(a, P, c),))
    assert rules.order_joins(A.Join((r2, r1, r3))).parts == (r1, r3, r2)


def test_services_expand():
    q = parse("SELECT * WHERE { VALUES ?s { <http://m> UNDEF } SERVICE ?s { ?a <http://p> ?b } ?a <http://q> ?c }")
    op = rules.expand_services(q.body)
    branches = op.child.parts
    assert len(branches) == 2
    assert any(isinstance(p, A.Service) and p.target == A.Iri("http://m") for p in branches[0].parts)
    assert not any(isinstance(p, A.Service) for p in branches[1].parts)
    with pytest.raises(ValueError, match="service variables"):
        rules.expand_services(parse("SELECT * WHERE { ?x <http://p> ?s SERVICE ?s { ?a <http://p> ?b } }").body)


def test_certain_and_possible_variables():
    q = parse("SELECT * WHERE { ?a <http://p> ?b OPTIONAL { ?b <http://q> ?c } { ?a <http://r> ?d } UNION { ?a <http://r> ?e } BIND(1 AS ?f) BIND(?c + 1 AS ?g) }")
    body = q.body.child
    assert A.possible(body) == set("abcdefg") and A.certain(body) == set("abf")


# ---- parsing


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * WHERE { ?s ?p ?o }",
        "PREFIX : <http://e/> SELECT DISTINCT ?x { ?x a :T ; :p 1, 2.0, 3e1, -4, true, 'x'@en-GB, \"\"\"long \"quoted\" text\"\"\" . }",
        "BASE <http://e/> SELECT REDUCED ?x FROM <g> FROM NAMED <h> WHERE { <s> <p>/^<q>|!(<r>|^a)/(<t>*) ?x . }",
        "SELECT (COUNT(*) AS ?n) (GROUP_CONCAT(DISTINCT ?x; SEPARATOR=', ') AS ?g) { ?x ?p [ ?q (1 2 _:b) ] } GROUP BY ?p (STR(?x) AS ?s) HAVING (?n > 1) ORDER BY DESC(?n) ?p LIMIT 2 OFFSET 1",
        "ASK { GRAPH ?g { ?s ?p ?o } FILTER NOT EXISTS { ?s ?p 3 } }",
        "CONSTRUCT { ?s <http://p> [] } WHERE { ?s ?p ?o }",
        "CONSTRUCT WHERE { ?s <http://p> ?o }",
        "DESCRIBE ?x <http://e/y> WHERE { ?x ?p ?o }",
        "SELECT * { SERVICE SILENT <http://m> PARAMS(?a AS \"x\", ?b) { << ?s ?p ?o >> ?q ?v } UNFOLD(?v AS ?i, ?j) } VALUES (?a ?b) { (1 UNDEF) }",
        "SELECT * { ?s ?p ?o MINUS { ?s ?p 1 } FILTER(?o IN (1, 2) && !BOUND(?z) || ?o NOT IN (3)) } # the end",
    ],
)
def test_parses(text):
    assert parse(text).form


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT ?x", "SELECT * { ?s ?p }", "SELECT * { ?s x:p ?o }", "SELECT * { BIND(1 AS ?x) BIND(2 AS ?x) }", "SELECT * { ?s ?p ?o } extra", "SELECT * { VALUES (?a ?b) { (1) } }", "SELECT * { FILTER(STRLEN()) }", "SELECT * { ?s ?p ?o FILTER(COUNT(?s) > 1) } }"])
def test_refuses(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


def test_annotations_are_triples_about_triples():
    q = parse("PREFIX : <http://e/> SELECT * WHERE { ?s :p :o {| :q 1 ; :r 2 |} , :o2 }")
    triples = q.body.child.triples
    about = A.Triple(A.Var("s"), A.Iri("http://e/p"), A.Iri("http://e/o"))
    assert triples[0] == about and [t.s for t in triples[1:3]] == [about, about] and len(triples) == 4


def test_escapes():
    q = parse(r'SELECT * WHERE { ?s ?p "a\n\"é\\" }')
    assert q.body.child.triples[0].o == A.Lit('a\n"é\\')
