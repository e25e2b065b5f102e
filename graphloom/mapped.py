"""Registered queries over mapped sources: JSON documents, property graphs, object types, triples, look-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.functions import terms as T
from graphloom.plans import algebra as A
from graphloom.sources import graphql, mapping, property_graph
from graphloom.sources.turtle import Graph, read
from graphloom.sources.views import LookUpMember, Member, table_fetch, triple_member
from graphloom.virtual import EX, federation

PREFIXES = f"PREFIX ex: <{EX}> PREFIX m: <{EX}m/> PREFIX xsd: <{A.XSD}> PREFIX rdfs: <{A.RDFS}> PREFIX cdt: <{A.CDT}>\n"

#: Triples maps over JSON documents that the tables below are turned into.
RML = f"""
@prefix rml: <http://w3id.org/rml/> .
@prefix xsd: <{A.XSD}> .
@prefix ex: <{EX}> .
@prefix cdt: <{A.CDT}> .
ex:eventKey rml:logicalSource [ rml:source ex:events ; rml:referenceFormulation rml:JSONPath ; rml:iterator "$" ] ;
  rml:subjectMap [ rml:template "{EX}event/{{id}}" ; rml:class ex:Event ] ;
  rml:predicateObjectMap [ rml:predicateMap [ rml:constant ex:k ] ; rml:objectMap [ rml:reference "props.k" ; rml:datatype xsd:integer ] ] .
ex:eventType rml:logicalSource [ rml:source ex:events ; rml:referenceFormulation rml:JSONPath ; rml:iterator "$" ] ;
  rml:subjectMap [ rml:template "{EX}event/{{id}}" ] ;
  rml:predicateObjectMap [ rml:predicateMap [ rml:constant ex:kind ] ; rml:objectMap [ rml:reference "type" ] ] .
ex:eventProps rml:logicalSource [ rml:source ex:events ; rml:referenceFormulation rml:JSONPath ; rml:iterator "$" ] ;
  rml:subjectMap [ rml:reference "id" ; rml:termType rml:BlankNode ] ;
  rml:predicateObjectMap [ rml:predicateMap [ rml:constant ex:props ] ; rml:objectMap [ rml:reference "props" ; rml:datatype cdt:Map ] ] .
ex:turnText rml:logicalSource [ rml:source ex:chats ; rml:referenceFormulation rml:JSONPath ; rml:iterator "$.turns[*]" ] ;
  rml:subjectMap [ rml:template "{EX}turn/{{conv}}-{{turn}}" ] ;
  rml:predicateObjectMap [ rml:predicateMap [ rml:constant ex:role ] ; rml:objectMap [ rml:reference "role" ] ] .
ex:nationRegion rml:logicalSource [ rml:source ex:nations ; rml:referenceFormulation rml:JSONPath ; rml:iterator "$" ] ;
  rml:subjectMap [ rml:template "{EX}n/{{key}}" ] ;
  rml:predicateObjectMap [ rml:predicateMap [ rml:constant ex:inside ] ; rml:objectMap [ rml:parentTriplesMap ex:regionName ; rml:joinCondition [ rml:child "region" ; rml:parent "key" ] ] ] .
ex:regionName rml:logicalSource [ rml:source ex:regions ; rml:referenceFormulation rml:JSONPath ; rml:iterator "$" ] ;
  rml:subjectMap [ rml:template "{EX}r/{{name}}" ] ;
  rml:predicateObjectMap [ rml:predicateMap [ rml:constant ex:called ] ; rml:objectMap [ rml:reference "name" ] ] .
"""


def _json(spark: SparkSession, sf_dir: str) -> Callable:
    def documents(source) -> tuple[DataFrame, str, tuple[str, ...]]:
        name = source.value.rpartition("/")[2]
        if name == "events":
            t = spark.read.parquet(f"{sf_dir}/events.parquet")
            doc = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.from_json("props", "k bigint").alias("props")))
        elif name == "chats":
            # a document per turn with a list of one: documents stay small whatever a conversation holds
            t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
            doc = F.to_json(F.struct(F.array(F.struct(F.col("conv_id").alias("conv"), "turn", "role")).alias("turns")))
        elif name == "nations":
            t = spark.read.parquet(f"{sf_dir}/nation.parquet")
            doc = F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("region")))
        else:
            t = spark.read.parquet(f"{sf_dir}/region.parquet")
            doc = F.to_json(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))
        return t.select(doc.alias("doc")), "doc", ()

    return documents


def _rml_member(spark: SparkSession, sf_dir: str, *names: str, unique: bool = False) -> Member:
    maps = mapping.read_rml(Graph(read(RML)))
    return Member(mapping.rml_views(maps, _json(spark, sf_dir), "rml", only=[A.Iri(EX + n) for n in names], unique=unique))


def _graph_member(spark: SparkSession, sf_dir: str) -> Member:
    """Customers and orders as nodes, orders' placing as edges with a property."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n1 = c.select((F.col("c_custkey") * 2).alias("id"), F.array(F.lit("Customer")).alias("labels"), F.create_map(F.lit("name"), F.col("c_name")).alias("props"))
    n2 = o.select((F.col("o_orderkey") * 2 + 1).alias("id"), F.array(F.lit("Order")).alias("labels"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("props"))
    edges = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 2).alias("src"), (F.col("o_orderkey") * 2 + 1).alias("dst"), F.lit("PLACED").alias("label"), F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("props"))
    names = property_graph.NameMap
    config = property_graph.Config(EX + "node/", A.RDFS + "label", names(as_literal=True), names(parts=(names(single=("PLACED", EX + "placed")), names(EX + "edge/"))), names(EX + "property/"))
    return property_graph.member(n1.unionByName(n2), edges, config)


def _object_member(spark: SparkSession, sf_dir: str) -> Member:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return graphql.member(
        {
            "Customer": graphql.ObjectType(c, "c_custkey", ["c_name", "c_mktsegment"]),
            "Order": graphql.ObjectType(o, "o_orderkey", ["o_orderkey", "o_totalprice"], {"customer": ("o_custkey", "Customer")}),
        },
        EX + "gql/",
    )


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as a triple table, nations in a graph of their own."""
    o = lambda k, v, dt: F.struct(F.lit(k).cast("tinyint").alias("k"), v.alias("v"), F.lit(dt).alias("dt"), F.lit("").alias("lang"))
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rs = F.concat(F.lit(EX + "region/"), F.col("r_regionkey"))
    ns = F.concat(F.lit(EX + "nation/"), F.col("n_nationkey"))
    parts = [
        r.select(rs.alias("s"), F.lit(EX + "name").alias("p"), o(T.LITERAL, F.col("r_name"), T.STRING).alias("o"), F.lit(None).cast("string").alias("g")),
        n.select(ns.alias("s"), F.lit(EX + "name").alias("p"), o(T.LITERAL, F.col("n_name"), T.STRING).alias("o"), F.lit(EX + "g/nations").alias("g")),
        n.select(ns.alias("s"), F.lit(EX + "in").alias("p"), o(T.IRI, F.concat(F.lit(EX + "region/"), F.col("n_regionkey")), "").alias("o"), F.lit(EX + "g/nations").alias("g")),
        n.select(ns.alias("s"), F.lit(EX + "key").alias("p"), o(T.LITERAL, F.col("n_nationkey").cast("string"), A.XSD + "integer").alias("o"), F.lit(EX + "g/nations").alias("g")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _document_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as triples, in a graph for each language."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit(EX + "documents/"), F.col("doc_id")).alias("s"), "source", F.col("n_chars").cast("string").alias("n"), F.concat(F.lit(EX + "g/"), F.col("lang")).alias("g"))
    o = lambda c, dt: F.struct(F.lit(T.LITERAL).cast("tinyint").alias("k"), F.col(c).alias("v"), F.lit(dt).alias("dt"), F.lit("").alias("lang"))
    made = F.array(*[F.struct(F.lit(EX + p).alias("p"), o(c, dt).alias("o")) for p, c, dt in (("source", "source", T.STRING), ("n_chars", "n", A.XSD + "integer"))])
    return d.select("s", F.inline(made).alias("p", "o"), "g").filter("o.v is not null")


def _lookup_member(spark: SparkSession, sf_dir: str) -> LookUpMember:
    """Documents about nations, found by their key; one object each."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    docs = n.select(F.col("n_nationkey").cast("string").alias("nation"), F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("region"))).alias("doc"))
    maps = mapping.read_rml(
        Graph(
            read(f"""@prefix rml: <http://w3id.org/rml/> . @prefix ex: <{EX}> . @prefix xsd: <{A.XSD}> .
            ex:a rml:logicalSource [ rml:source ex:doc ; rml:iterator "$" ] ; rml:subjectMap [ rml:reference "key" ; rml:termType rml:BlankNode ] ;
              rml:predicateObjectMap [ rml:predicateMap [ rml:constant ex:docName ] ; rml:objectMap [ rml:reference "name" ] ] ,
                                     [ rml:predicateMap [ rml:constant ex:docRegion ] ; rml:objectMap [ rml:reference "region" ; rml:datatype xsd:integer ] ] .""")
        )
    )
    view = lambda rows: mapping.rml_views(maps, lambda _: (rows.df, "doc", rows.keys), "lookup")
    return LookUpMember({"nation": (A.XSD + "integer", True)}, table_fetch(docs), view)


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    f = federation(spark, sf_dir)
    f.makers |= {
        EX + "m/events-json": lambda: _rml_member(spark, sf_dir, "eventKey", "eventType", unique=True),
        EX + "m/events-map": lambda: _rml_member(spark, sf_dir, "eventProps"),
        EX + "m/chats-json": lambda: _rml_member(spark, sf_dir, "turnText"),
        EX + "m/geo-json": lambda: _rml_member(spark, sf_dir, "nationRegion", "regionName"),
        EX + "m/pg": lambda: _graph_member(spark, sf_dir),
        EX + "m/objects": lambda: _object_member(spark, sf_dir),
        EX + "m/triples": lambda: triple_member(_triples(spark, sf_dir)),
        EX + "m/triples-single": lambda: triple_member(_triples(spark, sf_dir), single=True),
        EX + "m/graphs": lambda: triple_member(_document_graphs(spark, sf_dir)),
        EX + "m/nation-docs": lambda: _lookup_member(spark, sf_dir),
    }
    return Engine(spark, f, default=(EX + "m/tpch",))


QUERIES: dict[str, tuple[str, str]] = {
    "rml_json_extract": (
        "SELECT ?kind (COUNT(?k) AS ?n) (SUM(?k) AS ?total) WHERE { SERVICE m:events-json { ?e ex:kind ?kind ; ex:k ?k } } GROUP BY ?kind",
        "SELECT event_type AS kind, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1",
    ),
    "rml_template_iri": (
        "SELECT ?e WHERE { SERVICE m:events-json { ?e ex:kind \"click\" } }",
        f"SELECT '{EX}event/' || event_id AS e FROM events WHERE event_type = 'click'",
    ),
    "rml_class": ("SELECT (COUNT(?e) AS ?n) WHERE { SERVICE m:events-json { ?e a ex:Event } }", "SELECT count(*) AS n FROM events"),
    "rml_array": (
        "SELECT ?role (COUNT(*) AS ?n) WHERE { SERVICE m:chats-json { ?t ex:role ?role } } GROUP BY ?role",
        "SELECT role, count(*) AS n FROM conversations GROUP BY 1",
    ),
    "rml_map": (
        "SELECT ?key (COUNT(*) AS ?n) WHERE { SERVICE m:events-map { ?e ex:props ?map } UNFOLD(?map AS ?key, ?value) } GROUP BY ?key",
        "SELECT 'k' AS key, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    ),
    "rml_join": (
        "SELECT ?n ?name WHERE { SERVICE m:geo-json { ?n ex:inside ?r . ?r ex:called ?name } }",
        f"SELECT '{EX}n/' || n_nationkey AS n, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "rml_union": (
        "SELECT ?p (COUNT(*) AS ?n) WHERE { SERVICE m:geo-json { ?s ?p ?o } } GROUP BY ?p",
        f"SELECT '{EX}inside' AS p, count(*) AS n FROM nation UNION ALL SELECT '{EX}called', count(*) FROM region",
    ),
    "lookup_params": (
        """SELECT ?c ?name ?region WHERE { SERVICE m:customer { ?x ex:c_custkey ?c ; ex:c_nationkey ?k ; ex:c_acctbal ?b FILTER(?b > 5000) }
             SERVICE m:nation-docs PARAMS(?k AS "nation") { ?d ex:docName ?name ; ex:docRegion ?region } }""",
        "SELECT c_custkey AS c, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000",
    ),
    "lookup_optional": (
        """SELECT ?key ?name WHERE { VALUES ?key { 1 2 77 } OPTIONAL { SERVICE m:nation-docs PARAMS(?key AS "nation") { ?d ex:docName ?name } } }""",
        "SELECT CAST(key AS BIGINT) AS key, n_name AS name FROM (VALUES (1), (2), (77)) t(key) LEFT JOIN nation ON n_nationkey = key",
    ),
    "lpg_edges": (
        "SELECT ?name ?s WHERE { SERVICE m:pg { ?c ex:placed ?o . ?c ex:property/name ?name . ?o ex:property/status ?s } }".replace("ex:property/name", f"<{EX}property/name>").replace("ex:property/status", f"<{EX}property/status>"),
        "SELECT c_name AS name, o_orderstatus AS s FROM customer JOIN orders ON c_custkey = o_custkey",
    ),
    "lpg_labels": ("SELECT ?l (COUNT(*) AS ?n) WHERE { SERVICE m:pg { ?x rdfs:label ?l } } GROUP BY ?l", "SELECT 'Customer' AS l, count(*) AS n FROM customer UNION ALL SELECT 'Order', count(*) FROM orders"),
    "lpg_edge_props": (
        f"SELECT ?p (COUNT(*) AS ?n) WHERE {{ SERVICE m:pg {{ << ?c ex:placed ?o >> <{EX}property/priority> ?p . ?c rdfs:label \"Customer\" }} }} GROUP BY ?p",
        "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1",
    ),
    "lpg_var_predicate": (
        "SELECT ?p (COUNT(*) AS ?n) WHERE { SERVICE m:pg { <http://ex.org/node/14> ?p ?o } } GROUP BY ?p",
        f"SELECT 'http://www.w3.org/2000/01/rdf-schema#label' AS p, count(*) AS n FROM customer WHERE c_custkey = 7 UNION ALL SELECT '{EX}property/name', count(*) FROM customer WHERE c_custkey = 7 UNION ALL (SELECT '{EX}placed', count(*) FROM orders WHERE o_custkey = 7 HAVING count(*) > 0)",
    ),
    "graphql_star": (
        "PREFIX q: <http://ex.org/gql/> SELECT ?k ?name WHERE { SERVICE m:objects { ?o a q:Order ; q:Order_o_orderkey ?k ; q:Order_customer ?c . ?c q:Customer_c_name ?name ; q:Customer_c_mktsegment \"BUILDING\" } }",
        "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    ),
    "triples_bgp": (
        "SELECT ?n ?r WHERE { SERVICE m:triples { ?x ex:in ?y ; ex:name ?n . ?y ex:name ?r } }",
        "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "triples_single": (
        "SELECT ?n WHERE { SERVICE m:triples-single { ?x ex:in <http://ex.org/region/2> ; ex:name ?n ; ex:key ?k FILTER(?k > 5) } }",
        "SELECT n_name AS n FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5",
    ),
    "triples_var_predicate": (
        "SELECT ?p (COUNT(*) AS ?n) WHERE { SERVICE m:triples { ?x ?p ?o } } GROUP BY ?p",
        f"SELECT '{EX}name' AS p, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT '{EX}in', count(*) FROM nation UNION ALL SELECT '{EX}key', count(*) FROM nation",
    ),
    "triples_numeric_order": (
        "SELECT ?n ?k WHERE { SERVICE m:triples { ?x ex:key ?k ; ex:name ?n } } ORDER BY DESC(?k)",
        "SELECT n_name AS n, CAST(n_nationkey AS VARCHAR) AS k FROM nation ORDER BY n_nationkey DESC",
    ),
    "named_graph": (
        "SELECT ?n WHERE { SERVICE m:triples { GRAPH <http://ex.org/g/nations> { ?x ex:name ?n } } }",
        "SELECT n_name AS n FROM nation",
    ),
    "named_graph_var": (
        "SELECT ?g (COUNT(*) AS ?n) WHERE { SERVICE m:triples { GRAPH ?g { ?x ex:name ?n } } } GROUP BY ?g",
        f"SELECT '{EX}g/nations' AS g, count(*) AS n FROM nation",
    ),
    "named_graph_many": (
        "SELECT ?g ?n ?k WHERE { SERVICE m:graphs { GRAPH ?g { ?x ex:source ?n ; ex:n_chars ?k } } }",
        f"SELECT '{EX}g/' || lang AS g, source AS n, CAST(n_chars AS VARCHAR) AS k FROM documents",
    ),
    "from_graphs": (
        f"SELECT ?x ?n FROM <{EX}g/de> FROM <{EX}g/fr> WHERE {{ SERVICE m:graphs {{ ?x ex:source ?n }} }}",
        f"SELECT '{EX}documents/' || doc_id AS x, source AS n FROM documents WHERE lang IN ('de', 'fr')",
    ),
    "from_named": (
        f"SELECT ?g (COUNT(*) AS ?n) FROM NAMED <{EX}g/de> FROM NAMED <{EX}g/en> WHERE {{ SERVICE m:graphs {{ GRAPH ?g {{ ?x ex:source ?name }} }} }} GROUP BY ?g",
        f"SELECT '{EX}g/' || lang AS g, count(*) AS n FROM documents WHERE lang IN ('de', 'en') GROUP BY 1",
    ),
}


def _runner(name: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _engine(spark, sf_dir).select(PREFIXES + text)

    run.__name__ = name
    return run


def construct_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).construct(PREFIXES + "CONSTRUCT { ?x ex:label ?n ; a ex:Area } WHERE { { ?x ex:r_name ?n } UNION { ?x ex:n_name ?n } }").select("s", "p", "o")


def ask_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _engine(spark, sf_dir).ask(PREFIXES + 'ASK { ?x ex:r_name "ASIA" }')
    return spark.range(1).select(F.lit(found).alias("answer"))


def describe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, {EX + "m/region": federation(spark, sf_dir)[EX + "m/region"]}, default=(EX + "m/region",))
    return engine.describe(PREFIXES + "DESCRIBE ?x WHERE { ?x ex:r_regionkey 2 }").select("s", "p", "o")


def rml_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triples of the mapped geography, as the dump tool writes them."""
    return mapping.triples(_rml_member(spark, sf_dir, "nationRegion", "regionName").views).select("s", "p", "o")


_OTHERS = {
    construct_triples: f"""SELECT '{EX}region/' || r_regionkey AS s, '{EX}label' AS p, r_name AS o FROM region UNION SELECT '{EX}nation/' || n_nationkey, '{EX}label', n_name FROM nation
        UNION SELECT '{EX}region/' || r_regionkey, '{A.RDF_TYPE}', '{EX}Area' FROM region UNION SELECT '{EX}nation/' || n_nationkey, '{A.RDF_TYPE}', '{EX}Area' FROM nation""",
    ask_query: "SELECT EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA') AS answer",
    describe_query: f"""SELECT '{EX}region/2' AS s, '{EX}r_name' AS p, r_name AS o FROM region WHERE r_regionkey = 2
        UNION ALL SELECT '{EX}region/2', '{EX}r_regionkey', '2' UNION ALL SELECT '{EX}region/2', '{A.RDF_TYPE}', '{EX}Region'""",
    rml_dump: f"""SELECT '{EX}n/' || n_nationkey AS s, '{EX}inside' AS p, '{EX}r/' || replace(r_name, ' ', '%20') AS o FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT '{EX}r/' || replace(r_name, ' ', '%20'), '{EX}called', r_name FROM region""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(name, text) for name, (text, _) in QUERIES.items()} | {f.__name__: f for f in _OTHERS}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()} | {f.__name__: sql for f, sql in _OTHERS.items()}
