"""The registered graph queries, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.engine import Engine
from graphloom.virtual import EX, GLOBAL, federation

PREFIXES = f"""PREFIX ex: <{EX}> PREFIX m: <{EX}m/> PREFIX g: <{GLOBAL}> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
PREFIX cdt: <http://w3id.org/awslabs/neptune/SPARQL-CDTs/>
"""

#: name -> (SPARQL, SQL)
QUERIES: dict[str, tuple[str, str]] = {
    "star_join_filter": (
        """SELECT ?c_name ?price WHERE {
             SERVICE m:customer { ?c ex:c_name ?c_name ; ex:c_mktsegment "BUILDING" }
             SERVICE m:orders { ?o ex:o_customer ?c ; ex:o_totalprice ?price }
             FILTER( ?price > 100000 ) }""",
        "SELECT c_name, o_totalprice AS price FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000",
    ),
    "scan_request": ("SELECT ?name WHERE { SERVICE m:nation { ?n ex:n_name ?name } }", "SELECT n_name AS name FROM nation"),
    "scan_subject_iri": ("SELECT ?n ?name WHERE { SERVICE m:nation { ?n ex:n_name ?name } }", f"SELECT '{EX}nation/' || n_nationkey AS n, n_name AS name FROM nation"),
    "bgp_star_merge": (
        """SELECT ?name ?brand ?size WHERE { SERVICE m:part { ?p ex:p_name ?name . ?p ex:p_brand ?brand } SERVICE m:part { ?p ex:p_size ?size FILTER(?size < 10) } }""",
        "SELECT p_name AS name, p_brand AS brand, p_size AS size FROM part WHERE p_size < 10",
    ),
    "bgp_type": ("SELECT (COUNT(*) AS ?n) WHERE { SERVICE m:tpch { ?x a ex:Customer } }", "SELECT count(*) AS n FROM customer"),
    "bgp_constant_subject": ("SELECT ?name WHERE { SERVICE m:customer { <http://ex.org/customer/7> ex:c_name ?name } }", "SELECT c_name AS name FROM customer WHERE c_custkey = 7"),
    "bgp_var_predicate": (
        "SELECT ?p ?o WHERE { SERVICE m:nation { <http://ex.org/nation/3> ?p ?o } }",
        f"""SELECT '{EX}n_nationkey' AS p, CAST(n_nationkey AS VARCHAR) AS o FROM nation WHERE n_nationkey = 3
            UNION ALL SELECT '{EX}n_name', n_name FROM nation WHERE n_nationkey = 3
            UNION ALL SELECT '{EX}n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey = 3
            UNION ALL SELECT '{EX}n_region', '{EX}region/' || n_regionkey FROM nation WHERE n_nationkey = 3
            UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{EX}Nation' FROM nation WHERE n_nationkey = 3""",
    ),
    "blank_node_rows": (
        "SELECT ?flag (COUNT(?q) AS ?n) (SUM(?q) AS ?total) WHERE { SERVICE m:lineitem { ?l ex:l_returnflag ?flag ; ex:l_quantity ?q } } GROUP BY ?flag",
        "SELECT l_returnflag AS flag, count(l_quantity) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1",
    ),
    "tp_only_member": (
        "SELECT ?name ?bal WHERE { SERVICE m:supplier-single { ?s ex:s_name ?name ; ex:s_acctbal ?bal FILTER(?bal > 0) } }",
        "SELECT s_name AS name, s_acctbal AS bal FROM supplier WHERE s_acctbal > 0",
    ),
    "filter_compare": (
        "SELECT ?k ?q WHERE { SERVICE m:lineitem { ?l ex:l_orderkey ?k ; ex:l_quantity ?q ; ex:l_linenumber ?i } FILTER(?q >= 49 && ?i != 1) }",
        "SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_quantity >= 49 AND l_linenumber <> 1",
    ),
    "filter_in": (
        "SELECT ?id ?t WHERE { SERVICE m:events { ?e ex:event_id ?id ; ex:event_type ?t } FILTER(?t IN (\"click\", \"view\", \"none\")) }",
        "SELECT event_id AS id, event_type AS t FROM events WHERE event_type IN ('click', 'view', 'none')",
    ),
    "filter_not_in": (
        "SELECT ?k WHERE { SERVICE m:orders { ?o ex:o_orderkey ?k ; ex:o_orderstatus ?s } FILTER(?s NOT IN (\"F\", \"O\")) }",
        "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
    ),
    "filter_bool": (
        "SELECT ?k WHERE { SERVICE m:part { ?p ex:p_partkey ?k ; ex:p_size ?s ; ex:p_brand ?b } FILTER(!(?s > 5) || (?b = \"Brand#11\" && ?s < 40)) }",
        "SELECT p_partkey AS k FROM part WHERE NOT (p_size > 5) OR (p_brand = 'Brand#11' AND p_size < 40)",
    ),
    "filter_dates": (
        "SELECT ?k ?d WHERE { SERVICE m:orders { ?o ex:o_orderkey ?k ; ex:o_orderdate ?d } FILTER(?d >= \"1997-01-01T00:00:00\"^^xsd:dateTime && YEAR(?d) < 1998) }",
        "SELECT o_orderkey AS k, o_orderdate AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND year(o_orderdate) < 1998",
    ),
    "filter_regex": (
        "SELECT ?name WHERE { SERVICE m:customer { ?c ex:c_name ?name } FILTER(REGEX(?name, \"^customer#0+1[0-4]\", \"i\")) }",
        "SELECT c_name AS name FROM customer WHERE regexp_matches(c_name, '^customer#0+1[0-4]', 'i')",
    ),
    "filter_unbound": (
        "SELECT ?id ?q WHERE { SERVICE m:documents { ?d ex:doc_id ?id ; ex:lang \"en\" } OPTIONAL { SERVICE m:labels { ?d ex:quality ?q } } FILTER(?q < 1) }",
        "SELECT d.doc_id AS id, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'en' AND quality < 1",
    ),
    "join_one_var": (
        "SELECT ?n ?r WHERE { SERVICE m:nation { ?x ex:n_name ?n ; ex:n_region ?y } SERVICE m:region { ?y ex:r_name ?r } }",
        "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "join_two_vars": (
        "SELECT ?sn ?cn WHERE { SERVICE m:supplier { ?s ex:s_nation ?n ; ex:s_name ?sn ; ex:s_suppkey ?k } SERVICE m:customer { ?c ex:c_nation ?n ; ex:c_custkey ?k ; ex:c_name ?cn } }",
        "SELECT s_name AS sn, c_name AS cn FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey",
    ),
    "join_chain3": (
        "SELECT ?c ?n ?r WHERE { ?x ex:c_name ?c ; ex:c_nation ?y . ?y ex:n_name ?n ; ex:n_region ?z . ?z ex:r_name ?r }",
        "SELECT c_name AS c, n_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "join_cross": (
        "SELECT ?a ?b WHERE { SERVICE m:region { ?x ex:r_name ?a } SERVICE m:nation { ?y ex:n_name ?b } }",
        "SELECT r_name AS a, n_name AS b FROM region, nation",
    ),
    "join_possible_var": (
        """SELECT ?id ?q WHERE { SERVICE m:documents { ?d ex:doc_id ?id ; ex:lang "fr" } OPTIONAL { SERVICE m:labels { ?d ex:quality ?q } } VALUES ?q { 0 } }""",
        """SELECT d.doc_id AS id, CAST(0 AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'fr' AND (quality IS NULL OR quality = 0)""",
    ),
    "join_five_tables": (
        """SELECT ?r (COUNT(*) AS ?n) WHERE { ?l ex:l_order ?o ; ex:l_supplier ?s ; ex:l_quantity ?q . ?o ex:o_customer ?c . ?c ex:c_nation ?n .
             ?s ex:s_nation ?n . ?n ex:n_region ?x . ?x ex:r_name ?r FILTER(?q > 10) } GROUP BY ?r""",
        """SELECT r_name AS r, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
           JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
           WHERE l_quantity > 10 GROUP BY 1""",
    ),
    "gpadd_bind_join": (
        "SELECT ?k ?q WHERE { SERVICE m:orders { ?o ex:o_orderkey ?k ; ex:o_orderpriority \"1-URGENT\" ; ex:o_orderstatus \"F\" } SERVICE m:lineitem { ?l ex:l_order ?o ; ex:l_quantity ?q } }",
        "SELECT o_orderkey AS k, l_quantity AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'",
    ),
    "gpoptadd_bind_join": (
        "SELECT ?k ?q WHERE { SERVICE m:orders { ?o ex:o_orderkey ?k ; ex:o_orderstatus \"P\" } OPTIONAL { SERVICE m:lineitem { ?l ex:l_order ?o ; ex:l_quantity ?q } } }",
        "SELECT o_orderkey AS k, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'",
    ),
    "left_join": (
        "SELECT ?id ?t WHERE { SERVICE m:documents { ?d ex:doc_id ?id } OPTIONAL { SERVICE m:labels { ?d ex:toxic ?t } } }",
        "SELECT d.doc_id AS id, toxic AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "left_join_filter": (
        "SELECT ?k ?p WHERE { ?c ex:c_custkey ?k OPTIONAL { ?o ex:o_customer ?c ; ex:o_totalprice ?p FILTER(?p > 300000 && ?k > 20) } }",
        "SELECT c_custkey AS k, o_totalprice AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 AND c_custkey > 20",
    ),
    "multiway_left_join": (
        "SELECT ?id ?q ?t WHERE { SERVICE m:documents { ?d ex:doc_id ?id ; ex:source \"src0\" } OPTIONAL { SERVICE m:labels { ?d ex:quality ?q } } OPTIONAL { SERVICE m:labels { ?d ex:toxic ?t } } }",
        "SELECT d.doc_id AS id, l.quality AS q, l.toxic AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE source = 'src0'",
    ),
    "minus": (
        "SELECT ?id WHERE { SERVICE m:documents { ?d ex:doc_id ?id } MINUS { SERVICE m:labels { ?d ex:quality ?q } } }",
        "SELECT doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    ),
    "minus_disjoint": (
        "SELECT ?name WHERE { SERVICE m:region { ?r ex:r_name ?name } MINUS { SERVICE m:nation { ?x ex:n_name ?y } } }",
        "SELECT r_name AS name FROM region",
    ),
    "minus_possible_var": (
        """SELECT ?id ?q WHERE { SERVICE m:documents { ?d ex:doc_id ?id ; ex:lang "de" } OPTIONAL { SERVICE m:labels { ?d ex:quality ?q } } MINUS { VALUES ?q { 1 } } }""",
        "SELECT d.doc_id AS id, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'de' AND (quality IS NULL OR quality <> 1)",
    ),
    "exists": (
        "SELECT ?k WHERE { ?c ex:c_custkey ?k FILTER EXISTS { ?o ex:o_customer ?c ; ex:o_orderstatus \"P\" } }",
        "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    ),
    "not_exists": (
        "SELECT ?k WHERE { ?c ex:c_custkey ?k FILTER NOT EXISTS { ?o ex:o_customer ?c } }",
        "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    ),
    "exists_correlated": (
        "SELECT ?k WHERE { ?c ex:c_custkey ?k ; ex:c_acctbal ?b FILTER EXISTS { ?o ex:o_customer ?c ; ex:o_totalprice ?p FILTER(?p > ?b * 40) } }",
        "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)",
    ),
    "exists_in_expression": (
        "SELECT ?k ?has WHERE { ?c ex:c_custkey ?k BIND(EXISTS { ?o ex:o_customer ?c } AS ?has) }",
        "SELECT c_custkey AS k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has FROM customer",
    ),
    "union": (
        "SELECT ?name WHERE { { SERVICE m:customer { ?x ex:c_name ?name } } UNION { SERVICE m:supplier { ?x ex:s_name ?name } } }",
        "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier",
    ),
    "multiway_union": (
        "SELECT ?name WHERE { { ?x ex:c_name ?name } UNION { ?x ex:s_name ?name } UNION { ?x ex:n_name ?name } UNION { ?x ex:r_name ?name } }",
        "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region",
    ),
    "union_unlike_vars": (
        "SELECT ?r ?n WHERE { { SERVICE m:region { ?x ex:r_name ?r } } UNION { SERVICE m:nation { ?y ex:n_name ?n } } }",
        "SELECT r_name AS r, NULL AS n FROM region UNION ALL SELECT NULL, n_name FROM nation",
    ),
    "union_mixed_types": (
        "SELECT ?v WHERE { { SERVICE m:region { ?x ex:r_name ?v } } UNION { SERVICE m:nation { ?y ex:n_nationkey ?v } } UNION { SERVICE m:nation { ?y ex:n_region ?v } } }",
        f"SELECT r_name AS v FROM region UNION ALL SELECT CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT '{EX}region/' || n_regionkey FROM nation",
    ),
    "distinct": ("SELECT DISTINCT ?f ?s WHERE { ?l ex:l_returnflag ?f ; ex:l_linestatus ?s }", "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem"),
    "project_bag": ("SELECT ?f WHERE { ?l ex:l_returnflag ?f ; ex:l_tax ?t FILTER(?t = 0) }", "SELECT l_returnflag AS f FROM lineitem WHERE l_tax = 0"),
    "project_absent_var": ("SELECT ?name ?nobody WHERE { SERVICE m:region { ?r ex:r_name ?name } }", "SELECT r_name AS name, CAST(NULL AS VARCHAR) AS nobody FROM region"),
    "bind_arith": (
        "SELECT ?k ?v WHERE { ?l ex:l_orderkey ?k ; ex:l_quantity ?q ; ex:l_linenumber ?i BIND(?q * 2 + ?i - 1 AS ?v) }",
        "SELECT l_orderkey AS k, l_quantity * 2 + l_linenumber - 1 AS v FROM lineitem",
    ),
    "bind_error_unbound": (
        "SELECT ?name ?v WHERE { SERVICE m:region { ?r ex:r_name ?name } BIND(?name + 1 AS ?v) }",
        "SELECT r_name AS name, CAST(NULL AS DOUBLE) AS v FROM region",
    ),
    "bind_dependent": (
        "SELECT ?k ?a ?b WHERE { ?p ex:p_partkey ?k ; ex:p_size ?s BIND(?s + 1 AS ?a) BIND(?a * ?a AS ?b) }",
        "SELECT p_partkey AS k, CAST(p_size + 1 AS BIGINT) AS a, CAST((p_size + 1) * (p_size + 1) AS BIGINT) AS b FROM part",
    ),
    "values_inline": (
        "SELECT ?name WHERE { VALUES ?key { 1 3 9 } SERVICE m:nation { ?n ex:n_nationkey ?key ; ex:n_name ?name } }",
        "SELECT n_name AS name FROM nation WHERE n_nationkey IN (1, 3, 9)",
    ),
    "values_undef": (
        "SELECT ?name ?key WHERE { VALUES (?name ?key) { (\"NATION_1\" UNDEF) (UNDEF 2) (\"NATION_3\" 4) } SERVICE m:nation { ?n ex:n_nationkey ?key ; ex:n_name ?name } }",
        "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS key FROM nation WHERE n_nationkey IN (1, 2)",
    ),
    "values_service": (
        "SELECT ?s ?name WHERE { VALUES ?s { m:nation m:region } SERVICE ?s { ?x a ?t } BIND(STRAFTER(STR(?t), \"org/\") AS ?name) }",
        f"SELECT '{EX}m/nation' AS s, 'Nation' AS name FROM nation UNION ALL SELECT '{EX}m/region', 'Region' FROM region",
    ),
    "values_trailing": ("SELECT ?name WHERE { SERVICE m:region { ?r ex:r_name ?name ; ex:r_regionkey ?k } } VALUES ?k { 0 4 }", "SELECT r_name AS name FROM region WHERE r_regionkey IN (0, 4)"),
    "group_count": ("SELECT ?t (COUNT(*) AS ?n) WHERE { SERVICE m:events { ?e ex:event_type ?t } } GROUP BY ?t", "SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1"),
    "group_agg_all": (
        """SELECT ?f (COUNT(?q) AS ?n) (SUM(?i) AS ?lines) (MIN(?q) AS ?low) (MAX(?q) AS ?high) (FLOOR(AVG(?q) * 1000) AS ?mean) (COUNT(DISTINCT ?i) AS ?kinds)
           WHERE { ?l ex:l_returnflag ?f ; ex:l_quantity ?q ; ex:l_linenumber ?i } GROUP BY ?f""",
        """SELECT l_returnflag AS f, count(l_quantity) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, min(l_quantity) AS low, max(l_quantity) AS high,
           floor(avg(l_quantity) * 1000) AS mean, count(DISTINCT l_linenumber) AS kinds FROM lineitem GROUP BY 1""",
    ),
    "group_having": (
        "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o ex:o_customer ?x . ?x ex:c_custkey ?c } GROUP BY ?c HAVING (COUNT(?o) > 14)",
        "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 14",
    ),
    "group_expr": (
        "SELECT ?y (COUNT(*) AS ?n) (MAX(?p) AS ?top) WHERE { ?o ex:o_orderdate ?d ; ex:o_totalprice ?p } GROUP BY (YEAR(?d) AS ?y)",
        "SELECT year(o_orderdate) AS y, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1",
    ),
    "group_unbound_key": (
        "SELECT ?q (COUNT(*) AS ?n) WHERE { SERVICE m:documents { ?d ex:doc_id ?id } OPTIONAL { SERVICE m:labels { ?d ex:quality ?q } } } GROUP BY ?q",
        "SELECT quality AS q, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1",
    ),
    "group_mixed_minmax": (
        "SELECT (MIN(?v) AS ?low) (MAX(?v) AS ?high) (COUNT(DISTINCT ?v) AS ?n) WHERE { { SERVICE m:region { ?x ex:r_name ?v } } UNION { SERVICE m:nation { ?y ex:n_region ?v } } }",
        f"SELECT '{EX}region/' || (SELECT min(n_regionkey) FROM nation) AS low, (SELECT max(r_name) FROM region) AS high, (SELECT count(DISTINCT r_name) FROM region) + (SELECT count(DISTINCT n_regionkey) FROM nation) AS n",
    ),
    "count_distinct": ("SELECT (COUNT(DISTINCT ?b) AS ?n) (COUNT(DISTINCT *) AS ?rows) WHERE { ?p ex:p_brand ?b ; ex:p_size ?s }", "SELECT count(DISTINCT p_brand) AS n, (SELECT count(*) FROM part) AS rows FROM part"),
    "sum_distinct": ("SELECT (SUM(DISTINCT ?s) AS ?total) WHERE { ?p ex:p_size ?s }", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS total FROM part"),
    "group_concat": (
        "SELECT ?r (GROUP_CONCAT(?name ; SEPARATOR = \"|\") AS ?names) WHERE { ?x ex:n_name ?name ; ex:n_regionkey ?r } GROUP BY ?r",
        "SELECT n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1",
    ),
    "sample_min": ("SELECT ?s (SAMPLE(?k) AS ?k1) WHERE { ?o ex:o_orderstatus ?s ; ex:o_orderkey ?k } GROUP BY ?s", "SELECT o_orderstatus AS s, min(o_orderkey) AS k1 FROM orders GROUP BY 1"),
    "agg_no_group": ("SELECT (COUNT(*) AS ?n) (SUM(?s) AS ?total) WHERE { ?p ex:p_size ?s FILTER(?s > 1000) }", "SELECT count(*) AS n, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS total FROM part WHERE p_size > 1000"),
    "agg_error_poisons": (
        "SELECT ?l (SUM(?q) AS ?total) WHERE { SERVICE m:documents { ?d ex:lang ?l } OPTIONAL { SERVICE m:labels { ?d ex:quality ?q } } } GROUP BY ?l",
        "SELECT lang AS l, CASE WHEN count(*) = count(quality) THEN CAST(sum(quality) AS BIGINT) END AS total FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1",
    ),
    "agg_custom": (
        "SELECT ?s (FLOOR(<http://jena.apache.org/ARQ/function/aggregate#median>(DISTINCT ?p)) AS ?mid) WHERE { ?x ex:p_brand ?s ; ex:p_size ?p } GROUP BY ?s",
        "SELECT p_brand AS s, floor(median(DISTINCT p_size)) AS mid FROM part GROUP BY 1",
    ),
    "agg_spread": (
        "SELECT ?s (ROUND(1000 * <http://jena.apache.org/ARQ/function/aggregate#stdev>(DISTINCT ?p)) AS ?spread) (ROUND(1000 * <http://jena.apache.org/ARQ/function/aggregate#varp>(?p)) AS ?var) WHERE { ?x ex:p_brand ?s ; ex:p_size ?p } GROUP BY ?s",
        "SELECT p_brand AS s, round(1000 * stddev_samp(DISTINCT p_size)) AS spread, round(1000 * var_pop(p_size)) AS var FROM part GROUP BY 1",
    ),
    "sum_large": (
        "SELECT ?s (SUM(?k * 9000000000000000) AS ?total) (SUM(DISTINCT ?k * 9000000000000000) AS ?once) WHERE { ?o ex:o_orderstatus ?s ; ex:o_orderkey ?k FILTER(?k < 1000) } GROUP BY ?s",
        """SELECT o_orderstatus AS s, TRY_CAST(sum(CAST(o_orderkey AS HUGEINT) * 9000000000000000) AS BIGINT) AS total,
           TRY_CAST(sum(DISTINCT CAST(o_orderkey AS HUGEINT) * 9000000000000000) AS BIGINT) AS once FROM orders WHERE o_orderkey < 1000 GROUP BY 1""",
    ),
    "avg_large": (
        "SELECT ?s (xsd:integer(FLOOR(AVG(?k * 9000000000000000) / 1000000000000)) AS ?mean) WHERE { ?o ex:o_orderstatus ?s ; ex:o_orderkey ?k FILTER(?k < 1000) } GROUP BY ?s",
        "SELECT o_orderstatus AS s, CAST((sum(CAST(o_orderkey AS HUGEINT) * 9000000000000000) // count(*)) // 1000000000000 AS BIGINT) AS mean FROM orders WHERE o_orderkey < 1000 GROUP BY 1",
    ),
    "left_join_possible": (
        """SELECT ?id ?q ?t WHERE { { SERVICE m:documents { ?d ex:doc_id ?id } OPTIONAL { SERVICE m:labels { ?d ex:quality ?q } } }
           OPTIONAL { { SELECT ?q (COUNT(*) AS ?t) WHERE { SERVICE m:labels { ?x ex:quality ?q } } GROUP BY ?q } } }""",
        """WITH d AS (SELECT d.doc_id AS id, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), g AS (SELECT quality AS q, count(*) AS t FROM labels GROUP BY 1)
           SELECT id, g.q AS q, t FROM d JOIN g ON d.q = g.q OR d.q IS NULL""",
    ),
    "exists_possible": (
        """SELECT ?id (EXISTS { SERVICE m:labels { ?x ex:toxic ?q } } AS ?seen) WHERE { SERVICE m:documents { ?d ex:doc_id ?id } OPTIONAL { SERVICE m:labels { ?d ex:quality ?q } } }""",
        """SELECT d.doc_id AS id, quality IS NULL OR quality IN (SELECT toxic FROM labels) AS seen FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "minus_two_possible": (
        """SELECT ?id WHERE { SERVICE m:documents { ?d ex:doc_id ?id } OPTIONAL { SERVICE m:labels { ?d ex:quality ?q } } OPTIONAL { SERVICE m:labels { ?d ex:toxic ?t } }
           MINUS { { SELECT ?q ?t WHERE { SERVICE m:documents { ?e ex:n_chars ?n FILTER(?n < 500) } OPTIONAL { SERVICE m:labels { ?e ex:quality ?q } } OPTIONAL { SERVICE m:labels { ?e ex:toxic ?t FILTER(?t > 0) } } } } } }""",
        """WITH d AS (SELECT d.doc_id AS id, quality AS q, toxic AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
           r AS (SELECT DISTINCT quality AS q, CASE WHEN toxic > 0 THEN toxic END AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE n_chars < 500)
           SELECT id FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE (d.q = r.q OR d.q IS NULL OR r.q IS NULL) AND (d.t = r.t OR d.t IS NULL OR r.t IS NULL)
             AND ((d.q IS NOT NULL AND r.q IS NOT NULL) OR (d.t IS NOT NULL AND r.t IS NOT NULL)))""",
    ),
    **{
        key: (
            f"SELECT ?k ?name WHERE {{ ?o ex:o_orderkey ?k ; ex:o_totalprice ?t ; ex:o_customer ?c FILTER(?t > 250000) SERVICE m:remote-{way} {{ ?c ex:c_name ?name }} }}",
            "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000",
        )
        for key, way in (
            ("bind_values", "values"), ("bind_filter", "filter"), ("bind_union", "union"), ("bind_renamed", "rename"),
            ("index_nested_loops", "nested"), ("bind_values_or_filter", "no-values"), ("bind_back_off", "short"),
        )
    },
    "bind_optional": (
        "SELECT ?k ?b WHERE { ?o ex:o_orderkey ?k ; ex:o_totalprice ?t ; ex:o_customer ?c FILTER(?t > 250000) OPTIONAL { SERVICE m:remote { ?c ex:c_acctbal ?b FILTER(?b > 5000) } } }",
        "SELECT o_orderkey AS k, CASE WHEN c_acctbal > 5000 THEN CAST(c_acctbal AS VARCHAR) END AS b FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000",
    ),
    "service_body": (
        """SELECT ?name ?r WHERE { SERVICE m:remote { { ?c ex:c_mktsegment "BUILDING" } UNION { ?c ex:c_mktsegment "MACHINERY" } ?c ex:c_name ?name ; ex:c_acctbal ?b
           OPTIONAL { ?c ex:c_nation ?n . ?n ex:n_name ?r FILTER(STRSTARTS(?r, "U")) } FILTER(?b > 9000) } }""",
        """SELECT c_name AS name, CASE WHEN starts_with(n_name, 'U') THEN n_name END AS r FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
           WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 9000""",
    ),
    "service_filter_outside": (
        "SELECT ?name WHERE { SERVICE m:remote { ?c ex:c_name ?name ; ex:c_acctbal ?b } FILTER(?b < 0) }",
        "SELECT c_name AS name FROM customer WHERE c_acctbal < 0",
    ),
    "service_silent": (
        "SELECT ?n ?name WHERE { SERVICE m:nation { ?x ex:n_name ?n } SERVICE SILENT m:remote-failing { ?x ex:n_name ?name } }",
        "SELECT n_name AS n, CAST(NULL AS VARCHAR) AS name FROM nation",
    ),
    "tpf_pages": (
        "SELECT ?name ?n WHERE { SERVICE m:tpf { ?c ex:c_name ?name ; ex:c_nation ?n } }",
        f"SELECT c_name AS name, '{EX}nation/' || c_nationkey AS n FROM customer",
    ),
    "brtpf_bind": (
        "SELECT ?k ?name WHERE { ?o ex:o_orderkey ?k ; ex:o_totalprice ?t ; ex:o_customer ?c FILTER(?t > 250000) SERVICE m:brtpf { ?c ex:c_name ?name } }",
        "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000",
    ),
    "order_limit_offset": (
        "SELECT ?k ?p WHERE { ?o ex:o_orderkey ?k ; ex:o_totalprice ?p } ORDER BY DESC(?p) ?k LIMIT 10 OFFSET 5",
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    ),
    "topk": ("SELECT ?c ?b WHERE { ?x ex:c_custkey ?c ; ex:c_acctbal ?b } ORDER BY DESC(?b) ASC(?c) LIMIT 20", "SELECT c_custkey AS c, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20"),
    "order_unbound_first": (
        "SELECT ?id ?q WHERE { SERVICE m:documents { ?d ex:doc_id ?id } OPTIONAL { SERVICE m:labels { ?d ex:quality ?q } } } ORDER BY ?q ?id",
        "SELECT d.doc_id AS id, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality ASC NULLS FIRST, d.doc_id",
    ),
    "distinct_ordered": (
        "SELECT DISTINCT ?b ?s WHERE { ?p ex:p_brand ?b ; ex:p_size ?s } ORDER BY DESC(?s) ?b",
        "SELECT DISTINCT p_brand AS b, p_size AS s FROM part ORDER BY p_size DESC, p_brand",
    ),
    "subselect": (
        "SELECT ?name ?n WHERE { ?c ex:c_name ?name { SELECT ?c (COUNT(*) AS ?n) WHERE { ?o ex:o_customer ?c } GROUP BY ?c HAVING (COUNT(*) >= 12) } }",
        "SELECT c_name AS name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12) ON c_custkey = o_custkey",
    ),
    "subselect_limit": (
        "SELECT ?name ?k WHERE { { SELECT ?o ?k ?c WHERE { ?o ex:o_orderkey ?k ; ex:o_customer ?c } ORDER BY ?k LIMIT 5 } ?c ex:c_name ?name }",
        "SELECT c_name AS name, k FROM (SELECT o_orderkey AS k, o_custkey FROM orders ORDER BY 1 LIMIT 5) JOIN customer ON c_custkey = o_custkey",
    ),
    "fn_string": (
        """SELECT ?name (STRLEN(?name) AS ?n) (UCASE(?name) AS ?u) (LCASE(?name) AS ?l) (SUBSTR(?name, 2, 3) AS ?s) (CONCAT(?name, "-", ?brand) AS ?c)
           (STRBEFORE(?brand, "#") AS ?b) (STRAFTER(?brand, "#") AS ?a) (CONTAINS(?brand, "1") AS ?has) (STRSTARTS(?brand, "Brand") AS ?starts)
           (STRENDS(?brand, "3") AS ?ends) (REPLACE(?brand, "[0-9]", "x") AS ?r) (ENCODE_FOR_URI(?brand) AS ?e)
           WHERE { ?p ex:p_name ?name ; ex:p_brand ?brand }""",
        """SELECT p_name AS name, length(p_name) AS n, upper(p_name) AS u, lower(p_name) AS l, substr(p_name, 2, 3) AS s, p_name || '-' || p_brand AS c,
           CASE WHEN instr(p_brand, '#') > 0 THEN substr(p_brand, 1, instr(p_brand, '#') - 1) ELSE '' END AS b,
           CASE WHEN instr(p_brand, '#') > 0 THEN substr(p_brand, instr(p_brand, '#') + 1) ELSE '' END AS a, contains(p_brand, '1') AS has, starts_with(p_brand, 'Brand') AS starts,
           ends_with(p_brand, '3') AS ends, regexp_replace(p_brand, '[0-9]', 'x', 'g') AS r, replace(p_brand, '#', '%23') AS e FROM part""",
    ),
    "fn_math": (
        "SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) (-?b AS ?neg) WHERE { ?x ex:c_custkey ?k ; ex:c_acctbal ?b }",
        "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, floor(c_acctbal + 0.5) AS r, -c_acctbal AS neg FROM customer",
    ),
    "fn_date": (
        "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) WHERE { SERVICE m:events { ?e ex:event_id ?k ; ex:ts ?d } }",
        "SELECT event_id AS k, year(ts) AS y, month(ts) AS m, day(ts) AS dd, hour(ts) AS h, minute(ts) AS i FROM events",
    ),
    "fn_hash": (
        "SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { SERVICE m:nation { ?x ex:n_name ?n } }",
        "SELECT n_name AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation",
    ),
    "fn_cond": (
        "SELECT ?k (IF(?s > 25, \"big\", \"small\") AS ?c) (COALESCE(?none, ?s) AS ?v) (BOUND(?none) AS ?b) WHERE { ?p ex:p_partkey ?k ; ex:p_size ?s OPTIONAL { ?p ex:o_orderkey ?none } }",
        "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS c, p_size AS v, false AS b FROM part",
    ),
    "fn_cast": (
        "SELECT ?k (xsd:integer(?q) AS ?i) (xsd:string(?k) AS ?s) (xsd:double(?k) AS ?d) (xsd:boolean(?z) AS ?b) WHERE { ?l ex:l_orderkey ?k ; ex:l_quantity ?q ; ex:l_tax ?z }",
        "SELECT l_orderkey AS k, CAST(l_quantity AS BIGINT) AS i, CAST(l_orderkey AS VARCHAR) AS s, CAST(l_orderkey AS DOUBLE) AS d, l_tax <> 0 AS b FROM lineitem",
    ),
    "fn_terms": (
        """SELECT ?n (isIRI(?x) AS ?iri) (isLITERAL(?n) AS ?lit) (isNUMERIC(?k) AS ?num) (isBLANK(?x) AS ?blank) (STR(?x) AS ?s) (DATATYPE(?k) AS ?dt) (LANG(?n) AS ?lang) (sameTerm(?k, 3) AS ?same)
           WHERE { SERVICE m:nation { ?x ex:n_name ?n ; ex:n_nationkey ?k } }""",
        f"""SELECT n_name AS n, true AS iri, true AS lit, true AS num, false AS blank, '{EX}nation/' || n_nationkey AS s, 'http://www.w3.org/2001/XMLSchema#integer' AS dt, '' AS lang, n_nationkey = 3 AS same FROM nation""",
    ),
    "fn_iri_build": (
        "SELECT ?name ?iri WHERE { SERVICE m:region { ?r ex:r_name ?n } BIND(IRI(CONCAT(\"http://ex.org/byname/\", ENCODE_FOR_URI(?n))) AS ?iri) BIND(STRAFTER(STR(?iri), \"byname/\") AS ?name) }",
        f"SELECT replace(r_name, ' ', '%20') AS name, '{EX}byname/' || replace(r_name, ' ', '%20') AS iri FROM region",
    ),
    "unfold_list": (
        "SELECT ?id (COUNT(?x) AS ?n) (FLOOR(MAX(?x) * 1000) AS ?top) WHERE { SERVICE m:embeddings { ?e ex:vec_id ?id ; ex:embedding ?l } UNFOLD(?l AS ?x) } GROUP BY ?id",
        "SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS n, floor(CAST(list_max(embedding) AS DOUBLE) * 1000) AS top FROM embeddings",
    ),
    "unfold_list_pos": (
        "SELECT ?id ?i ?x WHERE { SERVICE m:embeddings { ?e ex:vec_id ?id ; ex:embedding ?l } UNFOLD(?l AS ?x, ?i) }",
        "SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings",
    ),
    "unfold_map": (
        "SELECT ?n ?k ?v WHERE { SERVICE m:nation { ?x ex:n_name ?n ; ex:n_nationkey ?key ; ex:n_regionkey ?r } BIND(cdt:Map(\"key\", ?key, \"region\", ?r) AS ?map) UNFOLD(?map AS ?k, ?v) }",
        "SELECT n_name AS n, 'key' AS k, n_nationkey AS v FROM nation UNION ALL SELECT n_name, 'region', n_regionkey FROM nation",
    ),
    "unfold_passthrough": (
        "SELECT ?n ?u WHERE { SERVICE m:region { ?x ex:r_name ?n } UNFOLD(?n AS ?u) }",
        "SELECT r_name AS n, CAST(NULL AS VARCHAR) AS u FROM region",
    ),
    "cdt_get_size": (
        "SELECT ?id (cdt:size(?l) AS ?n) (cdt:get(?l, 1) AS ?first) WHERE { SERVICE m:embeddings { ?e ex:vec_id ?id ; ex:embedding ?l } }",
        "SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS n, embedding[1] AS first FROM embeddings",
    ),
    "cdt_keys": (
        "SELECT ?n ?k WHERE { SERVICE m:region { ?x ex:r_name ?n } BIND(cdt:keys(cdt:Map(\"b\", 1, \"a\", 2)) AS ?keys) UNFOLD(?keys AS ?k) }",
        "SELECT r_name AS n, k FROM region, (VALUES ('a'), ('b')) t(k)",
    ),
    "vocab_l2g": (
        "SELECT ?n ?r WHERE { SERVICE m:geo-global { ?x g:partOf ?r ; g:name ?n } }",
        f"SELECT n_name AS n, CASE WHEN n_regionkey = 0 THEN '{GLOBAL}Africa' ELSE '{EX}region/' || n_regionkey END AS r FROM nation",
    ),
    "vocab_g2l": (
        "SELECT ?n WHERE { SERVICE m:geo-global { ?x g:partOf g:Africa ; g:name ?n } }",
        "SELECT n_name AS n FROM nation WHERE n_regionkey = 0",
    ),
    "vocab_subclass_union": (
        "SELECT ?x ?n WHERE { SERVICE m:geo-global { ?x a g:Place ; g:name ?n } }",
        f"SELECT '{EX}nation/' || n_nationkey AS x, n_name AS n FROM nation UNION ALL SELECT CASE WHEN r_regionkey = 0 THEN '{GLOBAL}Africa' ELSE '{EX}region/' || r_regionkey END, r_name FROM region",
    ),
    "path_seq": ("SELECT ?c ?r WHERE { ?x ex:c_name ?c ; ex:c_nation/ex:n_region/ex:r_name ?r }", "SELECT c_name AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_alt": ("SELECT ?v WHERE { ?x ex:n_name|ex:r_name ?v }", "SELECT n_name AS v FROM nation UNION ALL SELECT r_name FROM region"),
    "path_inverse": ("SELECT ?r ?n WHERE { ?x ex:r_name ?r ; ^ex:n_region/ex:n_name ?n }", "SELECT r_name AS r, n_name AS n FROM region JOIN nation ON n_regionkey = r_regionkey"),
    "path_negated": (
        "SELECT ?v WHERE { SERVICE m:region { ?x !(ex:r_regionkey|a) ?v } }",
        "SELECT r_name AS v FROM region",
    ),
    "path_optional": (
        "SELECT ?y WHERE { SERVICE m:nation { <http://ex.org/nation/4> ex:n_region? ?y } }",
        f"SELECT '{EX}nation/4' AS y UNION ALL SELECT '{EX}region/' || n_regionkey FROM nation WHERE n_nationkey = 4",
    ),
    "path_plus": (
        "SELECT ?x ?y WHERE { SERVICE m:geo { ?x (ex:n_region|^ex:n_region)+ ?y } }",
        f"""WITH RECURSIVE e AS (SELECT '{EX}nation/' || n_nationkey AS a, '{EX}region/' || n_regionkey AS b FROM nation
              UNION SELECT '{EX}region/' || n_regionkey, '{EX}nation/' || n_nationkey FROM nation),
            t(x, y) AS (SELECT a, b FROM e UNION SELECT x, b FROM t JOIN e ON y = a) SELECT x, y FROM t""",
    ),
    "path_star_constant": (
        "SELECT ?y WHERE { SERVICE m:geo { <http://ex.org/region/2> (^ex:n_region)* ?y } }",
        f"SELECT '{EX}region/2' AS y UNION ALL SELECT '{EX}nation/' || n_nationkey FROM nation WHERE n_regionkey = 2",
    ),
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, federation(spark, sf_dir), default=(f"{EX}m/tpch",))


def _runner(name: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).select(PREFIXES + text)

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from graphloom import mapped

    return {name: _runner(name, text) for name, (text, _) in QUERIES.items()} | mapped.queries()


def oracle_sql() -> dict[str, str]:
    from graphloom import mapped

    return {name: sql for name, (_, sql) in QUERIES.items()} | mapped.oracle_sql()
