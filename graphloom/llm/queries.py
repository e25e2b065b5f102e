"""The registered queries of the text operators, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.hmm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.toxicity import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels has no page ids of its own: its ids are taken as those of pages. Bad: low quality or toxic."""
    from graphloom.llm.url_filter import Rule, judge_urls

    rules = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return judge_urls(_table(spark, sf_dir, "pages"), outcomes, rules)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.pieces import default_model, encoding_digests

    return encoding_digests(_table(spark, sf_dir, "documents"), default_model())


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.repeats import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents")).drop("spans")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.jaccard import similar_classes

    return similar_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.tool_calls import conversation_events

    return conversation_events(_table(spark, sf_dir, "conversations"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.topk import search

    return search(_table(spark, sf_dir, "embeddings")).drop("scored")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hidden_markov, op2_toxicity, op3_url_filter, op4_sentencepiece, op5_repeats, op6_exact_dedup, op7_mix_sources, op8_jaccard_join, op9_tool_calls, op10_top_k)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SECOND = "(ac|asso|co|com|edu|go|gob|gov|gouv|gv|ltd|me|mil|ne|net|nhs|nom|or|org|plc|sch)"


def _level(name: str, rows: str, by: str) -> str:
    """Posterior means `rate` and parameters a, c of a level, from its rows (n, k, parent mean m)."""
    return f"""{name}r AS (SELECT sum((k - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * m * (1 - m) * (n - 1)), 0) AS rho FROM {rows}),
{name} AS (SELECT {by}, n, (k + w * m) / (n + w) AS rate, k + w * m AS a, n - k + w * (1 - m) AS c FROM {rows}, (SELECT CASE WHEN rho > 0 THEN least(1000, greatest(1, 1 / rho - 1)) ELSE 1000 END AS w FROM {name}r))"""


_OP3 = f"""
WITH p AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
o AS (SELECT doc_id AS page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM labels),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM u LEFT JOIN o USING (page_id) GROUP BY host HAVING host <> '' OR count(bad) > 0),
d AS (SELECT *, regexp_matches(name, '^([0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}|\\[.*\\])$') AS address, regexp_matches(name, '(^|\\.){_SECOND}\\.[a-z][a-z]$') AS ruled FROM h),
e AS (SELECT host, n, k,
    CASE WHEN address THEN name WHEN ruled THEN regexp_extract(name, '([^.]*\\.)?[^.]*\\.[^.]*$') ELSE regexp_extract(name, '([^.]*\\.)?[^.]*$') END AS domain,
    CASE WHEN address THEN '' WHEN ruled THEN regexp_extract(name, '[^.]*\\.[^.]*$') ELSE regexp_extract(name, '[^.]*$') END AS suffix FROM d),
b AS (SELECT (sum(k) + 1.0) / (sum(n) + 2) AS m FROM e),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM e, b GROUP BY suffix),
{_level("s1", "s0", "suffix")},
d0 AS (SELECT domain, x.n, x.k, rate AS m FROM (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM e GROUP BY domain, suffix) x JOIN s1 USING (suffix)),
{_level("d1", "d0", "domain")},
h0 AS (SELECT host, e.n, e.k, rate AS m FROM e JOIN d1 USING (domain)),
{_level("h1", "h0", "host")},
h5 AS (SELECT host, n, rate, greatest(0, rate - 1.645 * sqrt(a * c / ((a + c) ** 2 * (a + c + 1)))) AS low FROM h1),
r AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM u)
SELECT page_id, r.host, path, rule,
    CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
    CAST(coalesce(n, 0) AS BIGINT) AS n_labelled, round(rate, 6) AS bad_rate, round(low, 6) AS bad_low
FROM r LEFT JOIN h5 ON r.host = h5.host
"""

_OP6 = f"""
WITH t AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

_OP9 = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT *, 'c' || conv_id || '-' || turn AS call_id, position(chr(10) IN text) AS line,
        row_number() OVER (PARTITION BY conv_id, turn ORDER BY sha256('answer ' || CASE WHEN line > 0 THEN CAST(to_json({'length': length(text), 'query': text, 'title': substr(text, 1, line - 1)}) AS VARCHAR) ELSE CAST(to_json({'length': length(text), 'query': text}) AS VARCHAR) END)) AS nth
    FROM t WHERE role = 'user'),
g AS (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM c WHERE nth = 1),
l AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS INTEGER) AS level FROM g),
a AS (SELECT conv_id, turn, 'c' || conv_id || '-' || (turn - 1) AS call_id, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY sha256(text)) AS nth FROM t WHERE role = 'assistant'),
e AS (SELECT c.*, a.text AS result, level, CASE WHEN c.nth > 1 THEN 'repeated call' WHEN a.text IS NULL THEN 'unanswered' ELSE 'linked' END AS status
    FROM c LEFT JOIN a ON c.call_id = a.call_id AND c.nth = 1 AND a.nth = 1 LEFT JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn AND c.nth = 1)
SELECT conv_id, turn, call_id, level, line > 0 AS valid, status,
    '{"arguments":' || CASE WHEN line > 0 THEN CAST(to_json({'length': length(text), 'query': text, 'title': substr(text, 1, line - 1)}) AS VARCHAR) ELSE CAST(to_json({'length': length(text), 'query': text}) AS VARCHAR) END
    || ',"id":"' || call_id || '","name":"answer"' || CASE WHEN result IS NULL THEN '' ELSE ',"result":' || CAST(to_json(result) AS VARCHAR) END || ',"status":"' || status || '","valid":' || CASE WHEN line > 0 THEN 'true' ELSE 'false' END || '}' AS json
FROM e
UNION ALL SELECT conv_id, turn, call_id, NULL, NULL, s, '{"id":"' || call_id || '","result":' || CAST(to_json(text) AS VARCHAR) || ',"status":"' || s || '"}'
FROM (SELECT *, CASE WHEN nth > 1 THEN 'repeated result' ELSE 'orphan result' END AS s FROM a) x WHERE nth > 1 OR NOT EXISTS (SELECT 1 FROM c WHERE c.call_id = x.call_id)
UNION ALL SELECT conv_id, turn, NULL, NULL, NULL, 'message', CASE WHEN role IS NULL THEN CAST(to_json({'content': text}) AS VARCHAR) ELSE CAST(to_json({'content': text, 'role': role}) AS VARCHAR) END
FROM t WHERE coalesce(role, '') NOT IN ('user', 'assistant')
"""

_OP10 = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score FROM (SELECT DISTINCT * FROM x WHERE vec_id % 50 = 0) q JOIN x v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": _OP3, "op6_exact_dedup": _OP6, "op9_tool_calls": _OP9, "op10_top_k": _OP10}
