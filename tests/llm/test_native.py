"""The operators made of DataFrame operations: exact dedup, mixing, URL filter, tool calls, components."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, mixing, tool_calls, url_filter
from graphloom.llm.common import ascii_lower, with_group, words_of
from graphloom.llm.components import components

DOCS = "doc_id long, text string, extra string, digest string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_ascii_lower_leaves_other_letters(spark):
    rows = [("ÄBC É",), ("ABC z",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(ascii_lower(F.col("t"))).collect()]
    assert got == ["Äbc É", "abc z", None, ""]


def test_with_group_equals_plain_aggregates(spark):
    df = spark.range(500).select((F.col("id") % 3 == 0).cast("string").alias("k"), "id")
    got = with_group(df, "k", "id", {"low": ("min", "id"), "n": ("count", "id")}, salts=7).collect()
    assert len(got) == 500
    assert {(r["k"], r["low"], r["n"]) for r in got} == {("true", 0, 167), ("false", 1, 333)}


def test_sweep_deletes_what_is_left(spark):
    from graphloom.operators import scratch

    exact_dedup.exact_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count()
    kept, gone = scratch.written(spark.range(3), "a"), scratch.written(spark.range(3), "b")
    scratch.discard(gone)
    scratch.discard(spark.range(1))
    assert kept.count() == 3 and any("graphloom-a-" in p for p in scratch._MADE) and not any("graphloom-b-" in p for p in scratch._MADE)
    scratch.sweep()
    assert not scratch._MADE and not [t for t in spark.catalog.listTables() if t.name.startswith("graphloom_index")]
    with pytest.raises(Exception):  # noqa: B017, PT011
        spark.read.parquet(kept._graphloom_path).count()


def test_exact_dedup_against_brute_force(spark):
    rows = [(i, random.Random(i % 40).choice(["Aa É", "aa É", "aa é", "", None, "x" * 5000]) if i % 7 else f"t{i}", "e", "d") for i in range(300)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == 300
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), i == max(ids))
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_index_lasts_between_batches(spark):
    index = exact_dedup.DigestIndex.temporary(spark, buckets=4)
    first = exact_dedup.digests(spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string"))
    assert {(r["doc_id"], r["kept"]) for r in index.ingest(first).collect()} == {(1, False), (2, True), (3, True)}
    second = exact_dedup.digests(spark.createDataFrame([(4, "a"), (5, "c"), (5, "c")], "doc_id long, text string"))
    got = sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in index.ingest(second).collect())
    assert got == [(4, 2, False), (5, 5, False), (5, 5, True)]  # one of the repeated rows stays
    assert index.read().count() == 3
    spark.sql(f"DROP TABLE {index.name}")  # as in a new session: the folder is still there
    again = exact_dedup.DigestIndex(spark, index.name + "_again", index.path, buckets=4)
    third = exact_dedup.digests(spark.createDataFrame([(6, "B"), (7, "d")], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in again.ingest(third).collect()) == [(6, 3, False), (7, 7, True)]
    assert again.read().count() == 4


def test_overlapping_batches_keep_nothing_twice(spark):
    index = exact_dedup.DigestIndex.temporary(spark, buckets=4)
    of = lambda *rows: exact_dedup.digests(spark.createDataFrame(list(rows), "doc_id long, text string"))
    kept = lambda df: sorted((r["doc_id"], r["kept"]) for r in df.collect())
    first = of((1, "a"), (2, "b"), (2, "B"), (None, "c"))
    assert kept(index.ingest(first, "first").filter("doc_id is not null")) == [(1, True), (2, False), (2, True)]
    assert kept(index.ingest(of((2, "b"), (1, "a"), (3, "d")))) == [(1, False), (2, False), (3, True)]
    again = index.ingest(first, "first")  # the batch of that name comes again: nothing is appended, its verdicts stay
    assert sum(r["kept"] for r in again.collect()) == 3 and index.read().count() == 4
    assert not any(r["kept"] for r in index.ingest(first).collect())


def test_the_query_plans_the_anti_join(spark, monkeypatch):
    plans = []
    unseen = exact_dedup.DigestIndex.unseen
    monkeypatch.setattr(exact_dedup.DigestIndex, "unseen", lambda self, groups: plans.append(unseen(self, groups)) or plans[-1])
    out = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string"))
    assert out.count() == 2
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange") == 1  # the groups move, the index does not


def test_buckets_follow_the_rows(spark):
    assert exact_dedup.DigestIndex.temporary(spark).buckets == exact_dedup.LEAST_BUCKETS
    index = exact_dedup.DigestIndex.temporary(spark, rows=100 * exact_dedup.BUCKET_ROWS)
    assert index.buckets == 100
    assert exact_dedup.DigestIndex(spark, index.name, index.path, rows=5).buckets == 100


CLASHING = ["_id", "_digest", "_kept", "_tag", "_hash", "_src", "_copies", "_copy", "_toxicity", "_salt", "row", "json", "key0"]


def clashing(spark, rows, upper=False):
    """Documents with columns named like those that operators make for themselves."""
    names = [n.upper() if upper else n for n in CLASHING]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in names)) for r in rows], schema)


@pytest.mark.parametrize("upper", [False, True])
def test_callers_columns_stay_as_they_are(spark, upper):
    from graphloom.llm import jaccard, toxicity

    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "A b c d e f", "t"), (3, None, None), (4, "", None), (5, "x y", "s")]
    docs = clashing(spark, rows, upper)
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for stage in (exact_dedup.keep_copies, jaccard.keep_one_each, mixing.mixed, lambda d: toxicity.keep_clean(d, labels)):
        out = stage(docs)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        got = out.collect()
        assert got and set(map(tuple, got)) <= set(map(tuple, docs.collect()))


def test_one_row_of_each_digest_stays(spark):
    rows = [(7, "aA", "s"), (7, "AA", "t"), (7, "aa", "s"), (3, "aa", "s"), (8, "b", "s")]
    got = exact_dedup.keep_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r["doc_id"] for r in got) == [7, 8]
    assert sum(r["kept"] for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()) == 2


def test_very_long_texts_are_digested_whole(spark):
    long = "Wort " * 400_000
    got = exact_dedup.exact_dedup(spark.createDataFrame([(1, long + "a"), (2, long + "b"), (3, long.upper() + "A")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["keep_id"]) for r in got} == {(1, 3), (2, 2), (3, 3)}


def test_anti_join_reads_the_index_without_a_shuffle(spark):
    index = exact_dedup.DigestIndex.temporary(spark, buckets=4)
    index.append(spark.createDataFrame([("a", 1, 1, "x")], "digest string, keep_id long, group_size long, batch string"))
    new = spark.createDataFrame([("a",), ("b",)], "digest string").repartition(4, "digest")
    plan = new.join(index.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.keep_copies(empty).columns == empty.columns
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_keep_copies(spark):
    docs = spark.createDataFrame([(1, "x", "e", "d"), (2, "X", "f", "d"), (3, None, None, None)], DOCS)
    assert sorted(r["doc_id"] for r in exact_dedup.keep_copies(docs).collect()) == [2, 3]


# ---- mixing


def targets_by_hand(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: float(1 + i % 3) for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        rate = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        new = {s for s in rest if weight[s] * rate > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * rate for s in names}
        full |= new


def mixed_docs(spark, n=600):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        source = rng.choice(["big"] * 12 + ["Ä", "a", "b", None, "tiny"]) if i > 3 else "small"
        text = None if i % 97 == 0 else " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, source))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixing_meets_targets(spark):
    rows, docs = mixed_docs(spark)
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    assert len(got) == len(rows)
    sizes, largest = {}, {}
    for i, t, s in rows:
        assert got[i]["size"] == len(words_of(t))
        sizes[s] = sizes.get(s, 0) + got[i]["size"]
        largest[s] = max(largest.get(s, 0), got[i]["size"])
    want = targets_by_hand(sizes)
    for s in sizes:
        taken = sum(got[i]["taken"] for i, _, x in rows if x == s)
        one = next(got[i] for i, _, x in rows if x == s)
        assert one["source_size"] == sizes[s] and one["target"] == pytest.approx(want[s])
        assert abs(taken - want[s]) <= largest[s] + 1e-6
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got.values())


def test_mixing_is_the_same_again_and_moves_expectations_evenly(spark):
    _, docs = mixed_docs(spark, 200)
    plan = lambda seed: {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs, seed=seed).collect()}
    assert plan(7) == plan(7) != plan(8)


def test_pivotal_rounding_keeps_expectations(spark):
    items = spark.range(64).select(F.lit("s").alias("source"), F.xxhash64("id").alias("key"), "id", F.lit(0).cast("long").alias("tag"), F.lit(0).cast("long").alias("nth"), (F.col("id") % 9 + 1).alias("size"), F.lit(0.3).alias("p"), F.lit(0).cast("long").alias("base"))
    ups = 0
    for seed in range(12):
        rows = mixing.pivotal_round(items, 64, seed=seed, fan_in=8).collect()
        assert len(rows) == 64 and {r["p"] for r in rows} <= {0.0, 1.0}
        words = sum(r["p"] * r["size"] for r in rows)
        assert abs(words - 0.3 * sum(i % 9 + 1 for i in range(64))) <= 9
        ups += sum(r["p"] for r in rows)
    assert 0.2 < ups / (64 * 12) < 0.4


def test_mixed_repeats_rows(spark):
    _, docs = mixed_docs(spark, 120)
    copies = {(r["doc_id"]): r["copies"] if r["size"] else 1 for r in mixing.mix_sources(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}


def test_mixing_takes_each_row_for_a_document(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_RUN", 8)
    rows = [(1, "a b c", "s")] * 50 + [(1, "d e", "s")] * 3 + [(None, "x", "t")] * 4 + [(2, "a b c", None), (3, "", "s"), (3, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_sources(docs).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((i or 0, len(words_of(t))) for i, t, _ in rows)
    taken = sum(r["taken"] for r in got if r["source"] == "s")
    assert abs(taken - next(r["target"] for r in got if r["source"] == "s")) <= 3
    out = mixing.mixed(docs).groupBy("doc_id", "text", "source").count().collect()
    want = {}
    for r in got:
        key = (r["doc_id"], r["tag"], r["source"])
        want[key] = want.get(key, 0) + (r["copies"] if r["size"] else 1)
    assert sorted(r["count"] for r in out) == sorted(n for n in want.values() if n)
    again = mixing.mix_sources(spark.createDataFrame(rows[::-1], docs.schema).repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_of_long_texts_and_other_kinds_of_ids(spark):
    docs = spark.createDataFrame([("x", "w " * 300_000, "s"), ("y", "w", "t")], "doc_id string, text string, source string")
    assert {(r["doc_id"], r["size"]) for r in mixing.mix_sources(docs).collect()} == {("x", 300_000), ("y", 1)}


# ---- URLs


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.org/es/1?q#f", "https://x.com", "no host", None, "ftp://u@h.co.uk:80/p?x", "a://b/c://d/e", "http://example.org/en/1", "http://fr.com/fr/x", "http://x.comm/fr/", "http://q.org?x/y"]
    host, path = url_filter.url_parts(F.col("url"))
    rules = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/")]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(host.alias("h"), path.alias("p"))
    got = df.select("h", "p", url_filter.matching_rule(F.col("h"), F.col("p"), rules)["text"].alias("r")).collect()
    assert [tuple(r) for r in got] == [
        ("a.example.org", "/es/1", "example.org/es/"), ("x.com", "", None), ("", "", None), ("", "", None), ("u@h.co.uk:80", "/p", None),
        ("b", "/c://d/e", None), ("example.org", "/en/1", "example.org/en/1"), ("fr.com", "/fr/x", "com/fr/"), ("x.comm", "/fr/", None), ("q.org", "", None),
    ]


def test_reputation_shrinks_and_blocks(spark):
    pages = [(i, f"http://bad.a.com/{i}") for i in range(60)] + [(100 + i, f"http://good.b.com/{i}") for i in range(60)] + [(200, "http://new.a.com/"), (201, None), (200, "http://new.a.com/")]
    outcomes = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(200, 1), (999, 1), (3, None)]
    got = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"), []).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(pages)
    assert by[0]["verdict"] == "block" and by[100]["verdict"] == "allow" and by[201]["verdict"] == "allow"
    assert by[0]["bad_rate"] < 1 and by[100]["bad_rate"] > 0  # shrunk to the domains
    assert by[201]["bad_rate"] is None and by[201]["n_labelled"] == 0
    assert by[200]["bad_rate"] > by[100]["bad_rate"]


def test_hosts_without_labels_have_their_parents_rate(spark):
    pages = [(i, f"http://s{i % 6}.bad.com/{i}") for i in range(120)] + [(200 + i, f"http://s{i % 6}.good.org/{i}") for i in range(120)]
    unseen = [(900, "http://new.bad.com/"), (901, "http://new.good.org/"), (902, "http://x.other.com/"), (903, "http://x.y.net/"), (904, None)]
    outcomes = [(i, 1) for i in range(120)] + [(200 + i, 0) for i in range(120)] + [(900, None)]
    out = url_filter.judge_urls(spark.createDataFrame(pages + unseen, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"), [])
    by = {r["page_id"]: r for r in out.collect()}
    assert len(by) == len(pages) + len(unseen)
    assert [by[i]["n_labelled"] for i in range(900, 905)] == [0] * 5
    assert [by[i]["verdict"] for i in range(900, 905)] == ["block", "allow", "block", "allow", "allow"]
    # by hand: overall 121 / 242; suffixes differ (strength 1), domains and hosts within them do not (strength 1000)
    com, org = (120 + 0.5) / 121, 0.5 / 121
    bad, good = (120 + 1000 * com) / 1120, 1000 * org / 1120
    for page, rate in [(900, bad), (901, good), (902, com), (903, 0.5)]:
        assert by[page]["bad_rate"] == pytest.approx(rate, abs=1e-6)
    assert by[904]["bad_rate"] is None and by[904]["bad_low"] is None
    assert by[0]["bad_low"] > by[900]["bad_low"]  # labels of its own make a host's bound tighter


def test_urls_without_rows(spark):
    out = url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int"), [])
    assert out.count() == 0


def test_registered_domains(spark):
    hosts = ["a.foo.co.uk", "foo.co.uk", "co.uk", "u@x.y.com:80", "192.168.1.1", "[::1]:8080", "localhost", "", "xco.uk", "a.b.github.io", "x.edu.au", "a.com"]
    domain, suffix = url_filter.registered(F.col("h"), ("github.io", "io"))
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(domain, suffix).collect()
    assert [tuple(r) for r in got] == [
        ("foo.co.uk", "co.uk"), ("foo.co.uk", "co.uk"), ("co.uk", "co.uk"), ("y.com", "com"), ("192.168.1.1", ""), ("[::1]", ""),
        ("localhost", "localhost"), ("", ""), ("xco.uk", "uk"), ("b.github.io", "github.io"), ("x.edu.au", "edu.au"), ("a.com", "com"),
    ]


def test_many_rules_are_joined_with_the_same_results(spark, monkeypatch):
    rng = random.Random(4)
    rules = [url_filter.Rule(rng.choice(["allow", "block"]), rng.choice(["com", "a.com", "x.a.com", "org", "b.org"]), "/" + "".join(rng.choices("ab/", k=rng.randint(0, 4)))) for _ in range(150)]
    pages = [(i, f"http://{rng.choice(['a.com', 'x.a.com', 'y.x.a.com', 'b.org', 'com', 'xcom', 'c.net'])}/{''.join(rng.choices('ab/', k=rng.randint(0, 6)))}") for i in range(400)] + [(400, None)]
    df, none = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")
    rows = lambda r: sorted(map(str, url_filter.judge_urls(df, none, r).collect()))
    compiled = rows(rules)
    monkeypatch.setattr(url_filter, "COMPILED", 3)
    assert rows(rules) == compiled
    table = spark.createDataFrame([(r.action, r.host, r.path) for r in rules], "action string, host string, path string")
    assert rows(table) == compiled
    assert len(rows(rules * 10)) == 401  # more than a thousand


def test_repeated_pages_and_labels_and_clashing_columns(spark):
    pages = [(1, "http://a.com/" + "x" * 50_000, "h", "r")] * 3 + [(None, "http://b.com/", "h", "r"), (2, "", None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, host string, rule string")
    outcomes = spark.createDataFrame([(1, 1, "x")] * 4 + [(1, None, "x"), (None, 1, "x")], "page_id long, bad int, host string")
    got = url_filter.judge_urls(df, outcomes, []).collect()
    assert sorted((r["host"], r["n_labelled"]) for r in got) == [("", 0), ("a.com", 12), ("a.com", 12), ("a.com", 12), ("b.com", 0)]


# ---- tool calls

SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", False)}, "none": {}}


def linked(spark, calls, results):
    out = tool_calls.link_calls(spark.createDataFrame(calls, tool_calls.CALL), spark.createDataFrame(results, tool_calls.RESULT), SCHEMAS)
    return out.collect()


def test_calls_link_and_order(spark):
    calls = [
        (1, 1, "x", "add", '{"b":2.5,"a":1}', []),
        (1, 2, "y", "add", '{"a":"1"}', ["x"]),
        (1, 3, "z", "none", "{}", ["y", "unknown"]),
        (1, 4, "x", "add", '{"a":3}', []),
        (2, 1, "x", "sub", "{}", None),
        (3, 1, "p", "none", "not json", ["q"]),
        (3, 2, "q", "none", "{}", ["p"]),
        (4, 1, None, "none", "{}", []),
        (4, 1, None, "none", "{}", []),
    ]
    results = [(1, 5, "x", "3.5"), (1, 6, "x", "again"), (1, 7, "w", "lost"), (2, 2, "y", "other"), (3, 3, "p", None)]
    got = {(r["conv_id"], r["turn"], r["call_id"]): r for r in linked(spark, calls, results)}
    view = {k: (r["status"], r["level"], r["valid"]) for k, r in got.items()}
    assert view == {
        (1, 1, "x"): ("linked", 0, True), (1, 2, "y"): ("unanswered", 1, False), (1, 3, "z"): ("unanswered", 2, True),
        (1, 4, "x"): ("repeated call", None, True), (1, 6, "x"): ("repeated result", None, None), (1, 7, "w"): ("orphan result", None, None),
        (2, 1, "x"): ("unanswered", 0, False), (2, 2, "y"): ("orphan result", None, None), (3, 1, "p"): ("cycle", -1, False), (3, 2, "q"): ("cycle", -1, True),
        (4, 1, None): ("unanswered", None, True),
    }
    assert got[(1, 1, "x")]["json"] == '{"arguments":{"a":1,"b":2.5},"id":"x","name":"add","result":"3.5","status":"linked","valid":true}'
    assert json.loads(got[(3, 1, "p")]["json"])["arguments"] == {"raw": "not json"}


def test_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'hi "\n'), (1, 2, "assistant", None), (1, 3, "assistant", "more"), (1, 4, None, "?"), (2, 0, "user", None)]
    got = {(r["conv_id"], r["turn"]): r for r in tool_calls.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r["status"] for k, r in got.items()} == {(1, 0): "message", (1, 1): "linked", (1, 3): "orphan result", (1, 4): "message", (2, 0): "unanswered"}
    assert json.loads(got[(1, 1)]["json"]) == {"arguments": {"length": 5, "query": 'hi "\n', "title": 'hi "'}, "id": "c1-1", "name": "answer", "result": "", "status": "linked", "valid": True}
    assert got[(1, 1)]["valid"] and not got[(2, 0)]["valid"]
    assert tool_calls.conversation_events(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_identical_rows_stay_as_repeated_events(spark):
    rows = [(1, 0, "user", "q")] * 3 + [(1, 1, "assistant", "a")] * 2 + [(1, 2, "system", "s")] * 2 + [(1, 5, "assistant", "lone")] * 2
    got = tool_calls.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["turn"], r["status"]) for r in got) == [
        (0, "linked"), (0, "repeated call"), (0, "repeated call"), (1, "repeated result"), (2, "message"), (2, "message"),
        (5, "orphan result"), (5, "repeated result"),
    ]


def levels_by_hand(deps):
    """Longest path below each call; -1 in and before a cycle."""
    known, on = {}, set()

    def level(x):
        if x in known:
            return known[x]
        if x in on:
            return -1
        on.add(x)
        below = [level(d) for d in deps[x] if d in deps]
        on.discard(x)
        out = -1 if -1 in below else max(below, default=-1) + 1
        known[x] = out
        return out

    order = {x: level(x) for x in deps}
    bad = {x for x, v in order.items() if v == -1}
    while more := {x for x in deps if x not in bad and any(d in bad for d in deps[x])}:
        bad |= more
    return {x: -1 if x in bad else order[x] for x in deps}


def test_levels_against_brute_force(spark):
    rng = random.Random(6)
    deps = {f"a{i}": [f"a{i - 1}"] for i in range(40)}  # a chain
    deps |= {f"b{i}": rng.sample([f"b{j}" for j in range(i)], min(i, rng.choice([0, 1, 1, 2]))) for i in range(40)}
    deps |= {"x": ["y"], "y": ["z"], "z": ["x"], "w": ["x"], "v": ["w", "a3"], "u": ["v"], "s": ["s"], "t": ["t", "a1"], "o": ["gone", "a39", "a39"], "p": ["o"]}
    calls = spark.createDataFrame([(1, i, k, "none", "{}", d) for i, (k, d) in enumerate(deps.items())], tool_calls.CALL)
    keyed = calls.withColumn("_key", F.concat_ws(" ", F.col("conv_id").cast("string"), "call_id"))
    got = {r["_key"][2:]: r["level"] for r in tool_calls.levels(keyed).collect()}
    assert got == levels_by_hand(deps)


def test_calls_are_hash_joined(spark):
    plans = []
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "q\nx") for i in range(8)]
    out = tool_calls.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    plans = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plans
    assert sorted((r["turn"], r["level"]) for r in out.collect() if r["level"] is not None) == [(0, 0), (2, 1), (4, 2), (6, 3)]


def test_long_and_clashing_turns(spark):
    rows = [(1, 0, "user", "q " * 200_000, "k", 1), (1, 1, "assistant", None, "k", 2)]
    got = tool_calls.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id string, level int")).collect()
    assert [r["status"] for r in got] == ["linked"] and len(json.loads(got[0]["json"])["arguments"]["query"]) == 400_000


# ---- components


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(300, 300 + i) for i in range(1, 60)] + [(5, 5)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = {r["u"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in root if top(x) != x}
