"""URL filtering by rules and by empirical-Bayes host reputation (DataFrame operations only).

Labelled page outcomes (bad or not) are counted per host, registered domain and public suffix. Each level's rate is
shrunk to its parent's by a beta-binomial prior: the suffix to the overall rate, the domain to its suffix,
the host to its domain. The strength of each prior is estimated from the spread of the level's rates. A host
is blocked when the lower bound of its posterior bad rate is above a limit; rules come before that. A host
without labels has the posterior of n = 0: the rate of its domain, else of its suffix, else of all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, looked_up, salt_of, written


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str  # prefix of the path, with its slash

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules that are compiled into the plan; more are joined by host and path, with the same results.
COMPILED = 200
#: Labels before a country code that belong to the public suffix: fixed values.
SECOND_LEVEL = ("ac", "asso", "co", "com", "edu", "go", "gob", "gov", "gouv", "gv", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")
#: Strength of a prior, in pages, is kept in this range.
STRENGTH = (1.0, 1000.0)
#: Standard deviations below the posterior mean at which the bound is put: 95 % one-sided.
Z = 1.645
LIMIT = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def registered(host: Column, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host. User and port do not count.

    The suffix is the longest of `suffixes` (such as github.io) that the host ends with; else its last label, with
    the one before it if that is one of SECOND_LEVEL and the last a country code (co.uk). The domain has one label
    more. An address, in dots or brackets, is its own domain, and all addresses share the suffix ''.
    """
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    address = name.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$")
    ruled_ = name.rlike(rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")
    suffix = F.when(ruled_, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(ruled_, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    found = sorted(suffixes, key=lambda x: (-len(x), x))
    for s in reversed(found):
        fits = (name == s) | name.endswith("." + s)
        suffix, domain = F.when(fits, F.lit(s)).otherwise(suffix), F.when(fits, F.substring_index(name, ".", -2 - s.count("."))).otherwise(domain)
    return F.when(address, name).otherwise(domain), F.when(address, F.lit("")).otherwise(suffix)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(n, action, text) of the longest rule that fits, or null; of equally long ones, block goes first."""
    if not rules:
        return F.lit(None).cast("struct<n:int,action:string,text:string>")
    listed = F.array(*[F.struct(F.lit(len(r.text)).alias("n"), F.lit(r.action).alias("action"), F.lit(r.text).alias("text"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path")) for r in rules])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["n"].alias("n"), r["action"].alias("action"), r["text"].alias("text"))))
    return best


#: Cells that the rows of a hot host, and with them its rules, are spread over.
_RULE_CELLS = 16


def ruled(pages: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """pages (row, host, path, ...) with `rule` as matching_rule() has it. rules: a list, or a table (action, host, path).

    Lists beyond COMPILED and tables are joined: a page meets, for each suffix of its host that has rules, the
    lengths of those rules' paths, and then the one rule of that host with just that beginning of its path.
    """
    if isinstance(rules, list):
        if len(rules) <= COMPILED:
            return pages.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
        rules = pages.sparkSession.createDataFrame([(r.action, r.host, r.path) for r in rules], "action string, host string, path string")
    best = F.max(F.struct((F.char_length("host") + F.char_length("path")).alias("n"), "action", F.concat("host", "path").alias("text")))
    table = rules.groupBy(F.col("host").alias("at"), F.col("path").alias("begins")).agg(best.alias("rule"))
    cells = F.explode(F.sequence(F.lit(0), F.lit(_RULE_CELLS - 1))).alias("cell")
    lengths = table.groupBy("at").agg(F.collect_set(F.char_length("begins")).alias("lengths")).select("*", cells)
    table = table.select("*", cells)
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = pages.select("row", "host", "path", salt_of(F.col("row"), _RULE_CELLS).alias("cell")).withColumn("at", F.explode(ends))
    asked = asked.join(lengths, ["at", "cell"]).withColumn("length", F.explode("lengths")).filter(F.col("length") <= F.char_length("path"))
    asked = asked.select("row", "at", "cell", F.expr("substring(path, 1, length)").alias("begins"))
    found = asked.join(table, ["at", "begins", "cell"]).groupBy("row").agg(F.max("rule").alias("rule"))
    return pages.join(found, "row", "left")


def _shrunk(level: DataFrame, z_cols: list[str], parent: Column, name: str) -> DataFrame:
    """level (n, k, parent mean m) with the posterior mean `name` and the prior's strength."""
    rows = level.withColumn("m", parent)
    noise = F.col("n") * F.col("m") * (1 - F.col("m"))
    s = rows.agg(F.sum((F.col("k") - F.col("n") * F.col("m")) ** 2 - noise).alias("over"), F.sum(noise * (F.col("n") - 1)).alias("room")).first()
    rho = s["over"] / s["room"] if s["room"] else 0.0
    low, high = STRENGTH
    strength = min(high, max(low, 1 / rho - 1)) if rho and rho > 0 else high
    a, b = F.col("k") + strength * F.col("m"), F.col("n") - F.col("k") + strength * (1 - F.col("m"))
    return rows.select(*z_cols, "n", "k", (a / (a + b)).alias(name), (a * b / ((a + b) ** 2 * (a + b + 1))).alias(f"{name}_var"))


def host_reputation(counts: DataFrame, z: float = Z, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(host, n, k, bad_rate, bad_low) of each host of counts (host, n, k), its labelled pages and the bad ones of them.

    Hosts with n = 0 have their parents' rate; an empty host has no parent and gets no row then.
    """
    counted = counts.filter("host <> '' or n > 0")
    domain, suffix = registered(F.col("host"), suffixes)
    hosts = written(counted.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    up = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)
    # hosts are unique, but a suffix or domain can have a third of them: they are looked up from salted cells
    suffixes_ = written(_shrunk(up("suffix"), ["suffix"], F.lit(base), "suffix_rate").select("suffix", "suffix_rate"), "suffixes")
    domains = _shrunk(looked_up(up("domain", "suffix"), "suffix", "domain", suffixes_), ["domain", "suffix"], F.col("suffix_rate"), "domain_rate").select("domain", "domain_rate")
    out = _shrunk(looked_up(hosts, "domain", "host", written(domains, "domains")), ["host"], F.col("domain_rate"), "bad_rate")
    return out.select("host", "n", "k", "bad_rate", F.greatest(F.lit(0.0), F.col("bad_rate") - z * F.sqrt("bad_rate_var")).alias("bad_low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule] | DataFrame, limit: float = LIMIT, z: float = Z, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Verdict of each page (page_id, url) by the longest fitting rule, else by its host's posterior bound.

    outcomes: (page_id, bad); rules: as ruled() takes them; suffixes: as registered() does. Columns: page_id, host,
    path, rule, verdict, n_labelled, bad_rate, bad_low. A null url, or one without ://, has an empty host and
    path. Hosts without outcomes have n_labelled 0 and are judged by their domain's rate, else their suffix's,
    else that of all; an empty host without outcomes is allowed, with nulls in the last two columns. Repeated
    pages give repeated rows; a page counts as often as it is there, times as often as it is labelled; null ids
    have no labels. Equally long rules: block goes first. Empty tables give no rows; without any outcome all hosts
    have the rate 0.5. Long urls are read whole; other columns, whatever their names, are ignored.
    """
    host, path = url_parts(F.col("url"))
    parsed = written(pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id()), "urls")
    # counts meet, not rows: an id that is often there and often labelled makes one row
    labelled = outcomes.groupBy("page_id").agg(F.count("bad").alias("n"), F.sum("bad").alias("k"))
    there = parsed.groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("m")).join(labelled, "page_id", "left")
    zero = F.lit(0)
    counts = there.groupBy("host").agg(F.sum(F.coalesce(F.col("m") * F.col("n"), zero)).alias("n"), F.sum(F.coalesce(F.col("m") * F.col("k"), zero)).cast("long").alias("k"))
    known = written(host_reputation(counts, z, suffixes), "reputation")
    every = written(counts.select("host").join(known, "host", "left"), "judged")
    rows = looked_up(ruled(parsed, rules), "host", "row", every)
    verdict = F.when(F.col("rule").isNotNull(), F.col("rule.action")).when(F.col("bad_low") > limit, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("rule.text").alias("rule"), verdict.alias("verdict"), F.coalesce("n", zero).alias("n_labelled"), F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_low", 6).alias("bad_low"))
