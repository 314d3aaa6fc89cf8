"""URL filtering by explicit rules and empirical-Bayes host reputation.

Labelled page outcomes are counted by host, then shrunk down a tree: all pages, address suffix,
registered domain, host. At each level the prior of a child is a beta distribution around its
parent's posterior mean; its strength comes from the children's overdispersion (method of moments
for the beta-binomial), so hosts that differ by chance only are all drawn to their parents. A host is blocked
where the lower bound of its posterior bad rate, mean less ``z`` standard deviations, exceeds the limit:
``ratio`` times the rate of all labelled pages, but ``max_bad`` at most. Hosts without labels inherit their domain's.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: up to
``?``, ``#`` or the end. A null url or one without ``://`` has neither; it is judged like any host.
Suffix: the longest of ``suffixes`` (a parameter: the public suffixes that count beside the rule), else two
labels where a country code follows a usual second-level name, else the last label. Ports and user names are not
part of it; an address of digits is its own domain and has the empty suffix.
Rules fit a host and all its subdomains where the path starts with the rule's; the longest wins, of equally
long ones the later. Outcomes go to pages by ``key``, a column of both; a page without key has no label.
Repeated label rows of one key count once, as bad if any says so; null outcomes are no label.
Repeated pages are rows of their own. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuo.llm.common import checked_broadcast, materialize

#: Names under which country codes register domains (fixed values).
SECOND_LEVEL = (
    "ac", "asn", "asso", "co", "com", "edu", "firm", "gen", "go", "gob", "gouv", "gov", "gub", "id", "ind", "info",
    "lg", "ltd", "me", "mil", "muni", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "police", "res", "sch", "web",
)
#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
Z, MAX_BAD, RATIO = 1.2816, 0.5, 2.0
STRENGTH = (0.01, 0.5)  # bounds of the intraclass correlation
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_PAIRED = rf"^(?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), *_LETTERS)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def bare_host(host: Column) -> Column:
    """Without user names and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _suffix_labels(bare: Column, suffixes: tuple[str, ...]) -> Column:
    """How many labels the suffix has."""
    out = F.when(F.substring_index(bare, ".", -2).rlike(_PAIRED), 2).otherwise(1)
    for labels in sorted({s.count(".") + 1 for s in suffixes}):
        known = [s for s in suffixes if s.count(".") + 1 == labels]
        out = F.when(F.substring_index(bare, ".", -labels).isin(known), F.greatest(out, F.lit(labels))).otherwise(out)
    return out


def _last_labels(bare: Column, labels: Column) -> Column:
    parts = F.split(bare, r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - labels, F.lit(0)) + 1, labels), ".")


def suffix_of(host: Column, suffixes: tuple[str, ...] = ()) -> Column:
    bare = bare_host(host)
    return F.when(bare.rlike("^[0-9.]*$"), "").otherwise(_last_labels(bare, _suffix_labels(bare, suffixes)))


def domain_of(host: Column, suffixes: tuple[str, ...] = ()) -> Column:
    bare = bare_host(host)
    return F.when(bare.rlike("^[0-9.]*$"), bare).otherwise(_last_labels(bare, _suffix_labels(bare, suffixes) + 1))


def document_of(url: Column) -> Column:
    """The document that the path names: its last part if that is a number (.html and / may follow), else null."""
    digits = F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:\.html?)?/?$", 1)
    return F.when(digits != "", digits.cast("long"))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The (rule, verdict) of the longest rule that fits, else null. The rule list is a parameter, not data."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shrink(children: DataFrame, parents: DataFrame | None, parent: str, top: float) -> DataFrame:
    """Adds ``prior`` (the parent's mean), ``k`` (the prior's strength) and ``mean`` to (n, bad) rows."""
    if parents is None:
        joined = children.withColumn("prior", F.lit(top))
    else:
        above = parents.select(F.col("name").alias(parent), F.col("mean").alias("prior"))
        joined = children.join(above, parent)
    spread = F.col("prior") * (1 - F.col("prior"))
    found = joined.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) - spread).alias("over"),
        F.sum((F.col("n") - 1) * spread).alias("room"),
    ).first()
    rho = (found["over"] or 0.0) / found["room"] if found["room"] else STRENGTH[1]
    k = 1 / min(max(rho, STRENGTH[0]), STRENGTH[1]) - 1
    return joined.withColumn("k", F.lit(k)).withColumn("mean", (F.col("bad") + F.col("k") * F.col("prior")) / (F.col("n") + F.col("k")))


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z, key: str = "page_id", suffixes: tuple[str, ...] = (), max_bad: float = MAX_BAD, ratio: float = RATIO) -> DataFrame:
    """host, n, bad, mean, lower, blocked of every host. outcomes: the key, bad (0 or 1)."""
    hosts = pages.groupBy(host_of(F.col("url")).alias("name"), F.col(key)).agg(F.count("*").alias("rows"))
    once = outcomes.where("bad is not null").groupBy(key).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    labelled = hosts.join(once, key).select("name", F.col("rows").alias("n"), (F.col("rows") * F.col("bad")).alias("bad"))
    every = hosts.select("name", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    counts = labelled.unionByName(every).groupBy("name").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    places = {"domain": domain_of(F.col("name"), suffixes), "suffix": suffix_of(F.col("name"), suffixes)}
    counts = materialize(counts.withColumns(places), "host-counts")
    summed = lambda *by: counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumnRenamed(by[0], "name")
    total = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    top = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    above = materialize(shrink(summed("suffix"), None, "", top), "suffix-means")
    domains = shrink(summed("domain", "suffix"), checked_broadcast(above, above.count()), "suffix", top)
    domains = materialize(domains, "domain-means")
    hosts = shrink(counts, checked_broadcast(domains, domains.count()), "domain", top)
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("k") + 1))
    lower = F.col("mean") - z * deviation
    limit = min(max_bad, ratio * top)
    return hosts.select(F.col("name").alias("host"), "n", "bad", "mean", lower.alias("lower"), (lower > limit).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z, max_bad: float = MAX_BAD, key: str = "page_id", suffixes: tuple[str, ...] = (), ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict of every page and its host's n, bad, mean, lower."""
    known = materialize(reputation(pages, outcomes, z, key, suffixes, max_bad, ratio), "reputations")
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    cut = cut.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    cut = cut.join(checked_broadcast(known, known.count()), "host", "left")
    verdict = F.coalesce("found.verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return cut.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "n", "bad", "mean", "lower")
