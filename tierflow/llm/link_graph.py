"""URL filters: rules, and propagation over the link graph.

Rules allow or block hosts and paths; the longest that fits decides. Hosts of pages that no rule
fits are judged by their neighbours. Trust starts at hosts in proportion to their allowed pages
and flows along links: a personalised PageRank. Distrust starts in proportion to the blocked pages
and flows against the links, since who links to a blocked host is suspect: the same walk reversed,
so that a host gets the mean distrust of what its links lead to. That mean does not depend on how
many others link there too. A host is blocked if its distrust exceeds its trust and either reaches
that of a host half of whose pages are blocked, or has from its links alone what a host would have
all of whose links lead to such hosts.

The graph has one edge per pair of hosts with the number of links; links within a host do not
count. Partial counts combine before every shuffle, and ranks are joined to aggregated edges, so a
host that holds a third of all pages is one row there. Every few rounds the ranks are written to
the shared folder to cut the lineage. Without edges the ranks are the seeds and no round runs.

A url that is NULL or lacks `://` has empty host and path; no rule fits it and nothing links to
it, so it is allowed. NULL html holds no links. Repeated rows are pages of their own. A table
without rows gives none. Only `page_id`, `url` and `html` are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.llm.words import lower_ascii
from tierflow.operators.skew import is_small
from tierflow.session import materialize

HOST = "://([^/?#]*)"
PATH = "://[^/?#]*([^?#]*)"
LINK = r"""[Hh][Rr][Ee][Ff]\s*=\s*["']?(?:[Hh][Tt][Tt][Pp][Ss]?:)?//([^/?#"'\s>]+)"""
DAMPING = 0.7
ROUNDS = 16
ROUNDS_PER_WRITE = 4
# The share of blocked pages that makes a host without neighbours blocked, and who links to such hosts only.
BLOCKED_SHARE = 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, HOST, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    """`value` of the longest rule that fits, or NULL."""
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = (host == rule.host) | host.endswith("." + rule.host)
        chosen = chosen.when(fits & path.startswith(rule.path), F.lit(value(rule)))
    return chosen


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, links) between different hosts."""
    links = pages.select(
        host_of(F.col("url")).alias("source"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("target")
    )
    links = links.select("source", lower_ascii(F.col("target")).alias("target"))
    links = links.where("source <> target AND source <> ''")
    return links.groupBy("source", "target").agg(F.count("*").alias("links"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float, rounds: int, divided_by: str = "source") -> DataFrame:
    """Personalised PageRank: (host, rank) from (host, seed) along (source, target, links).

    Each `source` divides its rank over its links; divided by `target`, each target takes the mean instead.
    """
    out = edges.groupBy(divided_by).agg(F.sum("links").alias("all"))
    shares = edges.join(out, divided_by).select("source", "target", (F.col("links") / F.col("all")).alias("share"))
    shares = materialize(shares, "host-edges")
    start = seeds.select("host", (F.col("seed") * (1 - damping)).alias("base")).where("base > 0")
    rank = start.withColumnRenamed("base", "rank")
    for n in range(1, rounds + 1):
        moved = rank.join(shares, rank.host == shares.source)
        moved = moved.groupBy("target").agg(F.sum(F.col("rank") * F.col("share") * damping).alias("rank"))
        both = moved.select(F.col("target").alias("host"), "rank").unionByName(start.select("host", F.col("base").alias("rank")))
        rank = both.groupBy("host").agg(F.sum("rank").alias("rank"))
        if n % ROUNDS_PER_WRITE == 0:
            rank = materialize(rank, "host-ranks")
    return rank


def host_scores(
    pages: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS
) -> DataFrame:
    """(host, trust, distrust, blocked) from judged pages (host, verdict by rule or NULL)."""
    share = lambda verdict: F.count(F.when(F.col("verdict") == verdict, 1)) / F.count("*")
    hosts = pages.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    hosts = materialize(hosts, "hosts")
    edges = materialize(edges, "links")
    if edges.isEmpty():
        trust = hosts.select("host", (F.col("trust") * (1 - damping)).alias("rank"))
        distrust = hosts.select("host", (F.col("distrust") * (1 - damping)).alias("rank"))
    else:
        against = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "links")
        trust = spread(hosts.select("host", F.col("trust").alias("seed")), edges, damping, rounds)
        distrust = spread(hosts.select("host", F.col("distrust").alias("seed")), against, damping, rounds, "target")
    none = F.lit(0.0)
    own = hosts.select("host", none.alias("t"), none.alias("d"), (F.col("distrust") * (1 - damping)).alias("o"))
    parts = trust.select("host", F.col("rank").alias("t"), none.alias("d"), none.alias("o")).unionByName(
        distrust.select("host", none.alias("t"), F.col("rank").alias("d"), none.alias("o"))
    )
    scores = parts.unionByName(own).groupBy("host").agg(
        F.round(F.sum("t"), 9).alias("trust"),
        F.round(F.sum("d"), 9).alias("distrust"),
        F.round(F.sum("d") - F.sum("o"), 9).alias("linked"),
    )
    limit = BLOCKED_SHARE * (1 - damping)
    suspect = (F.col("distrust") >= round(limit, 9)) | (F.col("linked") >= round(limit * damping, 9))
    return scores.withColumn("blocked", (F.col("distrust") > F.col("trust")) & suspect)


def link_graph(pages: DataFrame, rules: Sequence[Rule] = RULES, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Per row: page_id, host, path, rule and verdict (of the rule, else of the host)."""
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    judged = judged.select(
        "page_id",
        "host",
        "path",
        longest_rule(host, path, rules, lambda r: r.text).alias("rule"),
        longest_rule(host, path, rules, lambda r: r.verdict).alias("verdict"),
    )
    scores = host_scores(judged.select("host", "verdict"), host_edges(pages), damping, rounds)
    blocked = materialize(scores.where("blocked").select(F.col("host").alias("bad")), "blocked-hosts")
    if is_small(blocked):
        blocked = F.broadcast(blocked)
    # Only hosts of pages without a rule are looked up; a frequent host is split by adaptive execution.
    out = judged.join(blocked, (judged.host == blocked.bad) & judged.rule.isNull(), "left")
    verdict = F.coalesce("verdict", F.when(F.col("bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
