"""URL filter: host and path rules, and trust that spreads over the links between hosts."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwake.llm.common import Stages, small

#: Rules as (domain and path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Share of its pages with which a host becomes a seed.
SEED_SHARE = 0.5
#: Share of rank that follows links; the rest returns to the seeds.
DAMPING = 0.85
#: Rounds at most, and the largest change of a score at which they end.
ROUNDS, TOLERANCE = 50, 1e-6
#: A host is blocked if distrust is this share of trust and distrust ...
DISTRUST_SHARE = 0.5
#: ... and this part of the average rank of a host.
LEAST_RANK = 0.2

_LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_rules(hosts: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """host and fits: the rules of its domain and all parent domains.

    ``rules``: domain, rule_path, rule, rule_verdict. Every suffix of a host meets the rules in an equi-join.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffix = hosts.select("host", F.explode(suffixes).alias("domain"))
    fits = suffix.join(small(rules, n_rules), "domain")
    ranked = F.struct(F.length("rule").alias("length"), (F.col("rule_verdict") == "block").alias("blocks"), "rule", "rule_path", "rule_verdict")
    return fits.groupBy("host").agg(F.collect_set(ranked).alias("fits"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Links from host to another host (src, dst, links), from absolute and protocol-relative references."""
    host, _ = host_and_path(F.col("url"))
    found = pages.select(host.alias("src"), F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)).alias("found"))
    links = found.select("src", F.explode("found").alias("dst")).select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> '' AND src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagated(edges: DataFrame, seeds: DataFrame, stages: Stages) -> DataFrame:
    """Personalised PageRank: host, trust (from trusted seeds along links), distrust (from blocked seeds against them).

    ``seeds``: host, kind ('trust' or 'distrust'). Both run in one table of (kind, host).
    A round is one equi-join and one aggregation; ranks are stored every round, and what
    hosts without links hold goes back to the seeds.
    """
    along = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links")
    against = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "links")
    both = along.unionByName(against)
    degree = both.groupBy("kind", "host").agg(F.sum("links").alias("out"))
    moves = stages.keep(both.join(degree, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("out")).alias("part")))
    number = seeds.groupBy("kind").agg(F.count("*").alias("n"))
    start = stages.keep(seeds.join(F.broadcast(number), "kind").select("kind", "host", (1 / F.col("n")).alias("seed")))
    rank = stages.keep(start.select("kind", "host", F.col("seed").alias("rank")))
    for _ in range(ROUNDS):
        flow = rank.join(moves, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg((DAMPING * F.sum(F.col("rank") * F.col("part"))).alias("rank"))
        moved = flow.groupBy("kind").agg(F.sum("rank").alias("moved"))
        home = start.join(F.broadcast(moved), "kind", "left").select(
            "kind", "host", (F.col("seed") * (1 - F.coalesce("moved", F.lit(0.0)))).alias("rank")
        )
        after = stages.keep(flow.unionByName(home).groupBy("kind", "host").agg(F.sum("rank").alias("rank")))
        old = rank.withColumnRenamed("rank", "old")
        change = after.join(old, ["kind", "host"], "full").agg(F.max(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        stages.drop(rank)
        rank = after
        if change is None or change < TOLERANCE:
            break
    kinds = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")]
    return rank.groupBy("host").agg(*kinds)


def judged_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Verdict on every page: by the longest fitting rule, else by the trust of its host.

    One row per row of ``pages``: page_id, host, path, rule, verdict ('allow' or 'block'),
    trust, distrust. A rule is a domain and a path; it fits the domain and all below it if
    the page's path starts with the rule's. Of rules of one length a blocking one wins.

    A host more than half of whose pages a rule allows is a trusted seed, one with more
    than half blocked a distrusted seed. A page without a rule is blocked if its host's
    distrust is at least its trust and a fifth of an average host's rank, else allowed.

    A URL that is null or has no ``://`` has an empty host and path, fits no rule and is
    allowed. Null html has no links. Repeated pages are judged alike and count as often as
    they come. An empty table gives no rows. Other columns are ignored.
    """
    stages = Stages(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    located = pages.select("page_id", host.alias("host"), path.alias("path"))
    table = pages.sparkSession.createDataFrame(
        [(r.split("/", 1)[0], "/" + r.split("/", 1)[1], r, v) for r, v in rules], "domain string, rule_path string, rule string, rule_verdict string"
    )
    hosts = located.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"))
    fits = stages.keep(hosts.join(host_rules(hosts, table, len(rules)), "host", "left"))
    n_hosts = fits.count()

    def with_rule(extra: DataFrame) -> DataFrame:
        joined = located.join(small(extra, n_hosts), "host", "left")
        best = F.array_max(F.filter("fits", lambda r: F.startswith(F.col("path"), r["rule_path"])))
        return joined.withColumn("best", best)

    ruled = with_rule(fits).where("best IS NOT NULL").groupBy("host").agg(
        F.count_if(F.col("best.rule_verdict") == "allow").alias("allowed"), F.count_if(F.col("best.rule_verdict") == "block").alias("blocked")
    )
    share = fits.join(ruled, "host").select(
        "host",
        F.when(F.col("allowed") > SEED_SHARE * F.col("pages"), "trust").when(F.col("blocked") > SEED_SHARE * F.col("pages"), "distrust").alias("kind"),
    )
    ranks = propagated(stages.keep(host_edges(pages)), stages.keep(share.where("kind IS NOT NULL")), stages)
    scored = stages.keep(fits.join(ranks, "host", "left"))
    bad = (F.col("distrust") >= DISTRUST_SHARE * (F.col("trust") + F.col("distrust"))) & (F.col("distrust") * n_hosts >= LEAST_RANK)
    by_method = F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow")
    zero = F.lit(0.0)
    return with_rule(scored).select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", by_method).alias("verdict"),
        F.coalesce("trust", zero).alias("trust"),
        F.coalesce("distrust", zero).alias("distrust"),
    )
