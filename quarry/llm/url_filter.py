"""URL filters: host and path rules, and link-graph propagation for the urls that no rule fits. DataFrame functions only.

A rule (host, path, action) fits its host and all subdomains if the url's path starts with the rule's path; the longest
rule wins. Rules meet hosts by an equi-join on host suffixes, so a list of millions needs no scan of all pairs.

Hosts without a fitting rule are judged by two personalised PageRanks over the host graph of the pages' links: trust
starts at hosts in proportion to their pages that rules allow and follows links; distrust starts in proportion to pages
that rules block and follows links backwards (who links to blocked hosts is suspect). Each is divided by the PageRank that
starts alike at every host (a host without a judged page does not count itself), so both are shares from 0 to 1 for hubs
and leaves alike: the part of what flows to a host that comes from seeds. A host is blocked where distrust exceeds trust
by `threshold`. Steps are added until none adds more than TOLERANCE of what a host has.

Links are href values with a scheme and a host, or with a host alone (//host/path, of the page's own scheme). Links
without a host stay on their page's host, and a host's links to itself carry nothing: neither is an edge. Where no page
links to another host, a host's shares are those of its own pages.

Defined results: a null url or one without `://` has empty host and path, no rule, and is allowed unless rules say more;
null html has no links; repeated rows come back once each; a null page_id too; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import Scratch

DAMPING, TOLERANCE, MOST_ROUNDS, THRESHOLD = 0.85, 1e-3, 500, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: the rules for it or a domain above, longest first."""
    rules = rules.select(F.col("host").alias("suffix"), "path", "action", F.concat("host", "path").alias("rule"))
    met = hosts.select("host", F.explode(F.array_distinct(_suffixes(F.col("host")))).alias("suffix")).where("suffix <> ''").join(rules, "suffix")
    return met.groupBy("host").agg(F.sort_array(F.collect_set(F.struct((-F.length("rule")).alias("len"), "rule", "path", "action"))).alias("rules"))


def _fitting(path: Column, rules: Column) -> Column:
    return F.get(F.filter(rules, lambda r: F.startswith(path, r["path"])), F.lit(0))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts, counted per pair."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)\shref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?(//[^\"'\s>]*)"), F.lit(1))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(found).alias("to")).select("src", host_of(F.concat(F.lit(":"), "to")).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust from seeds(host, trust, distrust): shares of the PageRank along edges, and against them.

    Hosts at either end of an edge need a row in seeds.
    """
    both = edges.select(F.lit(0).alias("way"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight").unionByName(edges.select(F.lit(1).alias("way"), F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))
    total = both.groupBy("way", "a").agg(F.sum("weight").alias("total"))
    steps = scratch.keep(both.join(total, ["way", "a"]).select("way", "a", "b", (damping * F.col("weight") / F.col("total")).alias("share")))
    ways = F.array(*(F.struct(F.lit(i).alias("way"), "host", F.col(c).alias("score"), F.lit(1.0).alias("all"), F.when((F.col("trust") > 0) | (F.col("distrust") > 0), 0.0).otherwise(1.0).alias("own")) for i, c in enumerate(("trust", "distrust"))))
    now = sums = scratch.keep(seeds.select(F.explode(ways).alias("x")).select("x.*"))
    # sum over k of damping^k P^k seed: each round adds what one more step brings; written tables cut the lineage
    for k in range(MOST_ROUNDS if steps.take(1) else 0):
        now = scratch.keep(now.withColumnRenamed("host", "a").join(steps, ["way", "a"]).groupBy("way", F.col("b").alias("host")).agg(*(F.sum(F.col(c) * F.col("share")).alias(c) for c in ("score", "all"))))
        new = scratch.keep(sums.unionByName(now.withColumn("own", F.lit(0.0))).groupBy("way", "host").agg(*(F.sum(c).alias(c) for c in ("score", "all", "own"))))
        scratch.drop(sums) if k else None
        sums = new
        if not now.join(sums.select("way", "host", F.col("all").alias("so_far")), ["way", "host"]).where(F.col("all") > tolerance * F.col("so_far")).take(1):
            break
    part = F.when(F.col("all") > F.col("own"), F.col("score") / (F.col("all") - F.col("own"))).otherwise(0.0)
    return sums.groupBy("host").agg(F.sum(F.when(F.col("way") == 0, part).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("way") == 1, part).otherwise(0.0)).alias("distrust"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages(page_id, url, html)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    rules = spark.createDataFrame(rules, "host string, path string, action string") if isinstance(rules, list) else rules
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    by_host = scratch.keep(rules_of_hosts(urls.select("host").distinct(), rules))
    marked = urls.join(by_host, "host", "left").withColumn("hit", _fitting(F.col("path"), F.col("rules")))
    share = lambda action: F.sum(F.when(F.col("hit.action") == action, 1).otherwise(0)) / F.count(F.lit(1))
    edges = scratch.keep(host_edges(pages))
    own = marked.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    linked = edges.select(F.col("dst").alias("host"), F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust")).distinct()
    seeds = own.unionByName(linked).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    scores = propagate(edges, seeds, scratch)
    out = marked.join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", method).alias("verdict"), F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))
