"""URL filters: rules for hosts and paths, and link-graph propagation for urls that no rule fits.

Hosts are nodes. A page's absolute links, the host names written on it, and a subdomain's tie to its crawled parent
domain are edges, counted once for each page; A-Z are folded. Trust is personalised PageRank along the edges from hosts with allowed
pages; distrust is the same along reversed edges (who links to bad hosts) from hosts with blocked pages. Both run in one
Spark iteration over the pre-aggregated host edges, with each rank table written before the next, until the ranks are
within `tolerance` of their limit and no further host is reached. A host is blocked if
its distrust is at least `threshold` of the sum of both; a host that neither reaches is allowed.

Defined results: a null url or one without :// has an empty host and path, fits no rule and is allowed; a null html has
no links; if two rules of one length fit, the one first in order counts; repeated rows are judged alike; other columns,
whatever their names, are kept out of the way; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, TOLERANCE = 0.85, 1e-4


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """A rule like "block", "example.com/en/": a host, and a path from the first / on."""
    host, slash, rest = text.partition("/")
    return Rule(verdict, host, slash + rest)


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):  # later ones go first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and pages: how many pages of one host point to another. pages has host and html."""
    html = F.translate(F.coalesce("html", F.lit("")), UPPER, LOWER)
    linked = F.regexp_extract_all(html, F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?(?:https?:)?//([^/\"'?#\s>]+)"), F.lit(1))
    written = F.regexp_extract_all(F.regexp_replace(html, "<[^>]*>", " "), F.lit(r"(?<![\w@.-])((?:[a-z0-9-]+\.)+[a-z]{2,})(?![\w-])"), F.lit(1))
    hosts = pages.select("host").where("host != ''").distinct()
    names = pages.where("host != ''").select("host", F.array_distinct(linked).alias("linked"), F.array_distinct(written).alias("written"))
    out = names.select(F.col("host").alias("src"), F.explode("linked").alias("dst"))
    named = names.select(F.col("host").alias("src"), F.explode("written").alias("dst")).where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("pages"))
    named = named.join(hosts.withColumnRenamed("host", "dst"), "dst", "left_semi")  # other names need not be hosts
    parent = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]*\.(.+)$", 1).alias("dst")).join(hosts.withColumnRenamed("host", "dst"), "dst", "left_semi").select("src", "dst")
    ties = parent.union(parent.select("dst", "src")).withColumn("pages", F.lit(1).cast("long"))
    every = out.where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("pages")).unionByName(named).unionByName(ties)
    return every.groupBy("src", "dst").agg(F.sum("pages").alias("pages"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust and distrust: ranks from seeds(host, good, bad), which are scaled to sum to 1 each.

    A round's change shrinks by the damping at least, so what all later rounds can change is known, and it ends.
    """
    total = seeds.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    start = saved(seeds.select("host", (F.col("good") / F.lit(max(float(total.good), 1.0))).alias("good"), (F.col("bad") / F.lit(max(float(total.bad), 1.0))).alias("bad")), "seeds")
    out_total = edges.groupBy("src").agg(F.sum("pages").alias("out"))
    in_total = edges.groupBy("dst").agg(F.sum("pages").alias("in"))
    forward = edges.join(out_total, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("pages") / F.col("out")).alias("good_share"), F.lit(0.0).alias("bad_share"))
    backward = edges.join(in_total, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("good_share"), (F.col("pages") / F.col("in")).alias("bad_share"))
    flow = saved(forward.union(backward), "flow")
    ranks, reached = start, None
    while True:
        sent = ranks.join(flow, "host").groupBy(F.col("to").alias("host")).agg((F.sum(F.col("good") * F.col("good_share")) * damping).alias("good_in"), (F.sum(F.col("bad") * F.col("bad_share")) * damping).alias("bad_in"))
        based = start.select("host", (F.col("good") * (1 - damping)).alias("good_base"), (F.col("bad") * (1 - damping)).alias("bad_base"))
        fresh = sent.join(based, "host", "full").select("host", (F.coalesce("good_in", F.lit(0.0)) + F.coalesce("good_base", F.lit(0.0))).alias("good"), (F.coalesce("bad_in", F.lit(0.0)) + F.coalesce("bad_base", F.lit(0.0))).alias("bad"))
        fresh = saved(fresh, "ranks")
        before = ranks.select("host", F.col("good").alias("g"), F.col("bad").alias("b"))
        change = fresh.join(before, "host", "full").agg(F.sum(F.abs(F.coalesce("good", F.lit(0.0)) - F.coalesce("g", F.lit(0.0))) + F.abs(F.coalesce("bad", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("d"), F.count_if(F.col("good") > 0).alias("good"), F.count_if(F.col("bad") > 0).alias("bad")).first()
        ranks, before_that, reached = fresh, reached, (change.good, change.bad)
        if (change.d or 0.0) * damping / (1 - damping) < tolerance and reached == before_that:
            break
    return ranks.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))


def judged(pages: DataFrame, rules: Sequence[Rule], threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust (null for hosts that neither reaches) of every page."""
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    source = source.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    name, verdict = fitting(rules, F.col("host"), F.col("path"))
    source = source.withColumn("rule", name).withColumn("ruled", verdict)
    seeds = source.where("host != ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").cast("double").alias("good"), F.count_if(F.col("ruled") == "block").cast("double").alias("bad"))
    edges = saved(host_edges(source), "edges")
    ranks = propagated(edges, seeds.where("good > 0 or bad > 0"))
    found = source.drop("html", "url").join(ranks, "host", "left")
    blocked = (F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
