"""URL filters: rules for hosts and paths, and trust carried along the link graph.

Hosts with allowed pages are trusted seeds, hosts with blocked pages blocked seeds, each
by its share of such pages.  Personalised PageRank carries trust along links and distrust
against them, until no host's rank is further from the fixed point than a stated share of
the mean; a host is blocked when its distrust is above the mean of all hosts and above its
trust.  Built from SQL functions only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: (host, path, verdict) of the contract's rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links with a scheme, and those that leave it to the page (``//host/..``).
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))

    def fits(r) -> Column:
        return ((host == r[0]) | host.endswith(f".{r[0]}")) & path.startswith(r[1])

    return F.coalesce(*(F.when(fits(r), F.struct(F.lit(r[0] + r[1]).alias("rule"), F.lit(r[2]).alias("verdict"))) for r in ordered))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from one host to another; links within a host say nothing."""
    whole = lambda link: F.when(link.startswith("//"), F.concat(F.lit("http:"), link)).otherwise(link)
    to = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda link: host_of(whole(link)))))
    return pages.select("host", to.alias("dst")).filter("dst != '' and host != '' and dst != host").groupBy(F.col("host").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int, damping: float, start: DataFrame | None = None) -> DataFrame:
    """So many rounds of personalised PageRank of each kind: ``seeds`` (kind, host, seed), ``edges`` (kind, src, dst, share).

    From the ranks ``start``, else from the seeds' own.  Rank that reaches a host without links ends
    there.  A hub's edges share a join key, but the join is followed by sums over other keys, so
    Spark splits its partition where it stands out (adaptive skew joins).
    """
    base = (1 - damping) * F.col("seed")
    rank = seeds.select("kind", "host", base.alias("rank")) if start is None else start
    for _ in range(rounds):
        sent = (
            rank.join(edges.withColumnRenamed("src", "host"), ["kind", "host"])
            .groupBy("kind", F.col("dst").alias("host"))
            .agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        )
        rank = seeds.join(sent, ["kind", "host"], "left").select("kind", "host", (base + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
    return rank


def settle(seeds: DataFrame, edges: DataFrame, scratch: Scratch, damping: float, tolerance: float, every: int = 8) -> DataFrame:
    """The fixed point of ``propagate``: no rank is further from it than ``tolerance`` times the mean of its kind.

    Ranks are saved after every few rounds.  A round shrinks the sum of all differences from
    the fixed point by ``damping`` at least, so the change over some rounds bounds what is
    still to come, and the number of hosts bounds the rounds that can be needed.
    """
    if not 0 <= damping < 1:
        raise ValueError("damping must be at least 0 and below 1")
    shrunk = damping**every
    rank, saved, done, needed = None, "", 0, 1
    while done < needed:
        before = seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("old")) if rank is None else rank.withColumnRenamed("rank", "old")
        rank, last, done = scratch.save(propagate(seeds, edges, every, damping, rank), f"ranks{done + every}"), saved, done + every
        change = rank.join(before, ["kind", "host"]).groupBy("kind").agg(
            F.count(F.lit(1)).alias("hosts"), F.sum("rank").alias("total"), F.sum(F.abs(F.col("rank") - F.col("old"))).alias("moved")
        ).collect()  # two rows
        if last:
            scratch.drop(last)
        saved = f"ranks{done}"
        if all(r["moved"] * shrunk / (1 - shrunk) <= tolerance * r["total"] / r["hosts"] for r in change):
            break
        needed = math.ceil(math.log(tolerance * (1 - damping) / max(r["hosts"] for r in change)) / math.log(damping))
    return rank


def host_verdicts(pages: DataFrame, scratch: Scratch, tolerance: float = 1e-9, damping: float = 0.85, least: float = 1.0) -> DataFrame:
    """(host, trust, distrust, bad) with both ranks relative to their mean over all hosts.

    ``pages``: page's host, verdict of its rule (or null) and html.
    """
    edges = scratch.save(host_edges(pages.select("host", "html")), "links")
    counted = (
        pages.filter("host != ''")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled.verdict") == "allow").alias("good"), F.count_if(F.col("ruled.verdict") == "block").alias("bad"))
    )
    known = counted.unionByName(edges.select(F.col("dst").alias("host"), *(F.lit(0).cast("long").alias(c) for c in ("n", "good", "bad"))))
    known = known.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")))
    share = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    kinds = F.inline(F.array(F.struct(F.lit("trust").alias("kind"), share("good").alias("seed")), F.struct(F.lit("distrust").alias("kind"), share("bad").alias("seed"))))
    seeds = scratch.save(known.select("host", kinds), "seeds")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    outgoing = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    shares = scratch.save(both.join(outgoing, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "shares")
    ranks = settle(seeds, shares, scratch, damping, tolerance)
    mean = F.broadcast(ranks.groupBy("kind").agg(F.avg("rank").alias("mean")))  # two rows
    relative = ranks.join(mean, "kind").withColumn("of_mean", F.when(F.col("mean") > 0, F.col("rank") / F.col("mean")).otherwise(0.0))
    pick = lambda k: F.round(F.max(F.when(F.col("kind") == k, F.col("of_mean"))), 9).alias(k)
    return scratch.save(
        relative.groupBy("host").agg(pick("trust"), pick("distrust")).withColumn("bad", (F.col("distrust") > least) & (F.col("distrust") > F.col("trust"))), "hosts"
    )


def judge(pages: DataFrame, rules=RULES, **options) -> DataFrame:
    """page_id, host, path, rule and verdict of each page.

    The longest fitting rule decides; else the host's ranks do.  Urls that are null or hold no
    ``://`` have an empty host, which no rule and no link reaches: they are allowed.  Pages without
    html link nowhere; repeated rows count as often as they stand and share a verdict; other columns
    are not read, whatever they are called; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    cut = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    cut = cut.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    hosts = host_verdicts(cut, scratch, **options).select("host", "bad")
    return cut.join(hosts, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("ruled.rule").alias("rule"),
        F.coalesce(F.col("ruled.verdict"), F.when(F.col("bad"), F.lit("block")), F.lit("allow")).alias("verdict"),
    )
