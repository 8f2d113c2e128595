"""URL verdicts from rules and from trust propagated over the host graph.

The longest rule that fits a URL decides.  Where none fits, its host does:
trust starts at hosts by the share of their pages that rules allow and follows
links; distrust starts by the share that rules block and follows links
backwards, to those who link there.  Both are personalised PageRanks that are
not normalised, so that their values, and the threshold, do not depend on the
number of hosts.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallow.llm import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"
#: Share of a rank that follows links, rounds, and rounds between two written tables.
DAMPING, ROUNDS, WRITE_EVERY = 0.5, 12, 4
#: A host is blocked if distrust exceeds trust by more: by itself, if more than two fifths of its pages are blocked.
THRESHOLD = 0.4 * (1 - DAMPING)


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: a short list of (host/path, verdict)."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, from the hrefs with a host in html."""
    to = F.explode(F.regexp_extract_all(F.col("html").cast("string"), F.lit(LINK), F.lit(1)))
    links = pages.select(host_of(F.col("url").cast("string")).alias("src"), to.alias("to"))
    links = links.select("src", F.translate("to", UPPER, LOWER).alias("dst")).where("src != '' AND dst != '' AND src != dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, rank) with rank = (1 - damping) seed + damping * sum over links of rank(src) n / sum n.

    seeds is (host, seed), links (src, dst, n), one row per pair.  Hosts
    without seed that no seed reaches are missing; empty links give the seeds.
    """
    # Written: the links' exchange then serves the join alone, and a hub's links may be split over tasks.
    total = scratch.table(links.groupBy("src").agg(F.sum("n").alias("all")), "totals")
    moves = scratch.table(links.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("p")), "moves")
    start = scratch.table(seeds.select("host", ((1 - damping) * F.col("seed")).alias("rank")).where("rank > 0"), "seeds")
    rank = start
    if moves.limit(1).count():
        for k in range(rounds):
            sent = moves.join(rank.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (damping * F.col("p") * F.col("rank")).alias("rank"))
            rank = start.union(sent).groupBy("host").agg(F.sum("rank").alias("rank"))
            if (k + 1) % WRITE_EVERY == 0:
                rank = scratch.table(rank, "rank")
    return rank


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """pages (url, html, ...) with host, path, rule, verdict, trust and distrust.

    All rows and columns stay (those named like a new one are replaced).  A
    null url or one without :// has an empty host and path and is allowed, as
    is a host that no rank reaches; a null html has no links.  Repeated rows
    count as often as they occur; an empty table gives an empty one.
    """
    new = ["host", "path", "rule", "verdict", "trust", "distrust"]
    url = F.col("url").cast("string")
    out = pages.drop(*new).withColumns({"host": host_of(url), "path": path_of(url)})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "__says": says})
    share = lambda v: F.avg((F.coalesce(F.col("__says"), F.lit("")) == v).cast("double"))
    hosts = scratch.table(out.where("host != ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    links = scratch.table(host_links(pages), "links")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = propagate(hosts.select("host", F.col("allowed").alias("seed")), links).withColumnRenamed("rank", "trust")
    distrust = propagate(hosts.select("host", F.col("blocked").alias("seed")), back).withColumnRenamed("rank", "distrust")
    ranks = scratch.table(trust.join(distrust, "host", "full").select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")]), "ranks")
    out = out.join(ranks, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    method = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    out = out.withColumn("verdict", F.coalesce("__says", method))
    return out.select(*[c for c in pages.columns if c not in new], *new)
