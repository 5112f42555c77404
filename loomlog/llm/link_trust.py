"""URL filter: trust and distrust propagated over the links between hosts.

Rules judge the pages they fit. For the others, personalised PageRank starts from the
hosts whose pages rules allow and follows links (who a trusted host links to gains
trust); reversed PageRank starts from the hosts whose pages rules block and follows links
backwards (who links to a blocked host gains distrust). A host is blocked when its
distrust exceeds its trust by more than a threshold. Seeds weigh as the share of the
host's pages that rules of their kind fit, and ranks are divided by the restart share, so
that a host without any links keeps its own seed's weight.

Links are absolute addresses in href and src of a page's html, counted per pair of
hosts before they are shuffled on; what moves between rounds is one row per host. Rounds
go on until ranks change by less than ``TOLERANCE`` of the seeds' weight; as each round
passes on 1 - RESTART of what the one before changed, that takes about 85 of them.

Defined cases: a url that is null or has no ``://`` has an empty host and path and the
verdict of an unknown host, allow; null html has no links; repeated pages each get
their row and count as often; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
RESTART = 0.15
ROUNDS = 500
TOLERANCE = 1e-6
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]*)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for domain, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        made = F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
    found = found.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, restart: float = RESTART, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, weight), (src, dst, n) -> (host, rank): personalised PageRank over the restart share. Raises if it isn't done after so many rounds."""
    out_of = links.groupBy("src").agg(F.sum("n").alias("all"))
    moves = cut(links.join(out_of, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")))
    rank = seeds.select("host", F.col("weight").alias("rank"))
    mass = seeds.agg(F.sum("weight")).head()[0] or 0.0
    if not mass or moves.isEmpty():
        return rank
    for _ in range(rounds):
        came = moves.join(rank, moves.src == rank.host).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * (1 - restart)).alias("rank"), F.lit(0.0).alias("was"))
        given = seeds.select("host", F.col("weight").alias("rank"), F.lit(0.0).alias("was"))
        old = rank.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("was"))
        new = cut(came.unionByName(given).unionByName(old).groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")))
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).head()[0]
        rank = new.select("host", "rank")
        if change < tolerance * mass:
            return rank
    raise RuntimeError(f"ranks still change after {rounds} rounds")


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    hosts = cut(rows.where("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("fit.verdict") == "allow", 1.0).otherwise(0.0)).alias("good"), F.avg(F.when(F.col("fit.verdict") == "block", 1.0).otherwise(0.0)).alias("bad")))
    links = cut(host_links(pages))
    trust = propagate(hosts.where("good > 0").select("host", F.col("good").alias("weight")), links, rounds=rounds, tolerance=tolerance).withColumnRenamed("rank", "trust")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(hosts.where("bad > 0").select("host", F.col("bad").alias("weight")), back, rounds=rounds, tolerance=tolerance).withColumnRenamed("rank", "distrust")
    known = trust.join(distrust, "host", "full").select(F.col("host").alias("h"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    out = rows.join(known, rows.host == known.h, "left")
    own = F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
