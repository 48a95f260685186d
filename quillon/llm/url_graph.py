"""URL filter: path rules first, then trust and distrust spread over the host link graph.

Rules judge pages one by one.  Hosts whose pages the rules mostly allow seed a
personalised PageRank over links; hosts whose pages they mostly block seed
one against the links' direction, since who links to blocked hosts is suspect.
A page that no rule fits is blocked if its host's distrust exceeds its trust.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: (action, host, path) of the production rules; fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
#: Walks are made longer while they bring some host as much as this of a seed's weight of one.
LEAST = 1e-6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Target host of an absolute link.
LINK = r"""<[Aa]\s[^>]*?[Hh][Rr][Ee][Ff]\s*=\s*["']?\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule; null if none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("dst"))
    return links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, folder: str, name: str, damping: float = DAMPING, least: float = LEAST) -> DataFrame:
    """(host, score) of a personalised PageRank from ``seeds`` (host) along ``edges`` (src, dst, n).

    A score is the weight of all walks from the seeds to a host, a seed weighing
    one however many there are.  Each round makes the walks one link longer and
    is written out; rounds end when the longer walks bring no host as much as
    ``least``.
    """
    home, k = f"{folder}/{name}", 0
    now = common.saved(seeds.select("host", F.lit(1 - damping).alias("x")), home, "0")
    if not edges.isEmpty() and not now.isEmpty():
        out = edges.groupBy("src").agg(F.sum("n").alias("all"))
        shares = common.saved(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), folder, f"{name}-shares")
        while True:
            met = shares.join(now.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host"))
            now = common.saved(met.agg((F.sum(F.col("share") * F.col("x")) * damping).alias("x")), home, str(k + 1))
            if (now.agg(F.max("x").alias("top")).first()["top"] or 0) < least:
                break
            k += 1
    walks = edges.sparkSession.read.schema("host string, x double").parquet(*(f"{home}/{i}" for i in range(k + 1)))
    return walks.groupBy("host").agg(F.sum("x").alias("score"))


def judged(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, damping: float = DAMPING,
    least: float = LEAST,
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every row of ``pages``.

    Null urls and urls without ``://`` have an empty host and path, fit no rule
    and are allowed.  Hosts that no evidence reaches, or as much trust as
    distrust, are allowed.  Repeated rows are judged alike and count as often as
    they occur; null html has no link; an empty table gives none.
    """
    folder = common.scratch(pages.sparkSession)
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, action = ruled(F.col("host"), F.col("path"), rules)
    parts = parts.select("id", "host", "path", rule.alias("rule"), action.alias("action"))
    per = parts.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("action") == "allow", 1)).alias("good"),
        F.count(F.when(F.col("action") == "block", 1)).alias("bad"),
    )
    hosts = common.saved(per, folder, "hosts")
    edges = common.saved(host_links(pages, url_col, html_col), folder, "links")
    trust = spread(edges, hosts.where("2 * good > n"), folder, "trust", damping, least)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(back, hosts.where("2 * bad > n"), folder, "distrust", damping, least)
    scores = common.saved(
        trust.select("host", F.col("score").alias("trust")).join(distrust.select("host", F.col("score").alias("distrust")), "host", "full"),
        folder, "scores",
    )
    met = parts.join(common.small(scores), "host", "left")
    trusted, distrusted = (F.round(F.coalesce(F.col(c), F.lit(0.0)), 10) for c in ("trust", "distrust"))
    return met.select(
        "id", "host", "path", "rule",
        F.coalesce("action", F.when(distrusted > trusted, "block").otherwise("allow")).alias("verdict"),
        trusted.alias("trust"), distrusted.alias("distrust"),
    )
