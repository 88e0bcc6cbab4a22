"""URL filters from rules and link-graph propagation, with built-in functions only.

Rules judge a url by its host and path. Hosts that no rule reaches are judged by the graph
of hosts: personalised PageRank starts at hosts that a rule allows and follows the links;
distrust starts at blocked hosts and runs against them, from a host to those that link to
it. A host is blocked when its distrust exceeds its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, narrow

# Verdict, host, path of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
RESTART = 0.15
ROUNDS = 20
#: Rounds between two written results.
WRITTEN_EVERY = 5
#: Out-edges of a host that one task joins; a host with more is split.
EDGES_TOGETHER = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for others and null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does. ``rules`` is a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, own_host, own_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        rule, verdict = F.when(fits, own_host + own_path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) between different hosts, once each: links in the pages, and both ways between a host and its parent.

    ``pages`` hold host and html. Relative links stay on their host and make no edge. A
    parent is the host without its first label, if two labels remain.
    """
    linked = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))).alias("dst"))
    linked = linked.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    hosts = pages.select("host").union(linked.select("dst")).distinct().where("host <> ''")
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    chain = F.filter(chain, lambda h: h.contains("."))
    steps = hosts.where(F.size(labels) > 2).select(F.explode(F.arrays_zip(chain.alias("child"), F.slice(chain, 2, F.size(labels)).alias("parent"))).alias("x"))
    steps = steps.select(F.col("x.child").alias("src"), F.col("x.parent").alias("dst")).where("dst is not null")
    return linked.union(steps).union(steps.select("dst", "src")).where("src <> dst and src <> '' and dst <> ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, restart: float = RESTART) -> DataFrame:
    """(kind, host, rank): personalised PageRank of kind ``trust`` along and ``distrust`` against the edges.

    ``seeds`` hold kind and host. A fixed number of rounds; what flows out of a host
    without edges is lost. Hosts that nothing reaches have no row.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src")))
    degree = both.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    degree = durable(degree.withColumn("parts", F.ceil(F.col("degree") / EDGES_TOGETHER).cast("int")))
    parts = degree.select("kind", F.col("src").alias("host"), "parts")
    # an edge knows how many parts its end is split into, so a round is one join and one sum
    both = both.join(degree, ["kind", "src"]).join(parts.select("kind", F.col("host").alias("dst"), F.col("parts").alias("dst_parts")), ["kind", "dst"], "left")
    both = both.withColumn("part", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int"))
    both = durable(both.select("kind", "src", "part", "dst", F.coalesce("dst_parts", F.lit(1)).alias("dst_parts"), (F.lit(1.0) / F.col("degree")).alias("share")))
    seeds = seeds.select("kind", "host").distinct()
    amount = seeds.groupBy("kind").agg(F.count("*").alias("n"))
    seeds = seeds.join(amount, "kind").join(parts, ["kind", "host"], "left")
    seeds = durable(seeds.select("kind", "host", F.coalesce("parts", F.lit(1)).alias("parts"), (F.lit(1.0) / F.col("n")).alias("rank")))
    ranks = seeds
    for turn in range(1, rounds + 1):
        spread = ranks.select("kind", F.col("host").alias("src"), "rank", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        flow = (1 - restart) * F.col("rank") * F.col("share")
        moved = both.join(spread, ["kind", "src", "part"]).select("kind", F.col("dst").alias("host"), F.col("dst_parts").alias("parts"), flow.alias("rank"))
        back = seeds.select("kind", "host", "parts", (restart * F.col("rank")).alias("rank"))
        ranks = moved.union(back).groupBy("kind", "host", "parts").agg(F.sum("rank").alias("rank"))
        if turn % WRITTEN_EVERY == 0 or turn == rounds:
            ranks = durable(ranks)
    return ranks


def host_scores(judged: DataFrame) -> DataFrame:
    """(host, trust, distrust) from pages with host, html and the verdict of a rule (null without one)."""
    edges = durable(host_edges(judged))
    kind = F.when(F.col("verdict") == "allow", F.lit("trust")).otherwise(F.lit("distrust"))
    seeds = judged.where("verdict is not null and host <> ''").select(kind.alias("kind"), "host").distinct()
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k)
    return propagate(edges, seeds).groupBy("host").agg(of("trust"), of("distrust"))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of ``pages``.

    The longest rule that fits the url decides; else the graph: ``block`` if the host's
    distrust exceeds its trust, ``allow`` if not, which is so for hosts that nothing
    reaches and for urls that are null or have no ``://``. Null html has no links. Null
    ids and repeated rows keep their rows.
    """
    rows = narrow(pages, page_id=id_col, url=url_col, html=html_col)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = rows.select("page_id", host.alias("host"), path.alias("path"), "html").select("page_id", "host", "path", "html", rule.alias("rule"), verdict.alias("verdict"))
    scores = durable(host_scores(judged)).withColumnRenamed("host", "scored")
    found = judged.drop("html").join(scores, F.col("host") == F.col("scored"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    graph = F.when(distrust > trust, F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", graph).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
