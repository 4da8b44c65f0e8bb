"""URL filters: prefix rules, and link-graph propagation for the urls no rule fits.

A rule has an action, a host and a path prefix; it fits that host and its subdomains. The longest
fitting rule decides. For all other urls the host decides: hosts with more allowed than blocked
pages are trusted seeds, hosts with more blocked than allowed pages are blocked seeds. Personalised
PageRank spreads trust from the trusted seeds along host edges and distrust from the blocked seeds
against them. A host is blocked when its share of distrust, distrust / (trust + distrust), exceeds
`max_distrust`; hosts that neither reaches are allowed.

Host edges come from absolute and protocol-relative links in the pages' html: a page counts once for
each host it links to, and links within a host are no edges. Mass of hosts without outgoing (for
distrust: incoming) edges returns to the seeds.

Defined results: a null url or one without `://` has an empty host and path, fits no rule, and is
allowed; null html has no links, html of any length is read whole; repeated rows each count; a host
with as many allowed as blocked pages is no seed; equal trust and distrust allow; rules that tie in
length go to the one that sorts last in the list; more than `MAX_RULES` rules are refused; extra
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import at_most, materialize

#: Fixed by the result contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.85
TOLERANCE = 1e-9
MAX_DISTRUST = 0.5
#: Rules become one expression in the plan; a list beyond this is refused.
MAX_RULES = 200

#: Hosts up to this number are broadcast to the pages; more of them are joined by shuffle.
BROADCAST_HOSTS = 200_000

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>/?#]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, action) of the longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, pages of src that link to dst."""
    links = F.array_distinct(
        F.transform(
            F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_LINK), 1),
            lambda x: F.translate(F.regexp_replace(x, "(?i)^(https?:)?//", ""), _UPPER, _LOWER),
        )
    )
    return (
        pages.select(host_of(F.col(url)).alias("src"), F.explode(links).alias("dst"))
        .where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of several kinds at once, until none changes by `tolerance` or more.

    seeds: kind, host, seed (masses of a kind are 1 together). edges: kind, src, dst, weight. Returns
    kind, host, rank. A step is one checkpointed table and one small aggregate, of which two numbers
    for each kind reach the driver: the mass on hosts without outgoing edges, and the change. As steps
    change by at most `damping` times as much as the last one, the number of steps is bounded.
    """
    totals = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    shares = materialize(edges.join(totals, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("total")).alias("share")))
    ends = shares.select("kind", "host").distinct().withColumn("out", F.lit(True))
    seeds = materialize(seeds.select("kind", "host", "seed"))
    ranks = materialize(seeds.join(ends, ["kind", "host"], "left").select("kind", "host", F.col("seed").alias("rank"), F.coalesce("out", F.lit(False)).alias("out")))
    measure = [F.sum(F.when(~F.col("out"), F.col("rank")).otherwise(0.0)).alias("loose"), F.sum(F.abs(F.col("rank") - F.col("was"))).alias("change")]
    numbers = {r["kind"]: r for r in ranks.withColumn("was", F.lit(0.0)).groupBy("kind").agg(*measure).collect()}  # a row for each kind
    if not numbers:
        return ranks.select("kind", "host", "rank")
    for _ in range(2 + math.ceil(math.log(tolerance / 2) / math.log(damping))):
        loose = F.create_map(*[F.lit(x) for kind, r in numbers.items() for x in (kind, r["loose"])])
        parts = ranks.join(shares, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.lit(damping) * F.col("rank") * F.col("share")).alias("rank"), F.lit(0.0).alias("was"))
        own = seeds.select("kind", "host", (((1 - damping) + damping * loose[F.col("kind")]) * F.col("seed")).alias("rank"), F.lit(0.0).alias("was"))
        before = ranks.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("was"))
        step = parts.unionByName(own).unionByName(before).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was"))
        ranks = materialize(step.join(ends, ["kind", "host"], "left").withColumn("out", F.coalesce("out", F.lit(False))))
        numbers = {r["kind"]: r for r in ranks.groupBy("kind").agg(*measure).collect()}
        if all(r["change"] < tolerance for r in numbers.values()):
            return ranks.select("kind", "host", "rank")
    raise RuntimeError("ranks did not settle")


def host_scores(pages: DataFrame, rules=RULES, max_distrust: float = MAX_DISTRUST) -> DataFrame:
    """host, trust, distrust, host_verdict of every host that a page or a seed's link graph has."""
    judged = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.where(F.col("host") != "").select("host", fitting_rule(F.col("host"), F.col("path"), rules)["action"].alias("action"))
    counts = judged.groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("allowed"), F.count_if(F.col("action") == "block").alias("blocked"))
    hosts = materialize(counts.withColumn("kind", F.when(F.col("allowed") > F.col("blocked"), "trust").when(F.col("blocked") > F.col("allowed"), "distrust")))
    seeds = hosts.where("kind IS NOT NULL")
    number = {r["kind"]: r["count"] for r in seeds.groupBy("kind").count().collect()}
    edges = materialize(host_edges(pages))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    mass = F.when(F.col("kind") == "trust", 1.0 / number.get("trust", 1)).otherwise(1.0 / number.get("distrust", 1))
    ranks = propagate(seeds.select("kind", "host", mass.alias("seed")), both)
    ranked = ranks.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    scores = hosts.select("host").join(ranked, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = F.col("distrust") > max_distrust * (F.col("trust") + F.col("distrust"))
    return scores.withColumn("host_verdict", F.when(bad, "block").otherwise("allow"))


def judge_urls(pages: DataFrame, rules=RULES, max_distrust: float = MAX_DISTRUST) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    pages = pages.select("page_id", "url", "html")
    scores = host_scores(pages, rules, max_distrust).select(F.col("host").alias("__host"), "host_verdict")
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("__fit", fitting_rule(F.col("host"), F.col("path"), rules))
    scores = materialize(scores)
    if at_most(scores, BROADCAST_HOSTS):
        scores = F.broadcast(scores)  # pages of a hot host then stay where they are
    return own.join(scores, F.col("host") == F.col("__host"), "left").select(
        "page_id", "host", "path", F.col("__fit")["rule"].alias("rule"),
        F.coalesce(F.col("__fit")["action"], F.col("host_verdict"), F.lit("allow")).alias("verdict"),
    )


def op5_url_filters(spark, sf_dir):
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
