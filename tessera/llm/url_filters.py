"""URL filters: longest-fitting host and path rules, and trust propagated over the host graph where no rule fits.

The graph's nodes are the hosts of pages and links and all their parents down to two labels (``a.b.example.net``,
``b.example.net``, ``example.net``), whether these have pages or not. Its edges are the absolute links between hosts,
and site structure: a host and its parent lead to each other. Trust is a personalised PageRank from hosts whose pages
the allow rules fit; distrust runs against the edges from hosts whose pages the block rules fit (who links to a blocked
host is suspect). Each is one over its seeds, and one over all nodes in the end; what reaches a node without edges goes
back to the seeds. A round moves at most ``DAMPING`` of what the round before moved, on any graph, so rounds go on until
that power is less than ``TOLERANCE``. A host is blocked when its distrust exceeds ``ratio`` times its trust, compared
to ``DIGITS`` digits, which the tolerance does not reach.

Defined results: null urls and urls without ``://`` have an empty host and path, which no rule fits and which no edge
reaches (allow); hosts without trust and distrust are allowed; a rule fits its host and all subdomains when the path
begins with the rule's; of several the longest wins, on equal length block; null html has no links; repeated rows each
get their row and count in their host's share; only page_id, url and html are read, other columns may have any names;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, discard, read

#: (verdict, host, path) of the query's rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: The share that goes on in a round, the change at which rounds end, and the digits that are compared.
DAMPING, TOLERANCE, DIGITS = 0.5, 1e-6, 5
#: Rounds that are planned together, between two writes.
TOGETHER = 1

#: More rules than this are joined instead of written into the plan.
INLINE_RULES = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    part = lambda k: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def with_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` (null where none fits) to rows with host and path."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    if len(ordered) <= INLINE_RULES:
        rule = verdict = None
        for v, host, path in ordered:
            fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
            rule = rule.when(fits, host + path) if rule is not None else F.when(fits, host + path)
            verdict = verdict.when(fits, v) if verdict is not None else F.when(fits, v)
        return pages.withColumn("rule", rule if rule is not None else F.lit(None).cast("string")).withColumn("rule_verdict", verdict if verdict is not None else F.lit(None).cast("string"))
    table = pages.sparkSession.createDataFrame([(h, p, h + p, v) for v, h, p in ordered], "r_host string, r_path string, rule string, rule_verdict string")
    paths = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    fits = paths.withColumn("r_host", F.explode(above)).join(table, "r_host").where(F.col("path").startswith(F.col("r_path")))
    rank = F.struct(F.length("rule").alias("n"), (F.col("rule_verdict") == "block").alias("b"), "rule", "rule_verdict")
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("r")).select("host", "path", "r.rule", "r.rule_verdict")
    return pages.join(best, ["host", "path"], "left")


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, weight)`` between different hosts of pages (host, html), summed per pair before anything is exchanged."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?(?:[a-z]+:)?//([^/?#\"'\s<>]+)"), F.lit(1))
    linked = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("dst"))
    linked = linked.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    linked = cut(linked, "linked")
    hosts = pages.select("host").where("host <> ''").distinct().unionByName(linked.select(F.col("dst").alias("host"))).distinct()
    labels = F.split("host", r"\.")
    name = lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))
    steps = F.when(F.size(labels) > 2, F.sequence(F.lit(1), F.size(labels) - 2)).otherwise(F.array().cast("array<int>"))
    site = hosts.select(F.explode(F.transform(steps, lambda i: F.struct(name(i).alias("below"), name(i + 1).alias("above")))).alias("e")).select("e.*").distinct()
    both = F.array(F.struct(F.col("below").alias("src"), F.col("above").alias("dst")), F.struct(F.col("above").alias("src"), F.col("below").alias("dst")))
    structure = site.select(F.explode(both).alias("e")).select("e.*", F.lit(1.0).alias("weight"))
    return linked.unionByName(structure).where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``(host, trust, distrust)``: seeds ``(host, trust, distrust)`` spread along and against the edges until they rest.

    A round is one join of the scores with the edges and one sum per host, with map-side combine.
    """
    edges = cut(edges, "edges")
    flows = []
    for kind, start, end in (("trust", "src", "dst"), ("distrust", "dst", "src")):
        out = edges.groupBy(start).agg(F.sum("weight").alias("total"))
        flows.append(edges.join(out, start).select(F.col(start).alias("host"), F.col(end).alias("to"), F.lit(kind).alias("kind"), (damping * F.col("weight") / F.col("total")).alias("share")))
    flow = cut(flows[0].unionByName(flows[1]), "flow")
    sums = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    start = seeds.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), (F.col("trust") / F.lit(float(sums["t"] or 1) or 1.0)).alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), (F.col("distrust") / F.lit(float(sums["d"] or 1) or 1.0)).alias("seed")),
    )).alias("s")).select("host", "s.kind", "s.seed").where("seed > 0")
    score = start = cut(start, "seeds").withColumnRenamed("seed", "score")
    rounds, written = math.ceil(math.log(tolerance) / math.log(damping)), None
    for done in range(1, rounds + 1):
        moved = score.join(flow, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("score") * F.col("share")).alias("score"))
        score = moved.unionByName(start).groupBy("host", "kind").agg(F.sum("score").alias("score"))
        if done % TOGETHER == 0 or done == rounds:
            old, written = written, cut(score, "score")
            score = written
            if old is not None:
                discard(old)
    # what nodes without edges had went nowhere; given back to the seeds, it would have raised all scores in proportion
    sums = score.groupBy("kind").agg(F.sum("score").alias("all"))
    score = score.join(F.broadcast(sums), "kind").select("host", "kind", (F.col("score") / F.col("all")).alias("score"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return score.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], ratio: float = 1.0, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` of every row of ``(page_id, url, html)``."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    ruled = cut(with_rules(parts.select("page_id", "host", "path"), rules), "ruled")
    is_ = lambda v: F.sum(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0)) / F.count(F.lit(1))
    hosts = cut(ruled.where("host <> ''").groupBy("host").agg(is_("allow").alias("trust"), is_("block").alias("distrust")), "hosts")
    scores = propagate(host_edges(parts.select("host", "html")), hosts, damping, tolerance)
    rounded = lambda c: F.round(c, DIGITS)
    judged = cut(scores.select("host", rounded("trust").alias("trust"), rounded("distrust").alias("distrust")), "judged")
    judged = judged.withColumn("host_verdict", F.when(F.col("distrust") > rounded(ratio * F.col("trust")), "block").otherwise("allow"))
    out = ruled.join(judged, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)
