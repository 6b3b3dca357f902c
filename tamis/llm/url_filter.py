"""URL filters by rules and by propagation over the link graph of hosts.

Rules name a host (with all its subdomains) and the beginning of a path; the longest rule that fits decides. Where none
fits, the host's place in the link graph does: pages that a rule allows make their hosts trusted seeds, pages that a rule
blocks make theirs blocked seeds, each weighted by its pages. Trust is a personalised PageRank from the trusted seeds along the links;
distrust is one from the blocked seeds against the links, since who links to blocked hosts is suspect. A host is
blocked when distrust, scaled by the blocked pages, makes up more than ``threshold`` of trust and distrust; a host that
neither reaches is allowed.

Links are counted per pair of hosts before any shuffle, so a host with a third of all pages is one row per neighbour. Links
within a host do not count. Iterations are written to the shared folder and stop when the ranks move by less than ``tolerance`` and no
further host is reached; if that takes more than ``MOST_ROUNDS``, an error is raised.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end. Both
are empty for a null url and one without ``://``; such pages are allowed. Null markup has no links. Rows with equal
or null ids are judged one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.store import discard, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The target of a link: quoted or bare.
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
#: A bound for safety only: rounds grow with the longest of the shortest ways from a seed, and with the logarithm of the tolerance.
MOST_ROUNDS = 2000


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.coalesce(F.when(at > 0, F.translate(host, UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    path = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(at > 0, path), F.lit(""))


def rule_of(rules: Sequence[Rule], host: str, path: str) -> Column:
    """(text, verdict) of the longest rule that fits, else null. ``rules`` is a parameter of modest size."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col(host) == rule.host) | F.endswith(F.col(host), F.lit("." + rule.host))) & F.startswith(F.col(path), F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def links_between_hosts(pages: DataFrame) -> DataFrame:
    """(source, target, n): how many links lead from one host to another. ``pages`` has host and html."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))
    outward = F.filter(found, lambda x: F.startswith(x, F.lit("//")) | (F.instr(x, "://") > 0))
    rows = pages.where("host <> ''").select(F.col("host").alias("source"), F.explode(outward).alias("link"))
    target = host_of(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("x:"), "link")).otherwise(F.col("link")))
    return (rows.select("source", target.alias("target")).where("target <> '' AND target <> source")
            .groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(kind, host, rank): personalised PageRank along ``links`` (kind, source, target, n) from ``seeds`` (kind, host, pages), for
    every kind by itself. Ranks of a kind add up to 1; what flows out of hosts without links returns to the seeds. ``iterations``: stop after
    so many rounds, converged or not; without it, rounds go on until the ranks have converged."""
    spark = links.sparkSession
    share = seeds.groupBy("kind").agg(F.sum("pages").alias("all"))
    seed = stored(seeds.join(share, "kind").select("kind", "host", (F.col("pages") / F.col("all")).alias("seed")), "seeds")
    out = links.groupBy("kind", "source").agg(F.sum("n").alias("out"))
    weighted = stored(links.join(out, ["kind", "source"]).select("kind", "source", "target", (F.col("n") / F.col("out")).alias("weight")), "host-links")
    ranks = stored(seed.select("kind", "host", F.col("seed").alias("rank")), "ranks")
    for _ in range(MOST_ROUNDS if iterations is None else iterations):
        flow = (ranks.withColumnRenamed("host", "source").join(weighted, ["kind", "source"])
                .groupBy("kind", F.col("target").alias("host")).agg(F.sum(F.col("rank") * F.col("weight")).alias("flow")))
        kept = flow.groupBy("kind").agg(F.sum("flow").alias("kept"))  # at most one row per kind
        back = seed.join(kept, "kind", "left").select("kind", "host", ((1 - damping * F.coalesce("kept", F.lit(0.0))) * F.col("seed")).alias("back"))
        new = flow.join(back, ["kind", "host"], "full").select(
            "kind", "host", (damping * F.coalesce("flow", F.lit(0.0)) + F.coalesce("back", F.lit(0.0))).alias("rank"))
        new = stored(new, "ranks")
        moved, reached = (new.withColumnRenamed("rank", "now").join(ranks, ["kind", "host"], "full")
                          .agg(F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("rank", F.lit(0.0)))),
                               F.count(F.when(F.col("rank").isNull(), 1))).first())
        discard(spark, ranks)
        ranks = new
        if not reached and (not moved or moved < tolerance):
            break
    else:
        if iterations is None:
            raise RuntimeError(f"ranks have not converged in {MOST_ROUNDS} rounds")
    return ranks


def judge(pages: DataFrame, rules: Sequence[Rule], threshold: float = 0.5, damping: float = 0.85) -> DataFrame:
    """``pages`` (url, html, more) with host, path, rule, verdict, trust and distrust; columns of these names that are already there
    are replaced."""
    added = ["host", "path", "rule", "verdict", "trust", "distrust"]
    pages = pages.drop(*added)
    parted = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("rule", rule_of(rules, "host", "path"))
    seeds = stored(parted.where("rule IS NOT NULL AND host <> ''").groupBy(F.col("rule.verdict").alias("kind"), "host").agg(F.count(F.lit(1)).alias("pages")), "seeds")
    between = stored(links_between_hosts(parted), "host-links")
    links = between.select(F.lit("allow").alias("kind"), "source", "target", "n").unionByName(
        between.select(F.lit("block").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n"))
    ranks = propagate(links, seeds, damping)
    total = seeds.groupBy("kind").agg(F.sum("pages").alias("pages"))
    scaled = ranks.join(total, "kind").withColumn("mass", F.col("rank") * F.col("pages"))
    of_host = scaled.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("kind") == "allow", F.col("mass"))), F.lit(0.0)).alias("trust"),
                                         F.coalesce(F.sum(F.when(F.col("kind") == "block", F.col("mass"))), F.lit(0.0)).alias("distrust"))
    joined = parted.join(of_host, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    by_graph = F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return joined.withColumn("verdict", F.coalesce(F.col("rule.verdict"), by_graph)).withColumn("rule", F.col("rule.text")).select(*pages.columns, *added)
