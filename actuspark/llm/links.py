"""URL filters: rules on hosts and paths, and trust that spreads over the links between hosts.

Everything is a DataFrame expression. Pages that no rule covers are judged by their host: personalised PageRank carries trust
from the hosts of allowed pages along the links, and distrust from the hosts of blocked pages against the links (whoever links
to a blocked host is suspect), and a host is blocked if more than ``threshold`` of what reaches it is distrust.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actuspark.llm.common import constants
from actuspark.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or where ``://`` is missing."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and all domains that it is a subdomain of."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule`` and ``ruled`` (the verdict of the longest rule that fits, equal ones: the first by text; else null) to (host, path).

    Rules are matched to distinct hosts through their suffixes; pages then choose among the few rules of their host.
    """
    known = rules.select(F.col("host").alias("suffix"), F.struct(
        -F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("r"))
    hosts = pages.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("suffix"))
    fitting = hosts.join(known, "suffix").groupBy("host").agg(F.array_sort(F.collect_list("r")).alias("rules"))
    chosen = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    joined = pages.join(fitting, "host", "left").withColumn("chosen", F.get(chosen, F.lit(0)))
    return joined.withColumn("rule", F.col("chosen.rule")).withColumn("ruled", F.col("chosen.verdict")).drop("rules", "chosen")


def spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(host, rank): personalised PageRank over (src, dst, weight), weights adding up to 1 for each src; seeds (host, seed) add up to 1.

    Rounds stop when no new host is reached and no host's rank grows by more than ``tolerance`` of itself, so that neither the
    number of seeds without links nor the length of a chain matters. Ranks only grow, by ``damping`` less each round. Rank that ends in hosts without links is not redistributed.
    """
    start = materialize(seeds.where("seed > 0").select("host", (F.col("seed") * (1 - damping)).alias("rank")), "rank")
    rank = start
    while True:
        moved = edges.join(rank, edges.src == rank.host).groupBy("dst").agg(F.sum(F.col("rank") * F.col("weight") * damping).alias("rank"))
        new = start.union(moved.select(F.col("dst"), "rank")).groupBy("host").agg(F.sum("rank").alias("rank"))
        new = materialize(new, "rank")
        moving = new.alias("n").join(rank.alias("o"), "host", "left").where(
            F.col("n.rank") - F.coalesce("o.rank", F.lit(0.0)) > tolerance * F.col("n.rank")).limit(1).count()
        rank = new
        if not moving:
            break
    return rank


def filtered(pages: DataFrame, rules: Sequence[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", html: str = "html",
             damping: float = 0.85, threshold: float = 0.5, tolerance: float = 1e-4) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of each page.

    ``rules`` are (host, path, allow or block) of the configuration. Pages of hosts that neither trust nor distrust reaches are
    allowed. Null pages have no links; links to the own host do not count. Repeated rows come out as often as they come in, an
    empty table gives an empty result, other columns may have any names.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url).cast("string"))
    base = pages.select(F.col(page_id).alias("id"), host.alias("host"), path.alias("path"))
    table = constants(spark, [tuple(r) for r in rules], dict.fromkeys(("host", "path", "verdict"), pa.string()))
    judged = materialize(apply_rules(base, table), "pages")
    counts = judged.groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    counts = materialize(counts, "hosts")
    total = counts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    found = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("dst"))
    found = found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src != '' and src != dst")
    edges = materialize(found.groupBy("src", "dst").agg(F.count("*").alias("n")), "links")
    out_sum = edges.groupBy(F.col("src").alias("s")).agg(F.sum("n").alias("all"))
    in_sum = edges.groupBy(F.col("dst").alias("s")).agg(F.sum("n").alias("all"))
    forward = edges.join(out_sum, F.col("src") == F.col("s")).select("src", "dst", (F.col("n") / F.col("all")).alias("weight"))
    backward = edges.join(in_sum, F.col("dst") == F.col("s")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("weight"))
    trust = spread(forward, counts.select("host", (F.col("good") / F.lit(max(total.good or 0, 1))).alias("seed")), damping, tolerance)
    distrust = spread(backward, counts.select("host", (F.col("bad") / F.lit(max(total.bad or 0, 1))).alias("seed")), damping, tolerance)
    hosts = counts.select("host").join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(
        distrust.withColumnRenamed("rank", "distrust"), "host", "left").fillna(0.0)
    suspect = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    verdict = F.coalesce("ruled", F.when(suspect, "block").otherwise("allow"))
    return judged.join(hosts, "host").select(F.col("id").alias(page_id), "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
