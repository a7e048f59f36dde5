"""Mixing sources to target weights by hierarchical budgeting over a domain / language / source tree.

A token budget goes down the tree. Each node shares its budget among its children by their weights; what a child cannot
supply (its tokens times the permitted epochs) goes to its siblings, and only what the whole family cannot supply reaches the
parent's siblings, because a family's supply bounds what its parent is given. Each leaf then takes whole epochs of its
documents and, of a last epoch, the prefix of a seeded order whose tokens fill the rest.

The tree has one row for each leaf and is a catalogue, not data; documents are only aggregated and joined. The prefix of a
leaf is found over hash ranges: token sums of the ranges, running totals over those, and an order by rows only within the one
range that the budget ends in, so that a leaf that holds a third of all documents is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actuspark.session import materialize

LEVELS = ("domain", "language", "source")
ROOT = "all"
#: Documents of a leaf that one hash range is to hold.
RANGE_ROWS = 1000
HASH_SPACE = 1 << 32


def seeded(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A place in a leaf's order for this epoch: the first 32 bits of an MD5, so that other engines can repeat it."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def tokens(text: str) -> Column:
    """Runs of characters other than blank, tab, line feed and carriage return."""
    return F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(F.col(text), F.lit("[^ \\t\\n\\r]+"))).cast("long")


def share_out(families: DataFrame, family: list[str]) -> DataFrame:
    """Add ``given`` to rows of (family..., budget, supply, weight): shares by weight, shortages spread over the siblings.

    Siblings are ordered by supply for each unit of weight. Those below the water level give all they have; the others share
    the rest by weight. ``budget`` is at most the family's supply.
    """
    order = W.partitionBy(*family).orderBy(F.col("supply") / F.col("weight"), *[c for c in LEVELS if c in families.columns])
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("supply").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    out = families.withColumn("level", level).withColumn("full", F.col("supply") <= F.col("weight") * F.col("level"))
    # Full rows come first in the order; the first row that is not full sets the level for itself and all after it.
    water = F.min(F.when(~F.col("full"), F.struct(F.col("supply") / F.col("weight"), F.col("level")))).over(W.partitionBy(*family))
    return out.withColumn("given", F.when(F.col("full"), F.col("supply")).otherwise(F.col("weight") * water["level"])).drop("level", "full")


def budgets(leaves: DataFrame, weights: DataFrame | None, budget: float, epochs: int) -> DataFrame:
    """(domain, language, source, tokens, given): the whole tokens each leaf is to deliver.

    ``leaves`` has the tokens of each leaf; ``weights`` the weight of a node under its parent as (level, node, weight), where
    missing nodes weigh 1 and weights are positive. The budget is cut to what the tree can supply.
    """
    tree = leaves.withColumn("supply", F.col("tokens").cast("double") * epochs)
    given = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = tree.groupBy(*path).agg(F.sum("supply").alias("supply"))
        if weights is None:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        else:
            own = weights.where(F.col("level") == level).groupBy(F.col("node").alias(level)).agg(F.max("weight").cast("double").alias("weight"))
            nodes = nodes.join(own, level, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        if given is None:
            nodes = nodes.withColumn("root", F.lit(ROOT)).withColumn(
                "budget", F.least(F.lit(float(budget)), F.sum("supply").over(W.partitionBy("root"))))
            family = ["root"]
        else:
            family = path[:-1]
            nodes = nodes.join(given.select(*family, F.col("given").alias("budget")), family)
        given = share_out(nodes, family).select(*path, "given")
    return leaves.join(given, list(LEVELS)).withColumn("given", F.floor(F.col("given") + 1e-6).cast("long"))


def mixed(docs: DataFrame, weights: DataFrame | None, share: float, epochs: int = 2, seed: int = 7, doc_id: str = "doc_id",
          text: str = "text", domain: Column | None = None, language: str = "lang", source: str = "source",
          range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, domain, language, source, n_tokens, epoch): the documents each leaf delivers, once for each epoch it takes them in.

    The budget is ``share`` of all tokens. Whole epochs come first; of the last one those documents are taken, in seeded
    order, before which the leaf's budget is not yet used up, so a leaf exceeds its budget by less than one document. Null
    domains, languages and sources form leaves of their own (shown as an empty string); documents without tokens cost nothing
    and are taken while the leaf's budget lasts, those of a leaf without any tokens never. A null id has its own place in
    the order; rows that share an id share a place and are taken in the order of their tokens and text. An empty table gives
    an empty result; other columns may have any names.
    """
    place = F.col(doc_id).cast("string")
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(domain if domain is not None else F.lit(ROOT), F.lit("")).alias("domain"),
                       F.coalesce(F.col(language).cast("string"), F.lit("")).alias("language"),
                       F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), tokens(text).alias("n_tokens"),
                       F.xxhash64(F.col(text).cast("string")).alias("tie"), F.coalesce(place, F.lit("")).alias("place"))
    rows = materialize(rows, "mix")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = budgets(leaves, weights, total * share, epochs).where("tokens > 0 and given > 0")
    plan = plan.withColumn("whole", F.floor(F.col("given") / F.col("tokens")).cast("int"))
    plan = plan.withColumn("rest", F.col("given") - F.col("whole") * F.col("tokens"))
    plan = materialize(plan.withColumn("width", F.ceil(F.lit(HASH_SPACE) / F.greatest(F.lit(1), F.ceil(F.col("n") / range_rows))).cast("long")), "plan")
    keyed = rows.join(plan.select(*LEVELS, "whole", "rest", "width"), list(LEVELS))
    full = keyed.where("whole > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("whole"))).alias("epoch"))
    last = keyed.where("rest > 0").withColumn("epoch", F.col("whole") + 1)
    last = last.withColumn("order", seeded(seed, F.col("epoch"), F.col("place"))).withColumn("range", F.floor(F.col("order") / F.col("width")))
    sums = last.groupBy(*LEVELS, "range", "rest").agg(F.sum("n_tokens").alias("sum"))
    running = W.partitionBy(*LEVELS).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(running), F.lit(0))).where("before < rest")
    sums = sums.withColumn("whole_range", F.col("before") + F.col("sum") <= F.col("rest"))
    last = last.join(sums.select(*LEVELS, "range", "before", "whole_range"), [*LEVELS, "range"])
    within = W.partitionBy(*LEVELS, "range").orderBy("order", "place", "n_tokens", "tie").rowsBetween(W.unboundedPreceding, -1)
    edge = last.where("not whole_range").withColumn("used", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    columns = [F.col("id").alias(doc_id), *LEVELS, "n_tokens", "epoch"]
    return full.select(columns).union(last.where("whole_range").select(columns)).union(edge.where("used < rest").select(columns))
