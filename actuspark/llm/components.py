"""Connected components of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actuspark.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge to another node.

    Alternates the two star operations: every node first hooks its larger neighbours to its smallest neighbour, then the
    smaller ones, until nothing changes. Each is one aggregation (a minimum, combined before the shuffle) and one join on the
    node; the number of edges never grows, the number of rounds is logarithmic in practice. Each round is a written table.
    Null ends, loops and repeated edges are ignored; an empty table gives an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    pairs = materialize(pairs, "edges")
    while True:
        # Large star: larger neighbours of a node go to the smallest of the node and its neighbours.
        both = pairs.select("u", "v").union(pairs.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where(F.col("u") != F.col("v")).distinct(), "edges")
        # Small star: smaller neighbours of a node, and the node itself, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        small = materialize(small, "edges")
        changed = small.exceptAll(pairs).limit(1).count() + pairs.exceptAll(small).limit(1).count()
        pairs = small
        if not changed:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
