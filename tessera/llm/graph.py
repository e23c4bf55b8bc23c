"""Connected components of links, by contraction in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node that links reach.

    Each round joins every node to the least of itself and its neighbours, in an order
    by hash, so that chains shrink by a share of their length and stars in one round;
    the links between the joined nodes are what is left for the next.  Neighbours are
    only ever aggregated, so a node may have any number of them.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    left = links.select("a", "b").where("a <> b")
    left = materialize(left.union(left.select("b", "a")).distinct(), "links")
    nodes = labels = None
    while left.head(1):
        joined = left.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a"))).alias("r")).select("a", F.col("r.v").alias("to"))
        joined = materialize(joined, "joined")
        if labels is None:
            labels = joined.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            labels = labels.join(joined.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        to_b = joined.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        left = left.join(joined, "a").join(to_b, "b").where("to <> to_b").select(F.col("to").alias("a"), F.col("to_b").alias("b")).distinct()
        left = materialize(left, "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    nodes = materialize(labels, "labels")
    return nodes.join(nodes.groupBy("label").agg(F.min("node").alias("component")), "label").select("node", "component")
