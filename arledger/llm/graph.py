"""Connected components of stored edges, by hooking every node to its least neighbour in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by its least node.

    In each round a node takes its least neighbour (or itself) as parent, and the graph shrinks to the parents.
    Every join side is a stored table, so Spark can split a hot node's rows; distinct rows and minima are
    combined before their shuffles. The number of rounds is of the order of the logarithm of the longest path
    when names are in no order along it, as hashes are. A round's tables go when those of the next are stored.
    """
    live = common.stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while live.limit(1).count():
        last = labels
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = common.stored(both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("p")), "parents")
        of_a = parent.select("a", F.col("p").alias("pa"))
        of_b = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        hooked = live.join(of_a, "a").join(of_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        chains = parent.where("p <> a").select(F.col("p").alias("b")).distinct().join(of_b, "b").select(F.col("pb").alias("a"), "b")
        shrunk = hooked.union(chains).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            joined = labels.join(of_a, labels["component"] == of_a["a"], "left")
            labels = joined.select("node", F.coalesce("pa", "component").alias("component"))
        old = live, parent, last
        live, labels = common.stored(shrunk, "edges"), common.stored(labels, "labels")
        common.free(*old)
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
