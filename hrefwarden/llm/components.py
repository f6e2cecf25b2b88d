"""Connected components of a link table by union-find: hooking to the least neighbour, pointer jumping, contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefwarden import scratch


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, component): every node of the links (a, b) with the least node it reaches.

    A round points each node at its least neighbour (or itself), lets each pointer
    jump to what its target points at, and replaces links by links between the
    targets; a component's least node points at itself throughout. All tables are
    written between rounds, and minima fold on the map side, so that a node with any
    number of links is no burden. Rounds grow with the logarithm of the longest chain.
    """
    left = scratch.stage(links.select("a", "b").where("a <> b").distinct(), folder, "links_0")
    labels = None
    for turn in range(1, 100):
        if left.isEmpty():
            break
        both = left.union(left.select(F.col("b"), F.col("a")))
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to"))
        hooked = scratch.stage(hooked, folder, f"hooked_{turn}")
        ahead = hooked.select(F.col("node").alias("to"), F.col("to").alias("ahead"))
        jumped = scratch.stage(hooked.join(ahead, "to").select("node", F.col("ahead").alias("to")), folder, f"jumped_{turn}")
        if labels is None:
            labels = jumped.select("node", F.col("to").alias("component"))
        else:
            further = jumped.select(F.col("node").alias("component"), "to")
            labels = labels.join(further, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = scratch.stage(labels, folder, f"labels_{turn}")
        ends = left
        for end in ("a", "b"):
            ends = ends.join(jumped.select(F.col("node").alias(end), F.col("to").alias(f"new_{end}")), end)
        ends = ends.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
        left = scratch.stage(ends.where("a <> b").distinct(), folder, f"links_{turn}")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return labels
