"""Classes of linked things."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarv.session import cut, release


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``links(a, b)``; the component is its smallest node.

    Each round every node takes the smallest label around it and then its
    label's label, so that rounds grow with the logarithm of the longest
    chain. Labels are written to the shared folder every round, the last ones
    removed, and nothing but the number of changes reaches the driver. A node with very many links
    costs no more than its links: labels are combined before the shuffle.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least")).select("node", F.least("node", "_least").alias("component"))
    last = labels = cut(labels)
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_least"))
        spread = labels.join(around, "node").select("node", F.least("component", "_least").alias("component"), F.col("component").alias("_was"))
        up = spread.select(F.col("node").alias("_up"), F.col("component").alias("_top"))
        moved = cut(spread.join(up, spread["component"] == up["_up"], "left").select("node", F.least("component", F.coalesce("_top", "component")).alias("component"), "_was"))
        changed = moved.where("component <> _was").limit(1).count()
        release(last)
        last, labels = moved, moved.select("node", "component")
        if not changed:
            release(both)
            return labels
