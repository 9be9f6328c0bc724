"""Connected components of a table of links, by label propagation with pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, beside, is_few


def components(links: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """links (a, b), longs, in either direction and with repeats: (node, component), the smallest node reachable.

    Each round takes the least label of a node and its neighbours, then the label of that label. A label never rises, and
    a round without change ends it; chains shorten by half or more a round. Labels are pre-aggregated before a shuffle, so a
    node with many links costs no task more than its links; each round is a written table. Few labels go to the links, so that a
    round has one shuffle."""
    both = scratch.write(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), f"{name}-links")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), f"{name}-0")
    step, few = 0, is_few(labels)
    while True:
        step += 1
        seen = both.join(beside(labels, few), both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"))
        lower = seen.join(beside(labels, few), labels["node"] == seen["a"]).select("node", F.least("component", "least").alias("c"), F.col("component").alias("was"))
        target = labels.select(F.col("node").alias("t"), F.col("component").alias("tc"))
        jumped = lower.join(beside(target, few), F.col("c") == F.col("t"), "left").select("node", F.least("c", F.coalesce("tc", "c")).alias("component"), "was")
        new = scratch.write(jumped, f"{name}-{step}")
        changed = new.filter("component <> was").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("node", "component")
        if not changed:
            return labels
