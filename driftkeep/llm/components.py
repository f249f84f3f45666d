"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkeep.llm.shared import discard, stash


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for ``nodes`` under ``edges`` (a, b).

    Each round every node takes the smallest label of its neighbours, then
    the label of its label, so chains shorten by half. Messages are summed
    before they are exchanged; a star of any size costs its edges. Only nodes
    that have edges take part in the rounds.
    """
    pairs = edges.select("a", "b").filter("a <> b")
    both = stash(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    label = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc-label")
    kept = label
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = label.join(near, label.node == near.a).select("node", F.col("root").alias("was"), F.least("root", "m").alias("mid"))
        hop = label.select(F.col("node").alias("mid"), F.col("root").alias("up"))
        after = stash(step.join(hop, "mid", "left").select("node", "was", F.least("mid", F.coalesce("up", "mid")).alias("root")), "cc-label")
        done = after.filter("was <> root").isEmpty()
        discard(kept)
        label, kept = after.select("node", "root"), after
        if done:
            break
    discard(both)
    return nodes.join(label, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
