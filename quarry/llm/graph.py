"""Connected components of an edge table by joins: smallest label of the neighbours, then of the label's own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for all nodes of edges (a, b; both long, not null).

    Repeated edges, both directions and edges of a node to itself change
    nothing; no edges give no rows; other columns are ignored.

    Labels jump to their label's label in each round, so the rounds grow with
    the logarithm of the longest chain. Minima are combined before the shuffle
    and joins can be split, so a node with very many edges stays cheap.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("node").alias("root"), F.col("label").alias("root_label"))
        moved = stored(step.join(roots, step.label == roots.root).select("node", "old", F.least("label", "root_label").alias("label")), "labels")
        labels = moved.select("node", "label")
        if not moved.where("label <> old").limit(1).count():
            return labels
