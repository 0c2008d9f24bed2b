"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.store import removed, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of (a, b) ``links`` can reach, itself included.

    Every round takes the smallest label of a node and its neighbours and then the label of that
    label, so rounds grow with the logarithm of a component's width. Minima are combined before the
    shuffle and a round's tables are stored, so a node with very many links is split by the join.
    Links with a null end count for nothing; no links give no rows.
    """
    links = links.select("a", "b").where("a is not null and b is not null")
    both = stored(links.union(links.select("b", "a")), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        lower = stored(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels")
        head = lower.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        jumped = stored(lower.join(head, "label").select("node", F.col("jump").alias("label"), "was"), "labels")
        removed(links.sparkSession, labels, lower)
        labels = jumped.select("node", "label")
        if jumped.where("label < was").isEmpty():
            removed(links.sparkSession, both)
            return labels
