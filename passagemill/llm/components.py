"""Connected components of a table of links, by smallest label, hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.shared import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """Every node of ``links`` (a long, b long) with the smallest node it can reach: (node, label).

    Each round takes the smallest label among the neighbours, gives it to the node's old label too, and
    then takes the label of that label, so rounds grow with the logarithm of the longest path (15 for shuffled chains of 1,000
    nodes, 25 for 100,000). Rounds are written tables; they end when no label changes. Links
    with a null end and links of a node with itself add nothing but the node.
    """
    pairs = links.where("a is not null and b is not null").select("a", "b")
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("l").alias("near"))
        )
        met = stored(labels.join(near, "node"), "met")
        hooks = met.where("near < label").groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        step = met.join(hooks, "node", "left").join(above, "label", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near", "hook", "top").alias("label")
        )
        done, labels = labels, stored(step, "labels")
        changed = labels.where("label <> old").limit(1).count()
        labels = labels.select("node", "label")
        drop_stored(done)
        drop_stored(met)
        if not changed:
            drop_stored(both)
            return labels
