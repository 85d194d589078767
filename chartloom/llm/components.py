"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chartloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node of the component) of every node in ``a, b`` links.

    Smallest labels spread along links, and each round also jumps to the label of the label, so the
    rounds grow with the logarithm of the longest path. Every round is a stored table; links to a hub
    stay partial sums until their last shuffle.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "links")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        offers = (
            both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("offer"))
        )
        spread = labels.join(offers, labels.node == offers.a, "left").select(
            "node", "label", F.least("label", "offer").alias("nearer")
        )
        jumps = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = stored(
            spread.join(jumps, spread.nearer == jumps.at, "left").select(
                "node", F.least("nearer", "further").alias("label"), (F.least("nearer", "further") != F.col("label")).alias("moved")
            ),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
