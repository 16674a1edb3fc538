"""Connected components of an edge table, by minimum labels and pointer jumping.

Each round takes the smallest label among a vertex and its neighbours
(pre-aggregated before the shuffle) and then follows the label's own label.
Rounds are written to the shared folder; the loop ends when no label moves.
Nothing but the count of moved labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_staged, staged


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for all nodes of ``edges`` (a, b)."""
    both = staged(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        low = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("to"))
        new = staged(low.join(jump, "low").select("node", "old", F.least("low", "to").alias("component")), "labels")
        moved = new.where("component < old").limit(1).count()
        drop_staged(labels)
        labels = new
        if not moved:
            drop_staged(both)
            return labels.select("node", "component")
