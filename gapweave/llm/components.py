"""Connected components of an edge table, without bringing it to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapweave.storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of every node in ``(a, b)``; ``root`` is the smallest id it is linked to.

    Each round takes the smallest root among neighbours, then the root's root, so chains
    shorten to half or less. A node with many neighbours is aggregated before its shuffle.
    It ends when a round changes nothing.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("near"))
        met = materialize(
            labels.join(near, F.col("id") == F.col("a")).select("id", "root", F.least("root", "near").alias("to"))
        )
        up = met.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
        new = materialize(
            met.join(up, F.col("to") == F.col("_id")).select(
                "id", F.col("_to").alias("root"), (F.col("_to") != F.col("root")).alias("moved")
            )
        )
        labels = new.select("id", "root")
        if new.where("moved").isEmpty():
            return labels
