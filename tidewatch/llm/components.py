"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import ready


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of the edges ``(a, b)``; root is the least node reachable.

    Each round takes the least label among neighbours (combined before the shuffle, so a hub costs
    one row a task) and then the label's own label. Rounds are checkpointed to the shared folder;
    only the number of changed labels comes to the driver.
    """
    ready(edges.sparkSession)
    # Both directions from one evaluation: which spanning edges come out may depend on row order.
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.where("a <> b").select(F.inline(turned)).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")).checkpoint()
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m")))
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = lower.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("top", "root")).alias("root")).checkpoint()
        if not new.where("root <> old").count():
            return new.select("node", "root")
        labels = new.select("node", "root")
