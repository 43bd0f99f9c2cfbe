"""Connected components of a table of links, by label passing with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import shuffles_released, temporary, written


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, label: each node of ``links`` (pairs of long ids) with its component's smallest node.

    Every round takes the smallest label among the neighbours and then the label of
    that label, so long chains shrink by halves. Labels are written each round and those
    of the round before deleted; only whether any changed comes to the driver.
    """
    with temporary():
        both = links.select(F.col(left).alias("node"), F.col(right).alias("near"))
        both = both.union(both.select(F.col("near").alias("node"), F.col("node").alias("near")))
        both = written(both.where(F.col("node") != F.col("near")).distinct(), "links")
        labels = both.groupBy("node").agg(F.min("near").alias("label"))
        labels = written(labels.select("node", F.least("node", "label").alias("label")), "labels")
        changed = True
        while changed:
            with temporary():
                heard = (
                    both.join(labels.select(F.col("node").alias("near"), "label"), "near")
                    .groupBy("node")
                    .agg(F.min("label").alias("heard"))
                )
                nearer = labels.join(heard, "node").select(
                    "node", F.col("label").alias("old"), F.least("label", "heard").alias("label")
                )
                jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
                after = written(
                    nearer.join(jump, "label", "left").select(
                        "node", F.coalesce(F.least("label", "next"), "label").alias("label"), "old"
                    ),
                    "labels",
                    kept=True,
                )
            with shuffles_released(links.sparkSession):
                changed = not after.where(F.col("label") != F.col("old")).isEmpty()
            labels = after.select("node", "label")
        return written(labels, "labels", kept=True)
