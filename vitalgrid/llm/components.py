"""Connected components of link tables, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b), component its smallest reachable node.

    Every round each node takes the smallest label among its neighbours and then that node's own label, so labels
    travel twice as far each time. Rounds go on until nothing changes; each is written to the shared folder.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).where("node <> other")
    both = both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other")))
    both = materialize(both.distinct(), "links")
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other")
            .groupBy("node")
            .agg(F.min("c").alias("c"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "c").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        moved = materialize(
            lower.join(jump, "component").select("node", "old", F.least("component", "up").alias("component")), "labels"
        )
        changed = moved.where("component <> old").limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels
