"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of edges (a long, b long); component is the smallest node reachable.

    Labels fall to the smallest neighbour's and then jump to their own label's label, so
    chains shorten by powers; only the number of changed labels reaches the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("x")).select("node", F.least("node", "x").alias("label")), "labels")
    changed = True
    while changed:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("n")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        target = lower.select(F.col("node").alias("t"), F.col("label").alias("jump"))
        new = cut(lower.join(target, F.col("label") == F.col("t")).select("node", "was", F.least("label", "jump").alias("label")), "labels")
        changed = new.filter("label <> was").limit(1).count() > 0
        labels = new.select("node", "label")
    return labels.select("node", F.col("label").alias("component"))
