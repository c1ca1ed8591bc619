"""Connected components by joins: minimum labels with pointer jumping, each round stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Self links and repeated links do no harm; links with a null end are left out; no links give no rows. A node with
    very many links is no hot group: its links are joined on their other end and reduced to a minimum before shuffling.
    """
    ends = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    links = stored(ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(links.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    changed = not links.isEmpty()
    while changed:
        other = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        best = links.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lowered = labels.join(best, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        following = stored(lowered.join(jump, "low").select("node", F.least("low", "lower").alias("label"), (F.least("low", "lower") < F.col("label")).alias("moved")), "labels")
        changed = not following.where("moved").isEmpty()
        labels = following.select("node", "label")
    return labels.select("node", F.col("label").alias("component"))
