"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import checkpoint, join_spread, spread


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Returns node, component (the smallest node that links reach) for each node of links.

    Labels spread to neighbours and along labels' own labels, so chains shorten by
    half and more in each round. Each round is written to the shared folder: lineage
    stays short and an executor's loss costs one round. The neighbours of one node, and the
    members of one component, are dealt over tasks. Nothing but counts reaches the
    driver. Loops and repeated links change nothing; no links give no rows.
    """
    both = checkpoint(links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a))).distinct())
    labels = checkpoint(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")))
    dealt, copied = spread(both, ["other"])
    while True:
        near = dealt.join(copied(labels.withColumnRenamed("node", "other")), ["other", "salt"]).groupBy("node").agg(F.min("component").alias("near"))
        step = checkpoint(labels.join(near, "node").select("node", F.col("component").alias("root"), F.least("component", "near").alias("next")))
        if step.filter("root != next").isEmpty():  # no neighbours differ
            return labels
        # A root takes what its members heard of; a member takes its root's label.
        heard = step.groupBy("root").agg(F.min("next").alias("heard"))
        labels = checkpoint(join_spread(step, heard, ["root"]).select("node", F.least("next", "heard").alias("component")))
