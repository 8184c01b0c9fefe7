"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node in `links` (a, b: long); root is the smallest node.

    Each round gives a node the smallest label among its neighbours and itself, then
    follows that label one step. Labels are joined as one row per node, so a hub with
    many links makes a skewed join that Spark splits, never a collected group. Rounds
    end when no label changes; each round is a written table. An empty link table
    gives no rows.
    """
    both = scratch.write(
        links.filter("a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.*")
        .distinct()
    )
    labels = scratch.write(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root"))
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        hooked = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("hop"))
        jumped = hooked.join(labels.select(F.col("node").alias("hop"), F.col("root").alias("far")), "hop")
        after = scratch.write(jumped.select("node", F.least("hop", "far").alias("root"), "old"))
        moved = after.filter("root <> old").limit(1).count()
        labels = after.drop("old")
        if not moved:
            return labels
