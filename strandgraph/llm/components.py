"""Connected components of a large graph by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparkops import checkpoint


def components(edges: DataFrame, rank: DataFrame) -> DataFrame:
    """(node, label): the least rank in each node's component.

    edges: (a, b) in either direction, loops and repeats allowed.  rank: (node,
    rank), one row for each node of an edge; ranks must be distinct between
    components.  Each round takes the least label around a node (partial
    aggregation keeps hubs small), then the label of the node that label came
    from, so a chain of length n takes about log n rounds.  A round is
    checkpointed; only a count returns to the driver.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    # A label is (rank, node that has it).
    now = checkpoint(rank.join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("node", F.struct(F.col("rank").alias("r"), F.col("node").alias("at")).alias("label")))
    while True:
        around = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        best = now.join(around.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("seen", "label")).alias("new"))
        best = checkpoint(best)
        jump = best.select(F.col("node").alias("at"), F.col("new").alias("further"))
        after = best.withColumn("at", F.col("new.at")).join(jump, "at").select("node", "old", F.least("new", "further").alias("label"))
        after = checkpoint(after)
        if not after.filter(F.col("old") != F.col("label")).limit(1).count():
            return after.select("node", F.col("label.r").alias("label"))
        now = after.select("node", "label")
