"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import released, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of each node's component; nodes without edges do not appear.

    Each round takes the smallest label among the neighbours and then the label of that label, and is
    written to the shared folder; only the number of changed labels reaches the driver.
    """
    both = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).select(F.col("x").alias("node"), "label"), "labels")
    last = labels
    while True:
        far = labels.select(F.col("node").alias("y"), F.col("label").alias("theirs")).hint("merge")
        near = both.join(far, "y").groupBy("x").agg(F.min("theirs").alias("theirs")).select(F.col("x").alias("node"), "theirs").hint("merge")
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond")).hint("merge")
        step = written(step.join(jump, "label", "left").select("node", "old", F.least("label", "beyond").alias("label")), "labels")
        released(last)
        last, labels = step, step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels
