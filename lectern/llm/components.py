"""Connected components of a graph given by its edges, by label hooking and pointer jumping over shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import table


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of any orderable kind -> (node, label): of each node with an edge, the least node that it reaches.

    Each round, a label hooks to the least label that an edge connects it with, then every edge moves to its ends'
    labels and edges within a label disappear; chains of hooks are followed to their ends first. The edges left at
    least halve the labels that have any, so rounds grow as the logarithm of the longest path. Loops are ignored;
    repeated edges change nothing; no edges, no nodes.
    """
    edges = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = table(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = table(both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("least")).select("at", F.least("at", "least").alias("to")), "hooks")
        while True:  # each hook points to a lesser label, so chains end
            up = hook.select(F.col("at").alias("at2"), F.col("to").alias("to2"))
            step = table(hook.join(up, F.col("to") == F.col("at2"), "left").select("at", F.coalesce("to2", "to").alias("next"), "to"), "hooks")
            done = step.where("next <> to").isEmpty()
            hook = step.select("at", F.col("next").alias("to"))
            if done:
                break
        labels = table(labels.join(hook, F.col("label") == F.col("at"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        ha, hb = hook.select(F.col("at").alias("xa"), F.col("to").alias("ta")), hook.select(F.col("at").alias("xb"), F.col("to").alias("tb"))
        moved = edges.join(ha, F.col("a") == F.col("xa")).join(hb, F.col("b") == F.col("xb")).where("ta <> tb")
        edges = table(moved.select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct(), "edges")
    return labels
