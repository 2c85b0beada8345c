"""Connected components of a table of links, by hooking and contraction.

A round hooks every node to its least neighbour or itself and contracts the links to those labels. Of a connected part
at most half of the nodes are below all their neighbours, so rounds are logarithmic in the size of the largest
component, and links shrink from round to round. Each round is written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label for every node with a link to another; label is the least node of the component."""
    edges = materialize(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "links")
    labels = None
    while edges.head(1):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "hooks")
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("label"))
        else:
            moved = labels.join(hooks.withColumnRenamed("node", "_n"), F.col("label") == F.col("_n"), "left")
            labels = moved.select("node", F.coalesce("to", "label").alias("label"))
        left = edges.join(hooks.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        both_ends = left.join(hooks.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = materialize(both_ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
