"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.scratch import Scratch



def relabel(df: DataFrame, labels: DataFrame | None, col: str) -> DataFrame:
    """Replace the ids of ``col`` by their roots; an id that labels lack is its own root."""
    if labels is None:
        return df
    found = labels.select(F.col("id").alias(col), F.col("root").alias("_root"))
    return df.join(found, col, "left").withColumn(col, F.coalesce("_root", col)).drop("_root")


def components(edges: DataFrame, scratch: Scratch, labels: DataFrame | None = None) -> DataFrame | None:
    """(id, root) for every id that is not the smallest of its component; None if there is no edge.

    Each round replaces ids by their roots, hooks every root under its smallest
    neighbour and shortens the resulting chains to length one by pointer
    doubling; chains only lead to smaller ids. Rounds end when no edge joins two
    roots. ``labels`` are the result of earlier edges, to be kept.
    """
    while True:
        roots = relabel(relabel(edges, labels, "a"), labels, "b").where("a <> b")
        hooks = scratch.table(roots.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("root")).groupBy("id").agg(F.min("root").alias("root")), "hooks")
        if hooks.isEmpty():
            return labels
        while True:
            up = hooks.select(F.col("id").alias("root"), F.col("root").alias("top"))
            step = scratch.table(hooks.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "jump")
            moved = not step.where("moved").isEmpty()
            scratch.drop(hooks)
            hooks = step
            if not moved:
                break
        hooks = hooks.select("id", "root")
        if labels is None:
            labels = hooks
        else:
            labels = scratch.table(relabel(labels, hooks, "root").unionByName(hooks), "labels")
