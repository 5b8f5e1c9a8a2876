"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _flattened(parent: DataFrame) -> DataFrame:
    """Pointer jumping: every node's root; parents are smaller than their children."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        parent = cut_lineage(parent.join(up, "parent").select("node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")), "jump")
        if parent.filter("moved").isEmpty():
            return parent.select("node", "parent")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b); the root is the component's smallest node.

    Each round hangs every node under its smallest neighbour, if smaller, finds the
    roots by pointer jumping and contracts the edges, so at least half of the nodes
    that still have edges vanish. A hub is only ever aggregated, never collected.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while roots is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = _flattened(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("parent")))
        if roots is None:
            roots = parent.withColumnRenamed("parent", "root")
        else:
            above = parent.select(F.col("node").alias("root"), F.col("parent").alias("above"))
            roots = cut_lineage(roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
        low = parent.select(F.col("node").alias("a"), F.col("parent").alias("x"))
        high = parent.select(F.col("node").alias("b"), F.col("parent").alias("y"))
        merged = edges.join(low, "a").join(high, "b").filter("x <> y")
        edges = cut_lineage(merged.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return roots
