"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.settings import release, staged


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node reached.

    Every round takes the smallest label among a node and its neighbours, then the label of
    that label, and writes the labels to the shared folder; it ends when none changed. All
    of it is keyed aggregates and joins, nothing is gathered on the driver but one number.
    Links to oneself only name a node, null ends are ignored, no links give no rows. The result
    is a staged table.
    """
    links = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    both = staged(links.union(links.select("b", "a")).distinct(), "links")
    table = labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = moved.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root"))
        before, table = table, staged(moved, "labels")
        release(before)
        labels = table.select("node", "root")
        if table.filter("old <> root").isEmpty():
            release(both)
            labels._staged_at = table._staged_at
            return labels


def merged_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) of earlier ones, a staged table that goes, and more links (a, b).

    Only links between different components count, and they count as links of the components'
    roots, so the rounds run over a graph of components and not over all nodes again.
    """
    of_a, of_b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    between = staged(ends.filter("a <> b").distinct(), "between")
    if between.isEmpty():
        release(between)
        return roots
    above = connected_components(between)
    moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = above.join(roots.select("node"), "node", "left_anti").select("node", "root")
    table = staged(moved.unionByName(fresh), "roots")
    release(between, above, roots)
    return table
