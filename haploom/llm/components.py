"""Connected components of a table of links, by hooking to smaller neighbours and jumping to roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haploom.session import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a long, b long); the root is one node of the component.

    Each round hooks every node to its smallest neighbour below it, follows the hooks one step
    further, and contracts the links; a handful of rounds suffices as paths halve. Each round is
    written to the shared folder. Nulls and loops are left out; no links give no rows.
    """
    edges = staged(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        hooks = staged(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hooks")
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        twice = hooks.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("up"))
        twice = staged(twice, "hooks")
        named = twice.select(F.col("node").alias("root"), "up")
        labels = staged(labels.join(named, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        by_a = twice.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        by_b = twice.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(by_b, "b", "left").join(by_a, "a", "left").select(F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b"))
        edges = staged(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return labels
