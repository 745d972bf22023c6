"""Connected components of an edge table, without the driver or one task ever holding a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b): component is the smallest node reachable. Nulls aren't nodes.

    Each round gives a node the smallest label among itself and its neighbours (a sum that is combined before the shuffle),
    then the label of its label, so that the distance covered grows with the labels' own; rounds end when no label changes.
    Every round is a written table. An edge table with self-loops alone gives each node itself.
    """
    paths: list[str] = []
    both = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = staged(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", into=paths)
    label = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumnRenamed("a", "node"), "labels", into=paths)
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        hooked = staged(label.join(near.withColumnRenamed("a", "node"), "node").select("node", "l", F.least("l", "m").alias("n")), "hooked", into=paths)
        up = hooked.select(F.col("node").alias("n"), F.col("n").alias("nn"))
        jumped = staged(hooked.join(up, "n").select("node", F.col("nn").alias("l"), (F.col("nn") != F.col("l")).alias("moved")), "labels", into=paths)
        moved = jumped.filter("moved").limit(1).count()
        label = jumped.select("node", "l")
        remove(edges.sparkSession, *paths[1:-1])
        del paths[1:-1]
        if not moved:
            remove(edges.sparkSession, paths[0])
            return label.withColumnRenamed("l", "component")
