"""Connected components by contraction: every node hooks to its smallest neighbour, trees collapse by pointer jumping,
and what links different trees is the next, much smaller, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of edges (a, b of one type that has an order)."""
    links = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct(), "links")
    label = None
    while not links.isEmpty():
        up = links.groupBy("u").agg(F.min("v").alias("p"))
        roots = links.select(F.col("v").alias("u")).distinct().join(up, "u", "left_anti").withColumn("p", F.col("u"))
        tree = durable(up.unionByName(roots), "tree")
        while True:  # each jump halves the distance to the root
            above = tree.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = durable(tree.join(above, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "tree")
            tree = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        if label is None:
            label = tree
        else:
            above = tree.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            label = durable(label.join(above, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "labels")
        to = tree.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        ends = links.join(tree, "u").select(F.col("p").alias("pu"), "v").join(to, "v").where(F.col("pu") != F.col("pv"))
        links = durable(ends.select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), "links")
    if label is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return label.select(F.col("u").alias("node"), F.col("p").alias("component"))
