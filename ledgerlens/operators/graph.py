"""Connected parts of a graph that is given by its edges: rounds of joins and minimums over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.stored import written


def parts(edges: DataFrame) -> DataFrame:
    """(node, part) of the nodes of edges (a, b): the least node that links reach.

    Each round gives every node the least name among its neighbours, then that
    name's own name, so a chain takes rounds in the logarithm of its length. No
    node's links are collected: a hub is summed up by partial minimums.
    """
    ends = edges.select("a", "b").filter("a <> b")
    links = written(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    alone = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    named = written(alone.withColumn("part", F.col("node")))
    while True:
        # what neighbours are called, said to the node and to the node it is named after
        heard = links.join(named.select(F.col("node").alias("b"), F.col("part").alias("said")), "b").select("a", "said")
        low = heard.groupBy(F.col("a").alias("node")).agg(F.min("said").alias("said"))
        new = named.join(low, "node", "left").select("node", F.col("part").alias("old"), F.least("part", F.coalesce("said", "part")).alias("part"))
        hooks = new.filter("part < old").groupBy(F.col("old").alias("node")).agg(F.min("part").alias("hook"))
        new = written(new.join(hooks, "node", "left").select("node", "old", F.least("part", F.coalesce("hook", "part")).alias("part")))
        jumped = new.join(new.select(F.col("node").alias("part"), F.col("part").alias("next")), "part").select("node", F.least("part", "next").alias("part"), "old")
        named = written(jumped)
        if named.filter("part <> old").isEmpty():
            return named.select("node", "part")
        named = named.drop("old")
