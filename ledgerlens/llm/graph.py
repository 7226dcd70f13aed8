"""Connected components by large-star and small-star rounds (joins and sums only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, release


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node that links reach.

    Each round points nodes at the smallest neighbour, in place or from below;
    the number of rounds grows with the logarithm of the longest path. A node
    with very many links is summed up by partial minimums and joined back.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b")
        # a node that is its own minimum keeps its links through its neighbours' rows
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        before, now = now, materialize(small.distinct(), "edges")
        release(before)
        last, mark = mark, _mark(now)
        if last == mark:
            break
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())
