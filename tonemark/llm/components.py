"""Connected components by alternating stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark.llm.common import staged


def _hooked(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Every neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if larger_only else both.filter("v < u")
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = around.join(least, "u")
    if larger_only:
        return tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = tied.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of the edges (u, v): root is the smallest node it reaches.

    Rounds end when a round changes nothing, which a count and a sum of hashes show; the
    number of rounds grows with the logarithm of the longest chain.
    """
    pairs = staged(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(pairs)
    while before[0]:
        pairs = staged(_hooked(_hooked(pairs, True), False).filter("u != v"), "stars")
        now = state(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select("u", F.col("v").alias("root"))
    return roots.unionByName(pairs.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
