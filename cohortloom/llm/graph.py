"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.sources.stages import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node reachable from each node that has a link: (node, component).

    Alternating large-star and small-star steps: every step replaces links by links
    to the smallest neighbour, so it needs one combinable minimum per node and one
    join, never the neighbours of a node in one place, and a long chain halves with
    each round. Links of a node with itself, repeated and NULL links do no harm.
    """
    edges = stage(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u") > F.col("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("w"), F.least("u", "m").alias("m"))
        # Large star: neighbours above a node move to its smallest neighbour.
        large = both.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("w")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: neighbours below a node, and the node, move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w")).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct("u", F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()
        edges = stage(small, "links")
        state = edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    return (
        edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    )
