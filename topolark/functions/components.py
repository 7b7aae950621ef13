"""Connected components by alternating large-star and small-star rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, staging, most_rounds: int = 60) -> DataFrame:
    """(node, root): each node of the links (a, b) with the smallest node of its component, itself excluded.

    staging writes and drops tables in the shared folder; of each round only a count and a checksum reach the driver.
    Rounds grow with the logarithm of the longest way in a component.
    """
    edges = staging.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = digest(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        new = staging.write(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        staging.drop(edges)
        edges, before = new, state
        state = digest(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components: no fixpoint in {most_rounds} rounds")
