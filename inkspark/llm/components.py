"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, join_counted, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of each node with a link; root is the smallest node of its component.

    ``links`` has columns a and b of one ordered type. Each round is two grouped minima, which combine on the map
    side, and two joins in which a node with very many links is broadcast instead of shuffled; its result goes to the shared
    folder and that of the round before is dropped. Nothing is collected but a count and a checksum."""
    ends = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = materialize(links.where("a <> b").select(*ends).distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n")
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), larger).where("n > 0").select("u", F.least("u", "m").alias("m"), "n"))
        large = join_counted(both.where("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = join_counted(large, least, "u", "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        made = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), edges)
        drop(large, least)
        edges = made
