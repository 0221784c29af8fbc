"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wardenlake.llm.common import through_table


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The links as a table in the shared folder, and their number and a sum of hashes, taken while they are written."""
    seen = Observation()
    table = through_table(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), "links")
    return table, seen.get


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each end of a link ``(u long, v long)``; component is the smallest node reachable.

    Each step sends a node's links to its smallest neighbour.  A node's minimum is a grouped
    aggregate joined back, so the links of one hub are never gathered, and a table in the shared
    folder ends the lineage of each round.  Self-links and repeated links change nothing; nulls are
    dropped; no links give no rows.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = _written(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, after = _written(smallest.select("u", F.col("m").alias("v")).unionByName(moved).distinct())
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
