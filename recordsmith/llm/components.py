"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = down.join(least, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of the edges (u, v); root is the smallest node reachable.

    Each round is two shuffles of the edges, whose number never grows, and is
    written to the shared folder. A hub is one row on the aggregated side of
    each join, which is written first, so that the long side can be split. Self loops and nulls are ignored;
    no edges give no rows. It stops when the edges no longer change.
    """
    with scratch(edges.sparkSession):
        now = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
        seen = None
        for _ in range(max_rounds):
            now = materialize(_small_star(_large_star(now)), "edges")
            state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).cast("string")).first()
            if state == seen:
                named = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
                return materialize(named.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots", lasting=True)
            seen = state
    raise RuntimeError("components did not settle")
