"""Connected components of a large edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, stored_bytes
from .common import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node reachable.

    Each round attaches every larger neighbour of a node to its smallest neighbour (large star), then every smaller one
    (small star); the edge list never grows beyond its first size, hubs are handled by aggregates and joins (AQE splits them),
    and each round is a written table, so nothing is collected and a lost executor repeats one round at most. An edge list within
    BROADCAST_BYTES, as written, is joined by broadcast and dealt over the cores, not over all shuffle partitions.
    """
    spark = edges.sparkSession
    now = written(edges.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), "edges")
    few = stored_bytes(spark, now._termweave_path) <= BROADCAST_BYTES
    cores = max(1, spark.sparkContext.defaultParallelism)

    def dealt(df: DataFrame) -> DataFrame:
        return df.coalesce(cores) if few else df

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(dealt(df)) if few else df

    mark = None
    for _ in range(rounds):
        both = now.union(now.selectExpr("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(side(low), "u").selectExpr("v u", "m v").where("u <> v").distinct()
        large = dealt(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(least), "u").selectExpr("inline(array(struct(u, m v), struct(v u, m v)))").where("u <> v").distinct()
        now = written(dealt(small), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark:
            return now.selectExpr("u node", "v root").union(now.selectExpr("v", "v").distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
