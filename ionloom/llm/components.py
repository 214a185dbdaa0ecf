"""Connected components of a graph given as edges, by large-star and small-star rounds.

Every round is two aggregations and two joins, nothing is gathered by node, and the number of
rounds grows with the logarithm of the longest chain. Each round is written to shared storage. The lowest
neighbours of a round are cached while it runs: exchanged again for the join (a row per node), and not
aggregated by the same key in the same stage, they let the partition of a node with very many edges be split. A
lost part of the cache is computed again from the round's written edges.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.session import stage


def dealt_anew(low: DataFrame) -> DataFrame:
    """The same rows (no m is above its u) by a computed key: the cache's partitioning is not taken for the join's,
    so both sides are exchanged and the partition of a hot node can be split."""
    return low.select(F.greatest("u", "m").alias("u"), "m")


def large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges of the round, its cached lowest neighbours)"""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).persist(StorageLevel.MEMORY_AND_DISK)
    moved = both.join(dealt_anew(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct(), low


def small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m")).persist(StorageLevel.MEMORY_AND_DISK)
    own = low.select("u", F.col("m").alias("v"))
    rest = down.join(dealt_anew(low), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(own).filter("u <> v").distinct(), low


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node that has an edge and the smallest node it reaches; ids are longs."""
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v").distinct()
    current = stage(edges, "edges")
    seen = state(current)
    while seen[0]:
        large, first = large_star(current)
        small, second = small_star(large)
        following = stage(small, "edges")
        first.unpersist()
        second.unpersist()
        now = state(following)
        current = following
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
