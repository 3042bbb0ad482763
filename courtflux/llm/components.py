"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Each step keeps the components and hangs nodes on smaller neighbours; after few rounds each component is a star on its smallest node.
Edges stay in tables of the shared folder; only their number and an order-free checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def large_star(edges: DataFrame) -> DataFrame:
    """For each node the larger neighbours move to its smallest neighbour (itself included).

    A hub's edges are many rows of one key against one row: adaptive execution splits them, and the minimum is partial before the shuffle.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b != m").select(F.col("m").alias("a"), "b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """For each node its smaller neighbours and itself move to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionAll(least.select(F.col("m").alias("a"), "b")).distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root of every node of ``edges`` (columns a and b of one type): root is the component's smallest node.

    Self-loops and repeated edges are allowed; nodes of self-loops alone are left out.
    """
    spark = edges.sparkSession
    path = C.shared_dir(spark)
    now = C.written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), path=path)
    seen = _sum(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        after = C.shared_dir(spark)
        then = C.written(small_star(large_star(now)), path=after)
        C.drop_dir(spark, path)
        now, path, before, seen = then, after, seen, _sum(then)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
