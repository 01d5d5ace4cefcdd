"""Connected components by alternating large-star and small-star steps.

Only edges move between executors; nothing is gathered on the driver but two
numbers per round. Each round is written to the shared folder, so a lost
executor costs the current round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.where("v > u").join(_least(both), F.col("u") == F.col("k"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    joined = edges.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``.

    ``component`` is the smallest node reachable. Self loops and nulls are
    ignored; repeated edges count once; no edges give no rows. Raises if
    ``rounds`` rounds do not suffice (their number grows with the logarithm of
    the longest path).
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        now = stored(_small_star(_large_star(now)), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
