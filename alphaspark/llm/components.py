"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b): every node looks at its neighbours (large: all; else the smaller ones) and hangs
    the larger (else: them and itself) below the smallest that it sees, itself included."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    # Staged, so that the join stands on two plain exchanges, whose hubs Spark can split.
    least = staged(least.select("a", F.least("a", "m").alias("m")), "least")
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs -> (node, component), component the smallest node reachable; for nodes with edges.

    Each round is two joins of the edges with one row per node, whose minimum is partly aggregated before the
    shuffle and staged, so that a hub's edges can be split over tasks; the edge table is staged after each round.  It ends when every
    node hangs below one root; the number of rounds grows with the logarithm of the longest chain.  Loops and
    repeated edges do no harm.  No edges: no rows.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for _ in range(rounds):
        now = staged(_stars(_stars(now, True), False), "edges")
        # Roots seen as 1, nodes by the number of their edges: a forest of stars has nothing else.
        roles = now.select(F.col("a").alias("node"), F.lit(1).alias("below")).union(now.select(F.col("b"), F.lit(0)).distinct())
        if not roles.groupBy("node").agg(F.sum("below").alias("n"), F.min("below").alias("lo")).where("n > 1 OR (n = 1 AND lo = 0)").head(1):
            break
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
