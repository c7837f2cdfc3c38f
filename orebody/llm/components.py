"""Connected components of an edge table, without collecting nodes or edges.

Alternates *large-star* and *small-star* steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014).  Each step is a ``groupBy().min()``,
which combines before its shuffle and is cut there, and an equi-join whose one side
has one row a node, so that a node with very many links can be split by adaptive
execution.
The driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m")))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = cut(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges`` (columns ``a``, ``b``) with its least reachable node.

    Returns ``node``, ``component``.  Edges with a null end and loops are left out,
    repeated edges count once; nodes without a link to another node get no row.
    An empty table gives an empty table.
    """
    now = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    digest = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen.n == 0 or (seen.n, seen.s) == digest:
            break
        digest = (seen.n, seen.s)
        now = cut(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    lows = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return lows.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
