"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond".  Each round is
one aggregation and one join on the node, so a node of very many links is
pre-aggregated map-side and its join can be split; no neighbourhood is ever
gathered in one task.  Rounds are written tables, which also cut the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.tables import fitted, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges``: (a, b) long.  Returns (node, component) for each node of a link, component the smallest node reachable.

    Empty links give an empty table; loops and repeated links do no harm.
    """
    # Every round has at most twice the links of the one before, and files to match.
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark, n = None, now.count()
    for _ in range(rounds):
        now = written(fitted(_star(_star(now, True), False), 2 * n), "star")
        n, s = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if (n, s) == mark:
            break
        mark = (n, s)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # Settled: every node but the roots points to its root, and nothing else is left.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
