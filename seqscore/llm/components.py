"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqscore.llm.common import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", safety: int = 200) -> DataFrame:
    """(node, root) for every node that an edge joins to a smaller one; root is the smallest
    node of the component, and smallest nodes themselves have no row. Nodes are of any
    orderable type. Null ends and loops are ignored, repeated edges count once.

    Each round hangs a node's larger neighbours, then the node and its smaller neighbours, on
    the smallest of them (large star, small star); the number of rounds grows with the
    logarithm of the longest chain. Minima are combined map-side, so a node with very many
    edges costs one row a task. The loop ends when a round changes nothing and raises if that
    takes more than ``safety`` rounds, rather than give split components.
    """
    x, y = F.col(a), F.col(b)
    now = cut_lineage(edges.where(x.isNotNull() & y.isNotNull() & (x != y))
                      .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    mark = _mark(now)
    for _ in range(safety):
        if not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = cut_lineage(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                          .select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        after = _mark(now)
        if after == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = after
    raise RuntimeError(f"components have not settled after {safety} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets: the count and the sum of two independent row hashes."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]).first()
    return tuple(r)
