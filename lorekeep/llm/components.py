"""Connected components by alternating star contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import HOT, meet, stash

ROUNDS = 60


def _beside_least(pairs: DataFrame, n: int) -> DataFrame:
    """u, v, m: each of the n pairs (u, v) beside the least v of its u; the pairs of a hub stay where they are."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return meet(pairs, low, ["u"], F.col("n") * HOT > n).drop("n")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each larger neighbour of a node is tied to the least of the node and its neighbours (a > b throughout)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    return _beside_least(both, 2 * n).where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    low = _beside_least(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), n)
    moved = low.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.where("v = m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node of it) for each node that a link (u, v) names.

    Stars shrink the longest path by a constant factor each round, so rounds grow with its logarithm. Each
    half round is checkpointed. Loops, repeated links and either direction are allowed; no links, no rows.
    """
    named = links.where("u != v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
    edges, before = stash(named.distinct()), None
    for _ in range(ROUNDS):
        after = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if after == before or not after[0]:
            break
        before = after
        larger = stash(_large_star(edges, after[0]))
        edges = stash(_small_star(larger, larger.count()))
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
