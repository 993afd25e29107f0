"""Connected components as rounds of edge contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.plans.lineage import discard, materialize, shuffled

#: Edges up to which Spark may broadcast the pointers of a round.
FEW = 50_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every endpoint; component is the smallest id reachable.

    Each round points every node at the smallest of itself and its
    neighbours, follows the pointers to their ends by doubling, and rewrites
    the edges onto those ends; an edge whose ends meet is gone. A star or a
    chain of any length collapses in one round. The minimum per node is a
    partially aggregated groupBy, so a node with a third of all edges does
    not gather them in one task. Self-loops, repeated edges and NULL
    endpoints are ignored; no edges give an empty result.
    """
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a != b")
    live = materialize(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both_ends = live.select(F.col("a").alias("id")).union(live.select(F.col("b").alias("id"))).distinct()
    hops: list[DataFrame] = []
    for _ in range(max_rounds):
        n = live.count()
        if not n:
            break
        dealt = shuffled if n > FEW else lambda df: df
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "id").where("id != to"), 2 * n)
        for _ in range(max_rounds):
            onward = hop.select(F.col("id").alias("to"), F.col("to").alias("end"))
            if hop.join(dealt(onward), "to", "left_semi").isEmpty():
                break
            shorter, hop = hop, materialize(hop.join(dealt(onward), "to", "left").select("id", F.coalesce("end", "to").alias("to")), 2 * n)
            discard(shorter)
        hops.append(dealt(hop))
        left = hop.select(F.col("id").alias("a"), F.col("to").alias("ta"))
        right = hop.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        ends = live.join(dealt(left), "a", "left").join(dealt(right), "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        longer, live = live, materialize(ends.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n)
        if len(hops) > 1:  # the first edges name the ends
            discard(longer)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not hops:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = both_ends.select("id", F.col("id").alias("component"))
    for hop in hops:
        step = hop.select(F.col("id").alias("component"), "to")
        found = found.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return found
