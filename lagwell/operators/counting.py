"""Weighted transition counts and what follows from them in long form ``(lag, i, j, value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_matrix(pairs: DataFrame, *, by: tuple[str, ...] = ("lag",), origin: str = "state", target: str = "state_tau") -> DataFrame:
    """C[i, j]: origin weights over pairs with both labels >= 0 and a positive origin weight; partial and final aggregate."""
    kept = pairs.where((F.col(origin) >= 0) & (F.col(target) >= 0) & (F.col("weight") > 0))
    return kept.groupBy(*by, F.col(origin).alias("i"), F.col(target).alias("j")).agg(F.sum("weight").alias("count"), F.count("*").alias("n_pairs"))


def transition_matrix(counts: DataFrame, n_states: int, *, reversible: bool = False, pseudocount: float = 1e-8, inactive: str = "self") -> DataFrame:
    """Dense T of each lag: optional (C + C^T)/2, then zero-row test, then the pseudocount, then rows over their sums.

    A row without counts becomes the identity (``self``) or uniform.
    """
    base = counts.select("lag", "i", "j", "count")
    if reversible:
        base = base.union(base.select("lag", F.col("j").alias("i"), F.col("i").alias("j"), "count")).groupBy("lag", "i", "j").agg((F.sum("count") / 2).alias("count"))
    states = F.explode(F.sequence(F.lit(0), F.lit(n_states - 1)))
    grid = base.select("lag").distinct().select("lag", states.alias("i")).select("lag", "i", states.alias("j"))
    dense = grid.join(base, ["lag", "i", "j"], "left").fillna(0.0, ["count"])
    row = W.partitionBy("lag", "i")
    dense = dense.withColumn("mass", F.sum("count").over(row))
    fallback = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) if inactive == "self" else F.lit(1.0 / n_states)
    p = F.when(F.col("mass") > 0, (F.col("count") + pseudocount) / (F.col("mass") + n_states * pseudocount)).otherwise(fallback)
    return dense.withColumn("p", p)


def residence_escape(transitions: DataFrame) -> DataFrame:
    """Residence -lag/ln p and escape lag/(1 - p) of each diagonal entry; p <= 0 gives 0 and lag, p >= 1 is unbounded (NULL and a flag)."""
    d = transitions.where("i = j")
    residence = F.when(F.col("p") <= 0, 0.0).when(F.col("p") < 1, -F.col("lag") / F.ln("p"))
    escape = F.when(F.col("p") <= 0, F.col("lag").cast("double")).when(F.col("p") < 1, F.col("lag") / (1 - F.col("p")))
    return d.select("lag", "i", "p", residence.alias("residence"), escape.alias("escape"), (F.col("p") >= 1).alias("unbounded"))


def active_states(df: DataFrame) -> DataFrame:
    """Labels that occur with positive weight."""
    return df.where("state >= 0 and weight > 0").select("state").distinct()


def restrict(counts: DataFrame, active: DataFrame) -> DataFrame:
    """Counts whose ends are both active; the active set is as small as the state space."""
    a = F.broadcast(active)
    return counts.join(a.withColumnRenamed("state", "i"), "i", "left_semi").join(a.withColumnRenamed("state", "j"), "j", "left_semi")


def coarsen(counts: DataFrame, mapping: DataFrame, value: str = "count") -> DataFrame:
    """Counts between merged labels: micro counts are summed, the frames are not read again."""
    m = F.broadcast(mapping)
    moved = counts.join(m.select(F.col("label").alias("i"), F.col("to").alias("ti")), "i").join(m.select(F.col("label").alias("j"), F.col("to").alias("tj")), "j")
    return moved.where("ti >= 0 and tj >= 0").groupBy("lag", F.col("ti").alias("i"), F.col("tj").alias("j")).agg(F.sum(value).alias(value))


def populations(df: DataFrame, label: str = "state", weight: str | None = None) -> DataFrame:
    """Frames per label, the unlabelled included; with ``weight`` also the share of the labelled weight."""
    if weight is None:
        return df.groupBy(label).agg(F.count("*").alias("n_frames"))
    kept = df.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n_frames"), F.sum(weight).alias("mass"))
    return kept.withColumn("pi", F.col("mass") / F.sum("mass").over(W.partitionBy(F.lit(0)))).drop("mass")


def mixing_scores(transitions: DataFrame, bidirectional: bool = True) -> DataFrame:
    """Of each unordered pair and lag: min (or max) of the two directions."""
    back = transitions.select("lag", F.col("j").alias("i"), F.col("i").alias("j"), F.col("p").alias("p_back"))
    both = transitions.where("i < j").join(back, ["lag", "i", "j"])
    return both.select("lag", "i", "j", (F.least if bidirectional else F.greatest)("p", "p_back").alias("score"))


def cell_probabilities(cells: DataFrame, n_cells: int, pseudocount: float = 0.0, weight: str = "weight", cell: str = "cell") -> DataFrame:
    """Share of weight in each of ``n_cells`` cells, with a pseudocount, zeros included."""
    dense = cells.sparkSession.range(n_cells).select(F.col("id").cast("int").alias(cell))
    mass = cells.where(F.col(cell).between(0, n_cells - 1)).groupBy(cell).agg(F.sum(weight).alias("mass"))
    filled = dense.join(mass, cell, "left").select(cell, (F.coalesce("mass", F.lit(0.0)) + pseudocount).alias("mass"))
    return filled.withColumn("p", F.col("mass") / F.sum("mass").over(W.partitionBy(F.lit(0)))).drop("mass")


def kl_divergence(p: DataFrame, q: DataFrame, cell: str = "cell", eps: float = 1e-12) -> DataFrame:
    """sum p ln(p / max(q, eps)) over the cells with p > 0."""
    both = p.select(cell, F.col("p").alias("a")).join(q.select(cell, F.col("p").alias("b")), cell, "left")
    return both.where("a > 0").agg(F.sum(F.col("a") * F.ln(F.col("a") / F.greatest(F.coalesce("b", F.lit(0.0)), F.lit(eps)))).alias("kld"))
