"""Fluxes between committor surfaces, populations, exit hits, and their errors.

Pairs carry ``q`` and ``q_tau`` (arrays), ``weight`` of the origin and, for
hits, ``state`` and ``state_tau``. All estimators are ratios of sums, so
leave-one-block-out values come from block sums and one total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwell.functions.arrays import sigmoid


def thresholds(n: int = 9, start: float = 0.1, stop: float = 0.9) -> list[float]:
    if n < 1 or not 0 < start <= stop < 1:
        raise ValueError("thresholds must lie strictly between 0 and 1")
    return [start + (stop - start) * k / (n - 1) for k in range(n)] if n > 1 else [start]


def ordered_pairs(n_states: int, adjacency: Sequence[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """All i != j, or the given pairs and their reverses, deduplicated in order."""
    if adjacency is None:
        return [(i, j) for i in range(n_states) for j in range(n_states) if i != j]
    seen: dict[tuple[int, int], None] = {}
    for i, j in adjacency:
        if i == j or not (0 <= i < n_states and 0 <= j < n_states):
            raise ValueError(f"not a pair of states: {(i, j)}")
        seen[i, j] = seen[j, i] = None
    return list(seen)


def crossing_weight(a: Column, b: Column, c: Column, eps: float = 0.02) -> Column:
    """Soft indicator that a value goes from above ``c`` to below it."""
    return sigmoid((a - c) / eps) * sigmoid((c - b) / eps)


def current(qi: Column, qj: Column, qi_tau: Column, qj_tau: Column) -> Column:
    return qj_tau * qi - qj * qi_tau


def _terms(pairs: DataFrame, chosen: Sequence[tuple[int, int]], at: Sequence[float], eps: float, surface: str) -> DataFrame:
    """One row per pair row, state pair and threshold with its crossing weight and current; state pairs and thresholds are literals, so nothing is joined."""
    options = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(c)).alias("c")) for i, j in chosen for c in at))
    long = pairs.select("*", F.explode(options).alias("o"))
    qi, qj, qi_t, qj_t = F.get("q", F.col("o.i")), F.get("q", F.col("o.j")), F.get("q_tau", F.col("o.i")), F.get("q_tau", F.col("o.j"))
    if surface == "qi_decrease":
        chi = crossing_weight(qi, qi_t, F.col("o.c"), eps)
    elif surface == "qj_increase":
        chi = sigmoid((F.col("o.c") - qj) / eps) * sigmoid((qj_t - F.col("o.c")) / eps)
    else:
        raise ValueError("surface must be qi_decrease or qj_increase")
    kept = [c for c in ("block",) if c in pairs.columns]
    return long.select(*kept, "weight", F.col("o.i").alias("i"), F.col("o.j").alias("j"), F.col("o.c").alias("c"), (chi * current(qi, qj, qi_t, qj_t)).alias("x"), current(qi, qj, qi_t, qj_t).alias("current"))


def flux_profiles(pairs: DataFrame, chosen: Sequence[tuple[int, int]], at: Sequence[float], *, eps: float = 0.02, tau: float | None = None, surface: str = "qi_decrease", by: Sequence[str] = ()) -> DataFrame:
    """J_ij(c), mean current, mean |current| and the direct error of J, per state pair and threshold."""
    t = _terms(pairs, chosen, at, eps, surface)
    w, x = F.col("weight"), F.col("x")
    s = t.groupBy(*by, "i", "j", "c").agg(
        F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * w).alias("w2"), F.sum(w * w * x).alias("w2x"), F.sum(w * w * x * x).alias("w2xx"), F.sum(w * F.col("current")).alias("wc"), F.sum(w * F.abs("current")).alias("wac")
    )
    scale = 1.0 if tau is None else 1.0 / tau
    j = F.col("wx") / F.col("w")
    spread = F.sqrt(F.greatest(F.col("w2xx") - 2 * j * F.col("w2x") + j * j * F.col("w2"), F.lit(0.0))) / F.col("w")
    return s.where("w > 0").select(*by, "i", "j", "c", (j * scale).alias("flux"), (spread * scale).alias("flux_std"), (F.col("wc") / F.col("w")).alias("mean_current"), (F.col("wac") / F.col("w")).alias("mean_abs_current"))


def pair_flux(profiles: DataFrame) -> DataFrame:
    """Mean and population variance of J over the thresholds."""
    return profiles.groupBy("i", "j").agg(F.avg("flux").alias("flux"), F.var_pop("flux").alias("flux_variance"))


def soft_populations(df: DataFrame) -> DataFrame:
    """pi_j as the weighted mean of q_j."""
    long = df.select("weight", F.posexplode("q").alias("state", "x"))
    return long.groupBy("state").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("pi"))


def exit_hits(pairs: DataFrame, *, weighted: bool = True, labelled_exits_only: bool = False) -> DataFrame:
    """T_hit[i, j]: mean of q_j(t + tau) over the pairs that leave i; exits to -1 count unless asked not to."""
    left = pairs.where("state >= 0 and state_tau != state")
    if labelled_exits_only:
        left = left.where("state_tau >= 0")
    w = F.col("weight") if weighted else F.lit(1.0)
    long = left.select(F.col("state").alias("i"), w.alias("w"), F.posexplode("q_tau").alias("j", "x"))
    s = long.groupBy("i", "j").agg(F.count("*").alias("n_exits"), F.sum("w").alias("mass"), F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum(F.col("w") ** 2).alias("w2"), F.sum(F.col("w") ** 2 * F.col("x")).alias("w2x"), F.sum(F.col("w") ** 2 * F.col("x") ** 2).alias("w2xx"))
    m = F.col("wx") / F.col("mass")
    spread = F.sqrt(F.greatest(F.col("w2xx") - 2 * m * F.col("w2x") + m * m * F.col("w2"), F.lit(0.0))) / F.col("mass")
    return s.where("mass > 0").select("i", "j", "n_exits", "mass", m.alias("t_hit"), spread.alias("t_hit_std"))


def blocks(pairs: DataFrame, n_blocks: int, order: str = "row_id") -> DataFrame:
    """``block``: contiguous blocks of pairs in order, the first ones longer by one where the split is uneven.

    ``order`` must be a number with few repeats; ranks come from counts per
    range of it, so no partition holds all rows.
    """
    spark = pairs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lo, hi, n = pairs.agg(F.min(order), F.max(order), F.count("*")).first()
    if not n:
        return pairs.withColumn("block", F.lit(0))
    width = max(1, -(-(hi - lo + 1) // parts))
    ranged = pairs.withColumn("_range", F.floor((F.col(order) - lo) / width).cast("long"))
    ahead = ranged.groupBy("_range").count().withColumn("_ahead", F.coalesce(F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = ranged.join(F.broadcast(ahead), "_range").withColumn("_r", F.col("_ahead") + F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1)
    size, longer = divmod(n, n_blocks)
    cut = longer * (size + 1)
    block = F.when(F.col("_r") < cut, F.floor(F.col("_r") / (size + 1))).otherwise(longer + F.floor((F.col("_r") - cut) / max(size, 1)))
    return ranked.withColumn("block", block.cast("int")).drop("_range", "_ahead", "_r")


def jackknife_flux(pairs: DataFrame, chosen: Sequence[tuple[int, int]], at: Sequence[float], n_blocks: int = 10, *, eps: float = 0.02) -> DataFrame:
    """Leave-one-block-out mean flux: total minus block, then std (ddof 1) times (n - 1)/sqrt(n)."""
    t = _terms(blocks(pairs, n_blocks), chosen, at, eps, "qi_decrease")
    part = t.groupBy("block", "i", "j", "c").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("x")).alias("wx"))
    every = W.partitionBy("i", "j", "c")
    loo = part.withColumn("lw", F.sum("w").over(every) - F.col("w")).withColumn("lx", F.sum("wx").over(every) - F.col("wx"))
    value = loo.groupBy("block", "i", "j").agg(F.avg(F.col("lx") / F.col("lw")).alias("flux"))
    n = F.count("*")
    return value.groupBy("i", "j").agg(F.avg("flux").alias("flux"), (F.stddev_samp("flux") * (n - 1) / F.sqrt(n)).alias("flux_jackknife"), n.alias("n_blocks"))


def slice_sem_flux(pairs: DataFrame, chosen: Sequence[tuple[int, int]], at: Sequence[float], n_blocks: int = 10, *, eps: float = 0.02) -> DataFrame:
    """The flux of each slice, and the standard error of their mean."""
    per = flux_profiles(blocks(pairs, n_blocks), chosen, at, eps=eps, by=("block",)).groupBy("block", "i", "j").agg(F.avg("flux").alias("flux"))
    return per.groupBy("i", "j").agg(F.avg("flux").alias("flux"), (F.stddev_samp("flux") / F.sqrt(F.count("*"))).alias("flux_sem"))


def matrix_frame(spark: SparkSession, values, name: str = "value") -> DataFrame:  # noqa: ANN001
    """A driver matrix as long rows; NaN and infinity become NULL with a flag."""
    import math

    rows = [(i, j, None if not math.isfinite(v) else float(v), bool(math.isinf(v))) for i, row in enumerate(values) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, f"i int, j int, {name} double, unbounded boolean")
