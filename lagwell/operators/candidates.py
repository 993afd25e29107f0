"""New states among uncertain frames: kinetic groups, their dense cores in the space of slow modes, and what to do where kinetics says too little."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.functions import kinetics as K
from lagwell.operators.cluster import nearest_centers, renumber_by_population, weighted_core, weighted_sample
from lagwell.operators.counting import count_matrix
from lagwell.operators.graph import connected_components
from lagwell.operators.lag import keyed_pairs
from lagwell.operators.neighbours import nearest
from lagwell.plans.lineage import materialize


def neighbour_density(df: DataFrame, k: int, x: str = "x", by: str | None = None, power: float | None = None) -> DataFrame:
    """Add ``density``: the weight of a row and its k nearest (of its group) over the k-th distance to ``power``, min(d, 6) by default.

    Every row is a reference. Negative weights count as 0; a row with fewer
    than k others takes all of them; one without any has its own weight.
    """
    near = nearest(df, k, x, by=by)
    weight = F.greatest(F.col("weight"), F.lit(0.0))
    around = near.select("row_id", F.explode("ids").alias("id")).join(df.select(F.col("row_id").alias("id"), weight.alias("w")), "id").groupBy("row_id").agg(F.sum("w").alias("_around"))
    radius = near.select("row_id", F.when(F.size("dists") > 0, F.greatest(F.array_max("dists"), F.lit(1e-12))).alias("_r"))
    p = F.least(F.size(x), F.lit(6)) if power is None else F.lit(float(power))
    found = df.join(radius, "row_id", "left").join(around, "row_id", "left")
    density = (weight + F.coalesce("_around", F.lit(0.0))) / F.coalesce(F.pow("_r", p), F.lit(1.0))
    return found.select(*df.columns, density.alias("density"))


def neighbour_components(frames: DataFrame, *, k: int = 20, fraction: float = 0.5, least: int = 100, mutual: bool = True, x: str = "x") -> DataFrame:
    """``(row_id, group)``: components of the neighbour graph of the densest frames, of ``least`` frames or more, group 0 the largest.

    The densest frames are those that hold ``fraction`` of the weight, ``least``
    of them anyhow. Edges are mutual neighbours or, where there is no such
    pair at all, neighbours either way.
    """
    one = frames.withColumn("_all", F.lit(0).cast("long"))
    if fraction < 1:
        one = materialize(weighted_core(neighbour_density(one, k, x), fraction, by="_all", least=least).where("core").select(*one.columns))
    near = materialize(nearest(one, k, x).select("row_id", F.explode("ids").alias("id")))
    pairs = near.select(F.least("row_id", "id").alias("a"), F.greatest("row_id", "id").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    both = pairs.where("n > 1")
    edges = both if mutual and not both.isEmpty() else pairs
    found = connected_components(edges).withColumnRenamed("id", "row_id")
    named = materialize(one.select("row_id").join(found, "row_id", "left").select("row_id", F.coalesce("component", "row_id").alias("component")))
    large = named.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component")
    kept = named.join(large, "component", "left_semi")
    order = renumber_by_population(kept, "component").select(F.col("old").alias("component"), F.col("new").alias("group"))
    return kept.join(order, "component").select("row_id", "group")


def slow_embedding(t: np.ndarray, n_groups: int, slow: float = 0.8, most: int | None = None) -> np.ndarray | None:
    """[microstate, mode]: the right eigenvectors after the first, each scaled to mean 0 and deviation 1 over the microstates.

    As many as have an eigenvalue of ``slow`` or more, and at least one less
    than the groups; None for a single microstate.
    """
    values, vectors = np.linalg.eig(t)
    order = np.argsort(-np.abs(values), kind="stable")
    size, modes = np.minimum(np.abs(values[order]), 1.0), np.real(vectors[:, order])[:, 1:]
    wanted = max(int((size[1:] >= slow).sum()), n_groups - 1, 1)
    modes = modes[:, : min(wanted, modes.shape[1] if most is None else most)]
    if not modes.size:
        return None
    deviation = modes.std(0)
    return (modes - modes.mean(0)) / np.where(deviation < 1e-12, 1.0, deviation)


def _looked_up(df: DataFrame, values: list, key: str, out: str) -> DataFrame:
    """A column from a literal table indexed by ``key``; the tables have a row a microstate."""
    table = F.array(*(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in values))
    return df.withColumn(out, F.get(table, F.col(key)))


def _statistics(named: DataFrame, frames: DataFrame, extra: dict) -> list[dict]:
    rows = named.join(frames, "row_id").groupBy("group").agg(F.count("*").alias("n_frames"), F.sum("weight").alias("population"), F.avg("entropy").alias("mean_entropy"), F.avg("q_max").alias("mean_q_max"), F.mode("q_argmax", True).alias("dominant"))
    return [{**r.asDict(), **extra} for r in rows.orderBy("group").collect()]


def candidate_groups(df: DataFrame, candidates: DataFrame, s, x: str = "x") -> tuple[DataFrame, list[dict]]:  # noqa: ANN001
    """``(row_id, group)`` of the frames that become new states, and a row of statistics for each group, group 0 the most populous before its core is taken.

    Microstates are fitted on at most ``most_fitted`` seeded frames; every
    candidate is assigned. Their transitions at the largest lag give the
    number of groups by eigengap and, by the slow eigenvectors, the groups.
    Each keeps its dense core, ``core_fraction`` of its weight, by the density
    in the space of the slow modes (or, by ``core_space='features'``, of
    ``x``); one of fewer than ``least_frames`` frames, before or after, is no
    group. Where the eigenvectors separate fewer groups than the eigenvalues
    ask for, the features are clustered instead. With too few frames for two
    microstates, fewer than ``least_pairs`` lag pairs, or no group left,
    components of the neighbour graph take over unless ``fall_back`` is off.
    Each row of statistics names its ``method``: kinetic, features or graph.
    """
    frames = materialize(df.join(candidates.select("row_id"), "row_id", "left_semi").select("row_id", "traj_id", "frame", "weight", "q_argmax", "q_max", "entropy", x))
    none = frames.limit(0).select("row_id", F.lit(0).alias("group"))
    n = frames.count()
    if n < s.least_frames:
        return none, []

    def by_graph() -> tuple[DataFrame, list[dict]]:
        if not s.fall_back:
            return none, []
        named = materialize(neighbour_components(frames, k=s.density_k, fraction=s.graph_fraction, least=s.least_frames, x=x))
        return named, _statistics(named, frames, {"method": "graph"})

    chosen = frames
    if s.cluster_fraction < 1 and n > s.least_frames:
        dense = neighbour_density(frames.withColumn("_all", F.lit(0).cast("long")), s.density_k, x)
        chosen = materialize(weighted_core(dense, s.cluster_fraction, by="_all", least=s.least_frames).where("core").select(*frames.columns))
        n = chosen.count()
    n_micro = K.microstate_count(n, target=200, least=6, most=50)
    if n_micro < 2:
        return by_graph()
    fit = weighted_sample(chosen.withColumn("weight", F.lit(1.0)), s.most_fitted, seed=s.seed).select("row_id", x).orderBy("row_id").collect()
    points = np.array([r[1] for r in fit], float)
    _, centers = K.lloyd(points, n_micro, np.random.default_rng(s.seed), starts=2)
    cells = materialize(nearest_centers(chosen, centers, x).drop("dist2"))
    counts = {lag: np.zeros((n_micro, n_micro)) for lag in s.lags}
    seen = dict.fromkeys(s.lags, 0)
    for r in count_matrix(keyed_pairs(cells.select("traj_id", "frame", "weight", "cell"), s.lags, ["cell"]), origin="cell", target="cell_tau").collect():
        counts[r["lag"]][r["i"], r["j"]] = r["count"]
        seen[r["lag"]] += r["n_pairs"]
    if seen[s.lags[-1]] < s.least_pairs:
        return by_graph()
    t = K.transition(counts[s.lags[-1]], pseudocount=1e-6, inactive="uniform")
    k, why = K.suggest_groups(K.spectrum(t).tolist())
    of_micro = K.spectral_memberships(t, k, s.seed).argmax(1) if k > 1 else np.zeros(n_micro, int)
    if len(set(of_micro.tolist())) == k:
        method, grouped = "kinetic", _looked_up(cells, of_micro.tolist(), "cell", "_group")
    else:
        method = "features"
        _, middle = K.lloyd(points, min(k, len(np.unique(points, axis=0))), np.random.default_rng(s.seed))
        grouped = nearest_centers(cells, middle, x, label="_group").drop("dist2")
    order = renumber_by_population(grouped, "_group").collect()
    new = [-1] * (1 + max(r["old"] for r in order))
    for r in order:
        new[r["old"]] = r["new"]
    grouped = _looked_up(grouped, new, "_group", "group").drop("_group")
    kept = [r["new"] for r in order if r["n_frames"] >= s.least_frames]
    part = materialize(grouped.where(F.col("group").isin(kept)))
    modes = slow_embedding(t, len(order)) if s.core_space == "slow" else None
    space = _looked_up(part, modes.tolist(), "cell", "_at") if modes is not None else part.withColumn("_at", F.col(x))
    if s.core_fraction < 1:
        dense = neighbour_density(space, s.density_k, "_at", by="group")
        space = weighted_core(dense, s.core_fraction, by="group", least=math.ceil(s.core_fraction * s.least_frames)).where("core")
    named = materialize(space.select("row_id", "group"))
    large = named.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") >= s.least_frames)
    named = materialize(named.join(F.broadcast(large.select("group")), "group", "left_semi").select("row_id", "group"))
    if named.isEmpty():
        return by_graph()
    rows = _statistics(named, frames, {"method": method, "n_groups": k, "why": why, "modes": 0 if modes is None else modes.shape[1]})
    if method == "kinetic":
        member = np.eye(len(new))[[new[g] for g in of_micro]]
        macro = {lag: member.T @ c @ member for lag, c in counts.items()}
        rows = [{**r, **{f"retention_{lag}": K.own_share(m, r["group"]) for lag, m in macro.items()}} for r in rows]
    return named, rows
