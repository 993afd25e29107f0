"""Relabelling: propose new labels from confidence, density and kinetics, then merge by rates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwell.functions import kinetics as K
from lagwell.operators.candidates import candidate_groups
from lagwell.operators.cluster import keyed_kmeans
from lagwell.operators.diagnose import consistent_states, core_predicate, entropy_candidates, remove_states, scores
from lagwell.operators.lag import keyed_pairs
from lagwell.plans.lineage import materialize


@dataclass
class Settings:
    lags: tuple[int, ...] = (1, 2, 5)
    high_entropy: float = 0.6
    low_entropy: float = 0.3
    score: str = "entropy"  # or gini: the confidence that the proposal uses
    most_fitted: int = 20_000  # candidate frames that the microstates and densities are fitted on; all are assigned
    core_fraction: float = 0.5  # weight of each candidate group that its dense core holds
    core_space: str = "slow"  # or features: where the density of a group is taken
    cluster_fraction: float = 1.0  # weight of the densest candidates that are grouped at all
    graph_fraction: float = 0.5  # weight of the densest candidates whose neighbour graph is the fall-back
    density_k: int = 20
    fall_back: bool = True  # to components of the neighbour graph where kinetics says too little
    merge_cutoff: float = 0.05
    least_pairs: int = 50
    least_frames: int = 100
    seed: int = 0
    extra: dict = field(default_factory=dict)


ALIASES = {"lags": ("lags", "lag_list", "merge_lag_list"), "high_entropy": ("high_entropy", "entropy_threshold", "entropy_cutoff"), "low_entropy": ("low_entropy", "low_entropy_cutoff"), "merge_cutoff": ("merge_cutoff", "mixing_cutoff"), "least_pairs": ("least_pairs", "min_pairs", "min_valid_pairs"), "score": ("score", "method"), "seed": ("seed", "random_seed")}


def settings(config: dict) -> Settings:
    """From the compact ``analysis`` block, else legacy keys of ``relabel``, else defaults; lags may be a number or a list and must be positive."""
    found = Settings()
    for name, keys in ALIASES.items():
        for block in (config.get("analysis") or {}, config.get("relabel") or {}):
            hit = next((block[k] for k in keys if block.get(k) is not None), None)
            if hit is not None:
                setattr(found, name, hit)
                break
    lags = found.lags if isinstance(found.lags, (list, tuple)) else (found.lags,)
    found.lags = tuple(sorted({int(x) for x in lags}))
    if not found.lags or found.lags[0] < 1:
        raise ValueError("lags must be positive")
    return found


def label_counts(df: DataFrame, lags: Sequence[int], label: str = "state") -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """(weighted, raw) count matrices per lag; only state-by-state cells reach the driver."""
    pairs = keyed_pairs(df.select("row_id", "traj_id", "frame", "weight", label), lags, [label]).where(f"{label} >= 0 and {label}_tau >= 0 and weight > 0")
    rows = pairs.groupBy("lag", F.col(label).alias("i"), F.col(f"{label}_tau").alias("j")).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    n = 1 + max((max(r["i"], r["j"]) for r in rows), default=-1)
    weighted = {lag: np.zeros((n, n)) for lag in lags}
    raw = {lag: np.zeros((n, n)) for lag in lags}
    for r in rows:
        weighted[r["lag"]][r["i"], r["j"]] = r["w"]
        raw[r["lag"]][r["i"], r["j"]] = r["n"]
    return weighted, raw


def apply_map(df: DataFrame, mapping: dict[int, int], label: str = "state") -> DataFrame:
    """New labels from a driver map of old to new; labels not in it stay."""
    spark: SparkSession = df.sparkSession
    table = spark.createDataFrame(list(mapping.items()) or [(-2, -2)], "_old int, _new int")
    return df.join(F.broadcast(table), F.col(label) == F.col("_old"), "left").withColumn(label, F.coalesce("_new", label)).drop("_old", "_new")


def compacted(mapping: dict[int, int]) -> dict[int, int]:
    code = {v: k for k, v in enumerate(sorted({v for v in mapping.values() if v >= 0}))}
    return {k: code.get(v, -1) for k, v in mapping.items()}


def merge_duplicates(df: DataFrame, s: Settings, original: frozenset = frozenset()) -> tuple[DataFrame, dict[int, int]]:
    weighted, raw = label_counts(df, s.lags)
    mapping, _ = K.merge_mixed(weighted, cutoff=s.merge_cutoff, min_pairs=s.least_pairs, pairs=raw, original=original)
    return apply_map(df, mapping), mapping


def merge_by_rates(df: DataFrame, p: np.ndarray, mfpt: np.ndarray, min_probability: float, max_time: float, bidirectional: bool = False) -> tuple[DataFrame, dict[int, int]]:
    mapping, _, _ = K.merge_by_rates(p, mfpt, min_probability, max_time, bidirectional)
    return apply_map(df, mapping), mapping


def kinetic_groups(df: DataFrame, lags: Sequence[int], *, x: str = "x", least: int = 40, seed: int = 0, own_cut: float = 0.8, rounds: int = 25) -> DataFrame:
    """Kinetic groups inside each label: micro clusters of its core, their transitions at the first lag, groups by eigengap.

    All labels go together: k-means in rounds keyed by (label, center), lag
    pairs in one join, and only micro-by-micro counts reach the driver. A
    core of fewer than ``least`` frames is one group. Returns ``(row_id,
    state, group, n_groups, why)``, group 0 the largest.
    """
    core = materialize(df.where((F.col("state") >= 0) & core_predicate(own_cut)).select("row_id", "traj_id", "frame", "state", x))
    frames_of = {r["state"]: r["count"] for r in core.groupBy("state").count().collect()}
    sizes = {s: K.microstate_count(n) for s, n in frames_of.items() if n >= least}
    _, cells = keyed_kmeans(core, {s: k for s, k in sizes.items() if k}, x=x, rounds=rounds, seed=seed)
    cells = materialize(cells.select("row_id", "traj_id", "frame", "state", F.coalesce("cell", F.lit(0)).alias("cell")))
    pairs = keyed_pairs(cells, lags[:1], ["state", "cell"]).where("state = state_tau")
    counts = {s: np.zeros((k, k)) for s, k in sizes.items() if k}
    for r in pairs.groupBy("state", F.col("cell").alias("i"), F.col("cell_tau").alias("j")).count().collect():
        if r["state"] in counts:
            counts[r["state"]][r["i"], r["j"]] = r["count"]
    held = {s: np.zeros(max(1, sizes.get(s, 0))) for s in frames_of}
    for r in cells.groupBy("state", "cell").count().collect():
        held[r["state"]][r["cell"]] = r["count"]
    rows = []
    for s, n_frames in sorted(held.items()):
        k, why, groups = 1, "too few frames", np.zeros(len(n_frames), int)
        if s in counts:
            t = K.transition(counts[s], pseudocount=1e-6)
            k, why = K.suggest_groups(K.spectrum(t).tolist())
            groups = K.spectral_memberships(t, k, seed).argmax(1) if k > 1 else groups
        order = np.argsort(-np.bincount(groups, weights=n_frames, minlength=k), kind="stable")
        rank = np.argsort(order)
        rows += [(s, c, int(rank[g]), k, why) for c, g in enumerate(groups)]
    table = df.sparkSession.createDataFrame(rows, "state int, cell int, group int, n_groups int, why string")
    return cells.join(F.broadcast(table), ["state", "cell"]).select("row_id", "state", "group", "n_groups", "why")


def reshape(df: DataFrame, groups: DataFrame, next_label: int, least_frames: int = 100) -> DataFrame:
    """Group 0 keeps its label, further groups become new labels or -1 if small, frames of no group -1."""
    sizes = groups.where("group > 0").groupBy("state", "group").count()
    from pyspark.sql import Window as W

    fresh = sizes.where(F.col("count") >= least_frames).withColumn("to", (F.row_number().over(W.orderBy("state", "group")) - 1 + next_label).cast("int")).select("state", "group", "to")
    named = groups.join(F.broadcast(fresh), ["state", "group"], "left").select("row_id", F.when(F.col("group") == 0, F.col("state")).otherwise(F.coalesce("to", F.lit(-1))).alias("_new"))
    return df.join(named, "row_id", "left").withColumn("state", F.coalesce("_new", F.lit(-1))).drop("_new")


def propose(df: DataFrame, s: Settings) -> tuple[DataFrame, dict]:
    """Labels after removal of inconsistent states, unlabelling of uncertain frames and merging of fast-exchanging labels.

    Every candidate frame of a missing state joins a kinetic group, a new
    label each. ``gini`` replaces only the score of the proposal. Returns the
    frames with ``old_state`` and ``state`` and a summary.
    """
    scored = scores(df)
    if s.score == "gini":
        scored = scored.withColumn("entropy", 1 - F.col("gini"))
    judged = consistent_states(scored, high_entropy=s.high_entropy)
    kept = remove_states(scored.withColumn("old_state", F.col("state")), judged)
    unlabelled = kept.withColumn("state", F.when(F.col("entropy") >= s.high_entropy, -1).otherwise(F.col("state")))
    missing = entropy_candidates(scored, s.lags, s.high_entropy, s.low_entropy).where("kind = 'missing'")
    n_original = (df.agg(F.max("state")).first()[0] or 0) + 1
    groups, found = candidate_groups(scored, missing, s)
    fresh = groups.select("row_id", (F.lit(n_original) + F.col("group")).cast("int").alias("_fresh"))
    named = unlabelled.join(fresh, "row_id", "left").withColumn("state", F.coalesce("_fresh", "state")).drop("_fresh")
    merged, mapping = merge_duplicates(named, s, original=frozenset(range(n_original)))
    final = compacted({r[0]: r[0] for r in merged.select("state").distinct().collect()})
    return apply_map(merged, final), {"mapping": mapping, "final": final, "groups": found}
