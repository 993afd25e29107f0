"""Stages end to end: MSM and cores, rates, relabelling, and their dispatcher."""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence
from dataclasses import fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwell.functions import kinetics as K
from lagwell.operators import cluster as C
from lagwell.operators import counting as N
from lagwell.operators import flux as X
from lagwell.operators import lag as L
from lagwell.operators.cores import CoreSettings, label_cores
from lagwell.operators.frames import frame_table
from lagwell.sinks.writers import content_hash, manifest_hash, msm_summary, rate_table, stage_table

#: Stages in order and the names they answer to.
STAGES = {
    "0": ("msm", "msm_core_label", "corelabel", "label"),
    "1": ("committor", "committor_vector", "rates"),
    "2": ("gradpath", "pathways"),
    "3": ("relabel",),
}
SUBSTEPS = {
    "0": ("data", "cluster", "msm", "pcca", "core", "summary"),
    "1": ("train", "infer", "rate_constant"),
    "2": ("select", "shoot", "cluster", "voronoi"),
    "3": ("diagnostics", "relabel_entropy", "relabel_gini", "rate_merge"),
}


def canonical_stage(name: str) -> str:
    n = str(name).strip().lower()
    for key, aliases in STAGES.items():
        if n == key or n in aliases:
            return key
    raise ValueError(f"unknown stage {name!r}; known: {', '.join(STAGES)} and {', '.join(a for v in STAGES.values() for a in v)}")


def substeps(stage: str, chosen: str | Sequence[str] | None) -> list[str]:
    """The substeps up to a named one, or the named list; unknown names are an error."""
    every = SUBSTEPS[canonical_stage(stage)]
    names = list(every) if chosen is None else [chosen] if isinstance(chosen, str) else list(chosen)
    for n in names:
        if n not in every:
            raise ValueError(f"unknown substep {n!r} of stage {stage}; known: {', '.join(every)}")
    return names


def force_plan(config: dict, target: str, force: bool, *, reuse_upstream: bool = True) -> list[tuple[str, bool]]:
    """(substep, forced) up to the target; only the target is forced, upstream stages are reused. The configuration is not changed."""
    steps = SUBSTEPS["0"]
    if target not in steps:
        raise ValueError(f"unknown target {target!r}")
    cfg = copy.deepcopy(config)
    force = force or bool(cfg.get("force", False))
    return [(s, force if s == target or not reuse_upstream else False) for s in steps[: steps.index(target) + 1]]


def run_msm(frames: DataFrame, cfg: dict, folder: str, target: str = "summary", force: bool = False) -> dict[str, DataFrame]:
    """Frame table, microstates, counts and T, macrostates, cores, summary; each a stage table with a manifest.

    ``cluster_sample`` rows fit the centers (all by default); with
    ``active_set`` only microstates that carry weight and both give and take
    counts stay; ``reversible`` symmetrises the counts before normalising.
    A manifest holds the hash of the one before it, the first one that of the
    frames, so changed frames or settings are never served old tables.
    ``core_<name>`` sets a field of :class:`CoreSettings`; the centers of the
    cores are written to ``core_centers`` beside the stages.
    """
    spark = frames.sparkSession
    k, lags, m = cfg.get("n_clusters", 20), list(cfg.get("lags", (1, 2, 5))), cfg.get("n_macro", 2)
    out: dict[str, DataFrame] = {}
    seed = cfg.get("seed", 0)

    def data() -> DataFrame:
        return frame_table(frames, discard_before=cfg.get("discard_before", 0), stride=cfg.get("stride", 1))

    def micro() -> DataFrame:
        return C.kmeans(out["data"], k, seed=seed, rounds=cfg.get("rounds", 100), sample=cfg.get("cluster_sample"))[1].withColumnRenamed("cell", "micro").drop("dist2")

    def counts() -> DataFrame:
        table = out["cluster"].withColumn("state", F.col("micro"))
        counted = N.count_matrix(L.sequence_pairs(table, lags, ["state"]))
        if not cfg.get("active_set", False):
            return counted
        ends = counted.where(F.col("lag") == lags[0])
        both = ends.select(F.col("i").alias("state")).intersect(ends.select(F.col("j").alias("state")))
        return N.restrict(counted, N.active_states(table).join(both, "state"))

    def macro() -> DataFrame:
        rows = out["msm"].where(F.col("lag") == lags[0]).collect()
        n = 1 + max(max(r["i"], r["j"]) for r in rows)
        states = sorted({x for r in rows for x in (r["i"], r["j"])}) if cfg.get("active_set", False) else list(range(n))
        t = K.transition(K.dense(rows, n, "count")[np.ix_(states, states)], reversible=cfg.get("reversible", False))
        chi = K.simplex_memberships(t, m) if cfg.get("soft", False) else K.spectral_memberships(t, m, seed)
        return spark.createDataFrame([(i, int(a)) for i, a in zip(states, chi.argmax(1), strict=True)], "micro int, macro int")

    def core() -> DataFrame:
        labelled = out["cluster"].join(F.broadcast(out["pcca"]), "micro", "left").withColumn("macro", F.coalesce("macro", F.lit(-1)))
        chosen = {f.name: cfg[f"core_{f.name}"] for f in fields(CoreSettings) if f"core_{f.name}" in cfg}
        # names of earlier configurations
        chosen |= {"k": cfg["k"]} if "k" in cfg else {}
        chosen |= {"references": cfg["references"]} if "references" in cfg else {}
        frames_of, centers = label_cores(labelled, CoreSettings(**{"seed": seed, **chosen}))
        centers.write.mode("overwrite").parquet(f"{folder}/core_centers")
        return frames_of

    def summary() -> DataFrame:
        n = 1 + out["msm"].agg(F.max(F.greatest("i", "j"))).first()[0]
        t = N.transition_matrix(out["msm"], n, reversible=cfg.get("reversible", False))
        return msm_summary(t, N.residence_escape(t))

    makers: dict[str, Callable[[], DataFrame]] = {"data": data, "cluster": micro, "msm": counts, "pcca": macro, "core": core, "summary": summary}
    chain = content_hash(frames)
    for step, forced in force_plan(cfg, target, force):
        manifest = {"step": step, "upstream": chain, **{a: b for a, b in cfg.items() if a != "force"}}
        out[step] = stage_table(makers[step], spark, f"{folder}/{step}", manifest, forced)
        chain = manifest_hash(manifest)
    return out


def rate_matrices(frames: DataFrame, n_states: int, lag: int, *, at: Sequence[float] | None = None, eps: float = 0.02, blocks: int = 10, edge_filter: dict | None = None) -> dict:
    """From frames with q: flux, populations, hits, direct rates and their errors, generator, jump probabilities, passage times."""
    at = list(at or X.thresholds())
    chosen = X.ordered_pairs(n_states)
    pairs = L.positive_pairs(L.positional_pairs(frames, lag, ["q", "state", "weight"]))
    flux = {(r["i"], r["j"]): r for r in X.pair_flux(X.flux_profiles(pairs, chosen, at, eps=eps, tau=float(lag))).collect()}
    pi = np.zeros(n_states)
    for r in N.populations(frames.where("weight > 0"), weight="weight").collect():
        if r["state"] < n_states:
            pi[r["state"]] = r["pi"]
    jack = {(r["i"], r["j"]): r["flux_jackknife"] / lag for r in X.jackknife_flux(pairs, chosen, at, blocks, eps=eps).collect()}
    j, j_std = np.zeros((n_states, n_states)), np.zeros((n_states, n_states))
    for (a, b), r in flux.items():
        j[a, b], j_std[a, b] = r["flux"], jack.get((a, b)) or 0.0
    k_direct = np.divide(j, pi[:, None], out=np.full_like(j, np.nan), where=pi[:, None] > 0)
    clean = K.sanitise(np.nan_to_num(k_direct))
    std = K.rate_error(clean, j_std, np.maximum(pi, 1e-300), np.zeros(n_states))
    clean, dropped = K.filter_edges(clean, K.jump_probabilities(clean), std, **(edge_filter or {}))
    gen = K.generator(clean)
    mfpt, k_mfpt = K.passage_times(gen), K.passage_rates(gen)
    return {"pi": pi, "J": j, "k_direct": clean, "k_std": std, "K": gen, "P_jump": K.jump_probabilities(gen), "MFPT": mfpt, "k_mfpt": k_mfpt, "errors": K.propagate_std(clean, std), "edge_filter": dropped, "table": rate_table(clean, mfpt, k_mfpt, K.jump_probabilities(gen), std)}


def run_stage(stage: str, spark: SparkSession, config: dict, handlers: dict[str, Callable[[SparkSession, dict, str], object]], substep: str | None = None) -> dict[str, object]:
    """Run a stage's substeps (or ``all`` stages in order) with the given handlers; unknown names and substeps without a handler fail before anything runs."""
    chosen = list(STAGES) if stage == "all" else [canonical_stage(stage)]
    section = {key: next((config[a] for a in (key, *STAGES[key]) if isinstance(config.get(a), dict)), config) for key in chosen}
    steps = {key: substeps(key, substep if stage != "all" and substep else section[key].get("substep")) for key in chosen}
    if missing := [f"{key}.{s}" for key in chosen for s in steps[key] if f"{key}.{s}" not in handlers]:
        raise ValueError(f"no handler for {', '.join(missing)}")
    done = {key: {s: handlers[f"{key}.{s}"](spark, section[key], s) for s in steps[key]} for key in chosen}
    return done if stage == "all" else done[chosen[0]]
