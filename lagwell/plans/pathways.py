"""Pathways between two states, diagnostics in one call, and small resolvers around them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.functions import kinetics as K
from lagwell.operators import diagnose as D
from lagwell.operators import fields as B
from lagwell.operators import model as M
from lagwell.operators import paths as Q


def resolve_periods(config: dict, n: int) -> list[float]:
    """Explicit periods, or flags times one period; 0 where an axis is open."""
    periods = config.get("periods")
    if periods is None:
        flags, p = config.get("periodic", False), float(config.get("period", 360.0))
        flags = [flags] * n if isinstance(flags, bool) else list(flags)
        periods = [p if f else 0.0 for f in flags]
    if len(periods) != n:
        raise ValueError(f"{len(periods)} periods for {n} axes")
    return [float(x or 0) for x in periods]


def wrap_bounds(periods: Sequence[float]) -> list[tuple[float, float] | None]:
    return [(-p / 2, p / 2) if p > 0 else None for p in periods]


def thinned(df: DataFrame, most: int, order: str = "row_id") -> DataFrame:
    """At most ``most`` rows at even ranks of an order of the row ids' hash: a sample for plots, by name and purpose."""
    n = df.count()
    if n <= most:
        return df
    return df.orderBy(F.xxhash64(order), order).limit(most)


def channel_from_grid(selected: DataFrame, points: str = "x") -> DataFrame:
    """Selected grid centers ``(cell, x, mass)`` as start points with density weight."""
    return selected.select(F.col("cell").cast("long").alias("path_id"), points, F.col("mass").alias("weight"))


def gradient_paths(frames: DataFrame, net, i: int, j: int, *, threshold: float = 0.1, starts: int = 100, max_steps: int = 300, n_images: int = 50, cutoff: float = 0.25, least_share: float = 0.0, periods: Sequence[float] | None = None, seed: int = 0, shooting: Q.Shooting | None = None, ends: tuple[Sequence[float] | None, Sequence[float] | None] = (None, None)) -> dict:  # noqa: ANN001
    """Channel points of i and j, a leg to each, stitched, clustered; clusters under the least share of starts are left out.

    ``shooting`` tells how legs move and stop, ``ends`` where paths begin and
    end in any case. Returns the paths and the clusters by weight, with each
    cluster's center path.
    """
    chosen = Q.channel_points(frames, i, j, threshold, most=starts, seed=seed).select(F.col("row_id").alias("path_id"), "x", "weight")
    how = shooting or Q.Shooting(max_steps=max_steps)
    # with expansion, each leg stops in its own basin, which is that end of the path
    legs = [Q.shoot(chosen, net, s, how, **({"basin": tuple(e)} if how.expansion and e is not None else {})).withColumn("leg", F.lit(k)) for k, (s, e) in enumerate(zip((i, j), ends, strict=True))]
    paths = Q.stitch(legs[0].unionByName(legs[1]).select("path_id", "leg", "image_id", "x"), n_images, ends=ends, periods=periods)
    weights = {r["path_id"]: r["weight"] for r in chosen.select("path_id", "weight").collect()}
    clusters, merges = Q.cluster_paths(paths, weights, cutoff, periods) if weights else ([], [])
    least = int(np.ceil(least_share * starts))
    kept = [c for c in clusters if len(c) >= least]
    spark = frames.sparkSession
    member = spark.createDataFrame([(p, k, float(weights[p])) for k, c in enumerate(kept) for p in c], "path_id long, cluster int, weight double")
    return {"paths": paths, "members": member, "clusters": kept, "merges": merges, "centers": Q.center_path(paths.join(F.broadcast(member), "path_id"))}


def state_pairs(p_jump: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs to run, the most probable first."""
    n = len(p_jump)
    found = [(max(p_jump[i, j], p_jump[j, i]), i, j) for i in range(n) for j in range(i + 1, n)]
    return [(i, j) for p, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])) if p > threshold]


def path_scores(images: DataFrame, net, i: int, j: int) -> DataFrame:  # noqa: ANN001
    """q and q_i q_j of every image."""
    q = M.infer(images.select("path_id", "image_id", "x"), net)
    return q.withColumn("channel", F.get("q", F.lit(i)) * F.get("q", F.lit(j)))


def field_centers(frames: DataFrame, axes: Sequence[tuple[str, float, float, int]], i: int, j: int, *, sigma: float = 1.0, threshold: float = 0.05, most: int = 6, seed: int = 0) -> dict:
    """Density grid smoothed, free energy, channel field above a threshold, clustered with the count at the knee; the best bin of each cluster."""
    product = F.get("q", F.lit(i)) * F.get("q", F.lit(j))
    field = B.weighted_mean_field(frames, axes, product)
    shape = [a[3] for a in axes]
    density, channel = np.zeros(shape), np.zeros(shape)
    for r in field.collect():
        at = tuple(r[f"b{k}"] for k in range(len(axes)))
        density[at], channel[at] = r["mass"], r["mean"] or 0.0
    density = B.smooth(density, [sigma] * len(axes), [False] * len(axes))
    bins = np.argwhere(channel > threshold)
    centers = np.array([[lo + (b + 0.5) * (hi - lo) / n for b, (_, lo, hi, n) in zip(x, axes, strict=True)] for x in bins])
    with np.errstate(divide="ignore"):
        energy = -np.log(density / density.max()) if density.max() > 0 else np.zeros(shape)
    if not len(bins):
        return {"density": density, "free_energy": energy, "channel": channel, "centers": centers}
    rng = np.random.default_rng(seed)
    w = np.maximum(density[tuple(bins.T)], 1e-12)
    fits = [K.lloyd(centers, k, rng, w, starts=5) for k in range(1, min(most, len(bins)) + 1)]
    cost = [float((w * ((centers - c[lab]) ** 2).sum(1)).sum()) for lab, c in fits]
    labels = fits[K.knee(cost)][0]
    score = channel[tuple(bins.T)]
    best = [int(np.flatnonzero(labels == k)[score[labels == k].argmax()]) for k in np.unique(labels)]
    return {"density": density, "free_energy": energy, "channel": channel, "centers": centers[best], "labels": labels}


def diagnose_labels(frames: DataFrame, lags: Sequence[int]) -> dict[str, DataFrame]:
    """All label diagnostics of frames with q, in the order in which they build on each other."""
    scored = D.lagged_scores(D.scores(frames), lags)
    classed = scored.withColumn("class", D.uncertainty_class())
    return {
        "frames": classed,
        "states": D.state_statistics(classed),
        "hints": D.relabel_hints(classed),
        "kinetics": D.label_kinetics(frames, lags),
        "boundary": D.boundary_summary(scored),
        "consistency": D.consistent_states(scored),
    }
