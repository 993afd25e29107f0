"""Reweighting of trajectory segments, tolerance matching, internal coordinates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.functions import kinetics as K
from lagwell.operators.cluster import distances
from lagwell.operators.frames import quantised_key
from lagwell.plans.lineage import discard, materialize


def reweight_segments(segments: DataFrame, n_clusters: int, *, rounds: int = 100, tol: float = 1e-4, window: int = 5, average_last: int = 10, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """Weights of segments ``(row_id, x, x_tau)`` that make their cluster populations stationary.

    Each round: random rows as centers, the weighted transition matrix of
    segment ends, its stationary distribution, and weights scaled by
    distribution over cluster weight, normalised. A round shuffles only
    cluster-pair sums; weights of the last rounds are averaged. Stops when the
    L1 change of the cluster populations stays below ``tol`` for ``window``
    rounds. Returns ``(row_id, weight)`` and the changes.
    """
    held = materialize(segments.select("row_id", "x", "x_tau"))
    n = held.count()
    weight = held.select("row_id", F.lit(1.0 / max(n, 1)).alias("weight"))
    history: list[float] = []
    kept: list[DataFrame] = []
    for step in range(rounds):
        drawn = held.orderBy(F.xxhash64("row_id", F.lit(seed * 100_003 + step)), "row_id").limit(n_clusters).select("x").collect()
        centers = np.array([r[0] for r in drawn], float)

        def assign(batches: Iterator[pd.DataFrame], centers: np.ndarray = centers) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    a, t = (distances(np.array(b[c].tolist(), float), centers).argmin(1) for c in ("x", "x_tau"))
                    yield pd.DataFrame({"row_id": b.row_id, "i": a, "j": t})

        cells = held.mapInPandas(assign, "row_id long, i int, j int").join(weight, "row_id")
        rows = cells.groupBy("i", "j").agg(F.sum("weight").alias("w")).collect()
        c = np.zeros((len(centers), len(centers)))
        for r in rows:
            c[r["i"], r["j"]] = r["w"]
        mass = c.sum(1)
        t = np.where(mass[:, None] > 0, c / np.maximum(mass, 1e-300)[:, None], np.eye(len(c)))
        pi = K.stationary(t)
        factor = pi / (mass + 1e-15)
        total = float((mass * factor).sum())
        if total < 1e-12:  # everything flows to a cluster without weight: this round's centers say nothing
            factor, total = np.ones(len(c)), float(mass.sum())
        scale = held.sparkSession.createDataFrame([(k, float(f / total)) for k, f in enumerate(factor)], "i int, f double")
        weight = cells.join(F.broadcast(scale), "i").select("row_id", (F.col("weight") * F.col("f")).alias("weight"))
        weight = materialize(weight)  # one round of lineage at most
        history.append(float(np.abs(mass * factor / total - mass).sum()))
        if len(kept) == average_last:
            discard(kept[0])
        kept = [*kept, weight][-average_last:]
        if len(history) >= window and max(history[-window:]) < tol:
            break
    every = kept[0]
    for k in kept[1:]:
        every = every.unionByName(k)
    return every.groupBy("row_id").agg((F.sum("weight") / len(kept)).alias("weight")), history


def frame_weights(segments: DataFrame) -> DataFrame:
    """Per frame the mean weight of the segments that cover it; segments hold ``traj_id first last weight``."""
    long = segments.select("traj_id", "weight", F.explode(F.sequence("first", "last")).alias("frame"))
    return long.groupBy("traj_id", "frame").agg(F.avg("weight").alias("weight"))


def tolerance_match(targets: DataFrame, sources: DataFrame, columns: Sequence[str], tolerance: float) -> DataFrame:
    """One-to-one matches ``(target_id, source_id, gap)`` within a tolerance in every column.

    Rows meet in equal quantised keys only. Within a bucket sources go in
    order of id, each to the nearest target (largest difference, then id) that
    is still free. A bucket is a group of near-equal points.
    """
    key = quantised_key(columns, tolerance)
    a = targets.select(key.alias("key"), F.col("row_id").alias("target_id"), *(F.col(c).alias(f"t_{c}") for c in columns))
    b = sources.select(key.alias("key"), F.col("row_id").alias("source_id"), *(F.col(c).alias(f"s_{c}") for c in columns))
    gap = F.greatest(*(F.abs(F.col(f"t_{c}") - F.col(f"s_{c}")) for c in columns), F.lit(0.0))
    near = a.join(b, "key").withColumn("gap", gap).where(F.col("gap") <= tolerance).select(F.hash("key").alias("bucket"), "target_id", "source_id", "gap")

    def greedy(g: pd.DataFrame) -> pd.DataFrame:
        used_t, used_s, out = set(), set(), []
        for r in g.sort_values(["source_id", "gap", "target_id"]).itertuples():
            if r.source_id not in used_s and r.target_id not in used_t:
                used_s.add(r.source_id)
                used_t.add(r.target_id)
                out.append((r.target_id, r.source_id, r.gap))
        return pd.DataFrame(out, columns=["target_id", "source_id", "gap"])

    return near.groupBy("bucket").applyInPandas(greedy, "target_id long, source_id long, gap double")


def internal_coordinates(xyz: np.ndarray) -> np.ndarray:
    """Bonds, sine and cosine of angles and of dihedrals along a chain of atoms; ``xyz`` is [frames, atoms, 3]."""
    bond = np.diff(xyz, axis=1)
    length = np.linalg.norm(bond, axis=2)
    parts = [length]
    if xyz.shape[1] > 2:
        u, v = -bond[:, :-1], bond[:, 1:]
        cos = np.clip((u * v).sum(2) / np.maximum(length[:, :-1] * length[:, 1:], 1e-300), -1, 1)
        parts += [np.sqrt(1 - cos**2), cos]
    if xyz.shape[1] > 3:
        n1, n2 = np.cross(bond[:, :-2], bond[:, 1:-1]), np.cross(bond[:, 1:-1], bond[:, 2:])
        axis = bond[:, 1:-1] / np.maximum(length[:, 1:-1, None], 1e-300)
        x, y = (n1 * n2).sum(2), (np.cross(n1, n2) * axis).sum(2)
        r = np.maximum(np.hypot(x, y), 1e-300)
        parts += [y / r, x / r]
    return np.concatenate(parts, axis=1)


def with_internal_coordinates(df: DataFrame, xyz: str = "xyz", out: str = "x") -> DataFrame:
    """Add the internal coordinates of ``array<double>`` atom positions (x, y, z by turns)."""
    schema = df.withColumn(out, F.array(F.lit(0.0))).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = np.array(b[xyz].tolist(), float)
                yield b.assign(**{out: list(internal_coordinates(m.reshape(len(m), -1, 3)))})

    return df.mapInPandas(run, schema)


def split_by_components(df: DataFrame, components: DataFrame, exchange: DataFrame, cutoff: float, next_label: int) -> DataFrame:
    """Labels whose components exchange at most the cutoff at every lag are split: the largest component keeps the label.

    ``components`` holds ``row_id state component``; ``exchange`` per state and
    lag the largest off-diagonal transition.
    """
    from pyspark.sql import Window as W

    slow = exchange.groupBy("state").agg(F.min("max_exchange").alias("e")).where(F.col("e") <= cutoff).select("state")
    size = components.join(F.broadcast(slow), "state").groupBy("state", "component").agg(F.count("*").alias("n"))
    ranked = size.withColumn("r", F.row_number().over(W.partitionBy("state").orderBy(F.desc("n"), "component")))
    fresh = ranked.where("r > 1").withColumn("to", (F.row_number().over(W.orderBy("state", "r")) - 1 + next_label).cast("int")).select("state", "component", "to")
    moved = components.join(F.broadcast(fresh), ["state", "component"]).select("row_id", "to")
    return df.join(moved, "row_id", "left").withColumn("state", F.coalesce("to", "state")).drop("to")
