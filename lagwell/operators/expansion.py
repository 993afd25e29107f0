"""Rounds that pull paths together where samples exchange between them.

A round assigns every sample to the nearest image of each path and counts
exchange between paths at a lag: that is the Spark job. What follows works on
a few hundred images: which nodes are shared, where each moves, and the paths
smoothed and spread evenly again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.operators.exchange import exchange_counts, path_cells, shared_nodes, shared_segments
from lagwell.operators.paths import _resample

Paths = dict[int, np.ndarray]


@dataclass(frozen=True)
class Box:
    """Periodic directions (period 0: none), the lower bound each wraps to (None: it does not), and whether means and curves are taken on circles or along the shortest copies."""

    periods: tuple[float, ...]
    low: tuple[float | None, ...] | None = None
    circular: bool = False

    @property
    def _p(self) -> np.ndarray:
        return np.asarray(self.periods, float)

    def delta(self, d: np.ndarray) -> np.ndarray:
        p = self._p
        safe = np.where(p > 0, p, 1.0)
        return np.where(p > 0, np.mod(d + safe / 2, safe) - safe / 2, d)

    def wrap(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return x
        out = x.copy()
        for k, (p, a) in enumerate(zip(self.periods, self.low, strict=True)):
            if p > 0 and a is not None:
                out[..., k] = a + np.mod(x[..., k] - a, p)
        return out

    def unwrap(self, path: np.ndarray) -> np.ndarray:
        return np.concatenate([path[:1], path[:1] + np.cumsum(self.delta(np.diff(path, axis=0)), axis=0)])

    def embed(self, x: np.ndarray) -> np.ndarray:
        """Periodic directions as points on circles of their circumference."""
        columns = []
        for k, p in enumerate(self.periods):
            turn = 2 * np.pi / p if p > 0 else 0.0
            columns += [np.sin(x[:, k] * turn) / turn, np.cos(x[:, k] * turn) / turn] if p > 0 else [x[:, k]]
        return np.stack(columns, 1)

    def project(self, e: np.ndarray) -> np.ndarray:
        columns, at = [], 0
        for p in self.periods:
            columns.append(np.arctan2(e[:, at], e[:, at + 1]) * p / (2 * np.pi) if p > 0 else e[:, at])
            at += 2 if p > 0 else 1
        return np.stack(columns, 1)

    def mean(self, points: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weighted mean of points, as the copy nearest to the first or on circles."""
        if self.circular:
            return self.project(np.average(self.embed(points), axis=0, weights=weights)[None])[0]
        return points[0] + np.average(self.delta(points - points[0]), axis=0, weights=weights)

    def length(self, path: np.ndarray) -> float:
        return float(np.linalg.norm(self.delta(np.diff(path, axis=0)), axis=1).sum())


@dataclass(frozen=True)
class Expansion:
    """``weigh`` counts exchange by samples (``count``) or by their share of all weight (``weight``). Edges need ``min_count``, the
    share ``min_probability`` of all exchange, and images at most ``max_distance`` apart; ``margin`` images at either end take no part
    and the ends stay. Nodes go ``relaxation`` of the way to the mean of themselves and their neighbours; curves are smoothed over
    ``window`` images ``smoothing`` times and get ``n_images``, one per ``spacing``, or as many as they had."""

    lag: int = 1
    margin: int = 1
    weigh: str = "count"
    min_count: float = 1.0
    min_probability: float = 0.0
    max_distance: float | None = None
    relaxation: float = 1.0
    rounds: int = 10
    tol: float = 1e-6
    n_images: int | None = None
    spacing: float | None = None
    smoothing: int = 2
    window: int = 5
    fixed_ends: bool = True

    def __post_init__(self) -> None:
        if self.weigh not in ("count", "weight"):
            raise ValueError("weigh is count or weight")


@dataclass
class Round:
    """The paths a round began with, what became of them, its exchange, the label of each node, the nodes shared by paths, and the largest move."""

    paths: Paths
    moved: Paths
    counts: np.ndarray
    labels: dict[tuple[int, int], int]
    shared: dict[int, list[tuple[int, int]]]
    shift: float


def node_order(paths: Paths) -> list[tuple[int, int]]:
    return [(p, k) for p in sorted(paths) for k in range(len(paths[p]))]


def count_exchange(samples: DataFrame, paths: Paths, s: Expansion, box: Box) -> np.ndarray:
    """[node, node] symmetric exchange between interior images of different paths."""
    nodes = {n: i for i, n in enumerate(node_order(paths))}
    weighed = samples.withColumn("weight", F.lit(1.0)) if s.weigh == "count" else samples
    periods = list(box.periods) if any(p > 0 for p in box.periods) else None
    out = np.zeros((len(nodes), len(nodes)))
    for r in exchange_counts(path_cells(weighed, paths, periods), {p: len(x) for p, x in paths.items()}, s.lag, s.margin).collect():
        out[nodes[r["path_a"], r["image_a"]], nodes[r["path_b"], r["image_b"]]] = r["count"]
    if s.weigh == "weight":
        out /= samples.agg(F.sum("weight")).first()[0] or 1.0
    return out


def accepted(counts: np.ndarray, points: np.ndarray, s: Expansion, box: Box) -> np.ndarray:
    """[node, node] mask of the edges that hold."""
    total = counts.sum()
    ok = (counts >= s.min_count) & (counts > 0) & (counts >= s.min_probability * total) & ~np.eye(len(counts), dtype=bool)
    if s.max_distance is not None:
        ok &= np.linalg.norm(box.delta(points[:, None] - points[None]), axis=2) <= s.max_distance
    return ok


def relaxed(paths: Paths, counts: np.ndarray, edges: np.ndarray, s: Expansion, box: Box) -> Paths:
    """Each interior node on its way to the mean of itself, weighing as much as all its edges, and its neighbours, weighing as theirs."""
    points = np.concatenate([paths[p] for p in sorted(paths)])
    out = {p: x.copy() for p, x in paths.items()}
    for i, (p, k) in enumerate(node_order(paths)):
        near = np.flatnonzero(edges[i])
        if not len(near) or k < s.margin or k >= len(paths[p]) - s.margin:
            continue
        pull = counts[i, near]
        center = box.mean(np.concatenate([points[i : i + 1], points[near]]), np.concatenate([[pull.sum()], pull]))
        out[p][k] = points[i] + s.relaxation * box.delta(center - points[i])
    return out


def spread(path: np.ndarray, s: Expansion, box: Box) -> np.ndarray:
    """The curve smoothed with its ends fixed, its images at equal arc lengths."""
    n = max(2, round(box.length(path) / s.spacing)) if s.spacing else s.n_images or len(path)
    curve = box.embed(path) if box.circular else box.unwrap(path)
    h = (s.window | 1) // 2
    for _ in range(s.smoothing if s.window > 1 and len(path) > 2 else 0):
        padded = np.pad(curve, ((h, h), (0, 0)), mode="edge")
        curve = np.concatenate([curve[:1], np.stack([padded[i : i + 2 * h + 1].mean(0) for i in range(1, len(curve) - 1)]), curve[-1:]])
    even = _resample(curve, n)
    return box.project(even) if box.circular else even


def expand(samples: DataFrame, paths: Paths, settings: Expansion | None = None, box: Box | None = None) -> list[Round]:
    """Rounds of assignment, exchange, shared nodes, relaxation and even spreading, until no image moves by more than ``tol``.

    ``samples`` holds a dense ``row_id``, ``traj_id``, ``weight`` and ``x``.
    """
    s = settings or Expansion()
    box = box or Box((0.0,) * next(iter(paths.values())).shape[1])
    bare = Expansion(**{**s.__dict__, "smoothing": 0})
    current = {p: box.wrap(spread(np.asarray(x, float), bare, box)) for p, x in paths.items()}
    ends = {p: x[[0, -1]].copy() for p, x in current.items()}
    done: list[Round] = []
    for _ in range(s.rounds):
        counts = count_exchange(samples, current, s, box)
        points, nodes = np.concatenate([current[p] for p in sorted(current)]), node_order(current)
        edges = accepted(counts, points, s, box)
        labels = shared_nodes([(nodes[i], nodes[j]) for i, j in np.argwhere(np.triu(edges))], nodes)
        fresh = {}
        for p, x in relaxed(current, counts, edges, s, box).items():
            x = spread(box.wrap(x), s, box)
            if s.fixed_ends:
                x[[0, -1]] = ends[p]
            fresh[p] = box.wrap(x)
        same = all(fresh[p].shape == current[p].shape for p in current)
        shift = max(float(np.linalg.norm(box.delta(fresh[p] - current[p]), axis=1).max()) for p in current) if same else float("inf")
        done.append(Round(current, fresh, counts, labels, shared_segments(labels), shift))
        current = fresh
        if len(done) > 1 and shift <= s.tol:
            break
    return done
