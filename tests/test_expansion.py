"""Paths pulled together by exchange: a plain twin of the rounds, periodic boxes, circles, limits, and a middle that stays shared."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lagwell.functions import kinetics as K
from lagwell.operators import expansion as X
from lagwell.operators import paths as Q


def samples_along(spark, curves, seed=1, n=900, noise=0.06, period=None):
    """Frames that wander along one of the curves, hopping to another now and then where they are near."""
    rng, rows, which, at = np.random.default_rng(seed), [], 0, 0.1
    for i in range(n):
        at = float(np.clip(at + rng.normal(0, 0.08), 0, 1))
        if rng.random() < 0.2:
            which = int(rng.integers(len(curves)))
        x = curves[which](at) + rng.normal(0, noise, 2)
        if period:
            x = np.mod(x + period / 2, period) - period / 2
        rows.append((i, i // 300, float(rng.integers(1, 4)), x.tolist()))
    return spark.createDataFrame(rows, "row_id long, traj_id long, weight double, x array<double>").repartition(4), rows


def shortest(d, box):
    return np.array([((v + p / 2) % p - p / 2) if p > 0 else v for v, p in zip(d, box.periods, strict=True)])


def slow_round(rows, paths, s, box, ends):
    """One round in loops over samples, nodes and images."""
    cell = {}
    for i, _, _, x in rows:
        for p, images in paths.items():
            cell[i, p] = min(range(len(images)), key=lambda k: (round(float((shortest(np.array(x) - images[k], box) ** 2).sum()), 12), k))
    nodes = [(p, k) for p in sorted(paths) for k in range(len(paths[p]))]
    counts = np.zeros((len(nodes), len(nodes)))
    whole = sum(r[2] for r in rows)
    inner = {n: s.margin <= n[1] < len(paths[n[0]]) - s.margin for n in nodes}
    for a, b in zip(rows, rows[s.lag :], strict=False):
        for p in paths:
            for q in paths:
                m, n = (p, cell[a[0], p]), (q, cell[b[0], q])
                if a[1] == b[1] and p != q and inner[m] and inner[n]:
                    w = 1.0 if s.weigh == "count" else a[2] / whole
                    counts[nodes.index(m), nodes.index(n)] += w
                    counts[nodes.index(n), nodes.index(m)] += w
    total, out = counts.sum(), {p: x.copy() for p, x in paths.items()}
    for i, (p, k) in enumerate(nodes):
        near = [j for j, (q, m) in enumerate(nodes) if counts[i, j] > 0 and counts[i, j] >= s.min_count and counts[i, j] / total >= s.min_probability and (s.max_distance is None or np.linalg.norm(shortest(paths[p][k] - paths[q][m], box)) <= s.max_distance)]
        if near and inner[p, k]:
            own = sum(counts[i, j] for j in near)
            move = sum(counts[i, j] * shortest(paths[nodes[j][0]][nodes[j][1]] - paths[p][k], box) for j in near) / (2 * own)
            out[p][k] = paths[p][k] + s.relaxation * move
    for p, x in out.items():
        line = [x[0]]
        for k in range(1, len(x)):
            line.append(line[-1] + shortest(x[k] - x[k - 1], box))
        for _ in range(s.smoothing):
            h = s.window // 2
            line = [line[0]] + [sum(line[min(max(k + o, 0), len(line) - 1)] for o in range(-h, h + 1)) / s.window for k in range(1, len(line) - 1)] + [line[-1]]
        arc = [0.0]
        for u, v in zip(line, line[1:], strict=False):
            arc.append(arc[-1] + math.dist(u, v))
        even = []
        for k in range(len(line)):
            t = arc[-1] * k / (len(line) - 1)
            j = min(max(sum(a <= t for a in arc) - 1, 0), len(arc) - 2)
            even.append(line[j] + (line[j + 1] - line[j]) * (t - arc[j]) / (arc[j + 1] - arc[j]))
        even[0], even[-1] = ends[p]
        out[p] = box.wrap(np.array(even))
    return counts, out


@pytest.mark.parametrize(
    ("settings", "period"),
    [
        ({"smoothing": 1, "window": 3}, None),
        ({"weigh": "weight", "min_count": 1e-4, "relaxation": 0.5, "smoothing": 0, "min_probability": 0.004}, None),
        ({"max_distance": 0.35, "smoothing": 2, "window": 3, "lag": 2}, 2.4),
    ],
)
def test_three_rounds_equal_a_plain_twin(spark, settings, period):
    shift = 0.9 if period else 0.0
    curves = [lambda t: np.array([2 * t - 1 + shift, 0.4 * math.sin(math.pi * t)]), lambda t: np.array([2 * t - 1 + shift, -0.4 * math.sin(math.pi * t)])]
    df, rows = samples_along(spark, curves, period=period)
    box = X.Box((period or 0.0, 0.0), (-1.2, None) if period else None)
    s = X.Expansion(rounds=3, tol=-1.0, **settings)
    start = {p: np.array([c(t) for t in np.linspace(0, 1, 9)]) for p, c in enumerate(curves)}
    done = X.expand(df, start, s, box)
    assert len(done) == 3
    current = done[0].paths
    ends = {p: x[[0, -1]].copy() for p, x in current.items()}
    for r in done:
        counts, fresh = slow_round(rows, current, s, box, ends)
        assert np.allclose(r.counts, counts) and all(np.allclose(box.delta(r.moved[p] - fresh[p]), 0, atol=1e-9) for p in fresh)
        current = r.moved


def test_a_common_middle_stays_shared(spark):
    """Two paths that part at both ends and run together in between: the middles come to lie on each other, the ends stay where they are."""
    curves = [lambda t: np.array([4 * t, 0.8 * (2 * t - 1) ** 4 + 0.15]), lambda t: np.array([4 * t, -0.8 * (2 * t - 1) ** 4 - 0.15])]
    df, _ = samples_along(spark, curves, n=1500, noise=0.1)
    start = {p: np.array([c(t) for t in np.linspace(0, 1, 13)]) for p, c in enumerate(curves)}
    done = X.expand(df, start, X.Expansion(rounds=6, max_distance=0.7, min_count=8, smoothing=1, window=3, relaxation=0.7))
    gap = lambda paths: np.linalg.norm(paths[0][4:9] - paths[1][4:9], axis=1).mean()
    assert gap(done[-1].moved) < 0.4 * gap(done[0].paths)
    assert all(np.allclose(done[-1].moved[p][[0, -1]], start[p][[0, -1]]) for p in start)
    middle = {n for segment in done[-1].shared.values() for n in segment}
    assert {(p, k) for p in (0, 1) for k in (5, 6, 7)} <= middle and not {(0, 0), (1, 0), (0, 12), (1, 12)} & middle


def test_circles_and_boxes():
    box = X.Box((360.0, 0.0), (-180.0, None))
    assert box.wrap(np.array([[190.0, 7.0], [-181.0, -9.0]])).tolist() == [[-170.0, 7.0], [179.0, -9.0]]
    path = np.array([[170.0, 0.0], [-175.0, 1.0], [-160.0, 2.0]])
    assert box.unwrap(path)[:, 0].tolist() == [170.0, 185.0, 200.0] and box.length(path) == pytest.approx(2 * math.hypot(15, 1))
    two = np.array([[175.0, 1.0], [-175.0, 3.0]])
    assert box.delta(box.mean(two, np.array([1.0, 1.0])) - np.array([180.0, 2.0])) == pytest.approx([0, 0])
    round_box = X.Box((360.0, 0.0), (-180.0, None), circular=True)
    assert box.delta(round_box.mean(two, np.array([1.0, 3.0])) - np.array([-177.5, 2.5])) == pytest.approx([0, 0], abs=1e-2)
    assert np.allclose(box.delta(round_box.project(round_box.embed(path)) - path), 0)
    even = round_box.wrap(X.spread(path, X.Expansion(n_images=5, smoothing=0), round_box))
    assert len(even) == 5 and np.allclose(box.delta(even[[0, -1]] - path[[0, -1]]), 0) and (np.abs(even[:, 0]) >= 160 - 1e-9).all()
    assert len(X.spread(path, X.Expansion(spacing=5.0), box)) == round(box.length(path) / 5)


def test_expansion_without_exchange_settles(spark):
    df = spark.createDataFrame([(i, 0, 1.0, [i / 10, 0.0]) for i in range(10)], "row_id long, traj_id long, weight double, x array<double>")
    done = X.expand(df, {0: np.array([[0.0, 0.0], [1.0, 0.0]])}, X.Expansion(n_images=4))
    assert len(done) == 2 and done[-1].shift <= 1e-9 and np.allclose(done[-1].moved[0][:, 0], [0, 1 / 3, 2 / 3, 1]) and not done[-1].shared
    with pytest.raises(ValueError, match="weigh"):
        X.Expansion(weigh="x")


@pytest.mark.parametrize("cutoff", [0.3, 0.8, 5.0])
def test_rounds_of_mutual_neighbours_are_average_linkage(spark, cutoff):
    """The same clusters, and the same distances of merges in order, as one merge at a time."""
    rng = np.random.default_rng(11)
    offsets = np.concatenate([rng.normal(c, 0.15, 6) for c in (0, 1, 3)] + [[9.0]])
    weights = {p: float(rng.integers(1, 5)) for p in range(len(offsets))}
    images = spark.createDataFrame([(p, k, [k / 4, float(o)]) for p, o in enumerate(offsets) for k in range(5)], "path_id long, image_id int, x array<double>")
    d = np.abs(offsets[:, None] - offsets) / math.sqrt(2)
    want, merges = K.average_linkage(d, np.array([weights[p] for p in range(len(offsets))]), cutoff)
    got, rounds = Q.cluster_paths(images, weights, cutoff)
    assert got == want and sorted(m[2] for m in rounds) == pytest.approx(sorted(m[2] for m in merges))


@pytest.mark.parametrize("rest", [0, 5])
def test_linkage_by_strips_and_in_one_task_agree(spark, monkeypatch, rest):
    """Blocks of three paths, rounds over Spark down to the rest, an image that one path lacks: the clusters of one merge at a time."""
    monkeypatch.setattr(Q, "PATHS", 3)
    monkeypatch.setattr(Q, "REST", rest)
    rng = np.random.default_rng(12)
    offsets = np.concatenate([rng.normal(c, 0.15, 4) for c in (0, 1)] + [[9.0]])
    weights = {10 * p: float(rng.integers(1, 5)) for p in range(len(offsets))}
    rows = [(10 * p, k, [k / 4, float(o)]) for p, o in enumerate(offsets) for k in range(5) if (p, k) != (2, 4)]
    images = spark.createDataFrame(rows, "path_id long, image_id int, x array<double>")
    want, merges = K.average_linkage(np.abs(offsets[:, None] - offsets) / math.sqrt(2), np.array(list(weights.values())), 0.8)
    got, rounds = Q.cluster_paths(images, weights, 0.8)
    assert got == [[10 * p for p in c] for c in want] and sorted(m[2] for m in rounds) == pytest.approx(sorted(m[2] for m in merges))
