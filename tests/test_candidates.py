"""New states among uncertain frames: slow modes against features, dense cores, the three ways back."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from lagwell.functions import kinetics as K
from lagwell.functions.committor import Net
from lagwell.operators import candidates as G
from lagwell.operators import cluster as C
from lagwell.operators import paths as Q
from lagwell.operators import relabel as R


KIND = "row_id long, traj_id int, frame int, weight double, q_argmax int, q_max double, entropy double, x array<double>"


def wells(spark, n_traj=6, length=120, dwell=60, stride=1):
    """Frames that stay ``dwell`` long in the well at 0 or the one at 5, in turn."""
    rng, rows = np.random.default_rng(3), []
    for t in range(n_traj):
        for f in range(length):
            well = (f // dwell + t) % 2
            rows.append((len(rows), t, f * stride, 1.0, int(well), 0.4, 0.9, [float(5 * well + rng.normal(0, 0.3)), float(rng.normal(0, 0.3))]))
    return spark.createDataFrame(rows, KIND)


def spirals(spark, n_traj=24, length=250):
    """Two arms wound into each other; a trajectory wanders along its arm, so the arms are the slow sets and every straight cut mixes them."""
    rng, rows = np.random.default_rng(8), []
    for t in range(n_traj):
        arm, at = t % 2, rng.uniform(0.5, 3.0)
        for f in range(length):
            at = float(np.clip(at + rng.normal(0, 0.8), 0.4, 3.2))
            angle = at * np.pi * 0.6 + arm * np.pi
            rows.append((len(rows), t, f, float(1 + f % 3), arm, 0.4, 0.9, [float(at * np.cos(angle) + rng.normal(0, 0.04)), float(at * np.sin(angle) + rng.normal(0, 0.04))]))
    return spark.createDataFrame(rows, KIND)


def purity(groups, df):
    """The share of frames whose group's commonest arm or well is their own."""
    n = Counter((r["group"], r["q_argmax"]) for r in groups.join(df, "row_id").select("group", "q_argmax").collect())
    return sum(max(v for (g, _), v in n.items() if g == one) for one in {g for g, _ in n}) / sum(n.values())


def test_groups_follow_slow_exchange(spark):
    df = wells(spark)
    whole, rows = G.candidate_groups(df, df, R.Settings(lags=(1, 2), core_fraction=1.0))
    assert whole.count() == 720 and len(rows) == 2 and purity(whole, df) == 1
    assert all(r["retention_2"] > 0.9 and r["n_groups"] == 2 and r["method"] == "kinetic" and r["modes"] >= 1 for r in rows)
    for space in ("slow", "features"):
        core, rows = G.candidate_groups(df, df, R.Settings(lags=(1, 2), core_space=space))
        assert 360 <= core.count() <= 364 and len(rows) == 2 and purity(core, df) == 1
    few, _ = G.candidate_groups(df, df, R.Settings(lags=(1, 2), cluster_fraction=0.5, core_fraction=1.0, least_frames=50))
    assert few.count() == 360
    # the other parts of the proposal take the frames as they come
    assert G.candidate_groups(df, df.limit(50), R.Settings())[1] == [] and G.candidate_groups(df, df.limit(0), R.Settings())[0].count() == 0


def test_slow_modes_tell_spirals_apart(spark):
    df = spirals(spark)
    s = R.Settings(lags=(1, 2), core_fraction=1.0)
    groups, rows = G.candidate_groups(df, df, s)
    assert rows[0]["method"] == "kinetic" and purity(groups, df) > 0.93
    cut = C.kmeans(df, 2, rounds=20)[1].withColumnRenamed("cell", "group").select("row_id", "group")
    assert purity(cut, df) < 0.8
    # cores taken among the slow modes and among the features are not the same frames
    slow, space = (set(r["row_id"] for r in G.candidate_groups(df, df, R.Settings(lags=(1, 2), core_space=c))[0].collect()) for c in ("slow", "features"))
    assert len(slow & space) < 0.9 * min(len(slow), len(space))


def test_too_few_pairs_fall_back_to_the_graph(spark):
    df = wells(spark, stride=7)
    groups, rows = G.candidate_groups(df, df, R.Settings(lags=(1, 2)))
    assert [r["method"] for r in rows] == ["graph", "graph"] and purity(groups, df) == 1 and 360 <= groups.count() <= 364
    assert G.candidate_groups(df, df, R.Settings(lags=(1, 2), fall_back=False))[1] == []


def test_too_few_microstates_and_small_cores_fall_back_to_the_graph(spark):
    df = wells(spark, n_traj=2, length=18, dwell=9)
    _, rows = G.candidate_groups(df, df, R.Settings(lags=(1, 2), least_frames=10, density_k=4, graph_fraction=1.0))
    assert {r["method"] for r in rows} == {"graph"} and sum(r["n_frames"] for r in rows) <= 36
    df = wells(spark)  # both groups have 360 frames, their cores 36
    _, rows = G.candidate_groups(df, df, R.Settings(lags=(1, 2), core_fraction=0.1, graph_fraction=0.6))
    assert {r["method"] for r in rows} == {"graph"}


def test_vectors_that_separate_too_little_fall_back_to_features(spark, monkeypatch):
    df = wells(spark)
    monkeypatch.setattr(K, "spectral_memberships", lambda t, k, seed=0: np.eye(k)[np.zeros(len(t), int)])
    groups, rows = G.candidate_groups(df, df, R.Settings(lags=(1, 2), core_fraction=1.0))
    assert {r["method"] for r in rows} == {"features"} and len(rows) == 2 and purity(groups, df) == 1


def test_neighbour_density_is_its_definition(spark):
    rng = np.random.default_rng(4)
    points, weight, group = rng.normal(size=(120, 3)), rng.uniform(-0.2, 2, 120), rng.integers(0, 2, 120)
    points[:7] = points[0]
    group[-1] = 5  # alone
    df = spark.createDataFrame([(i, p.tolist(), float(w), int(g)) for i, (p, w, g) in enumerate(zip(points, weight, group, strict=True))], "row_id long, x array<double>, weight double, s int")
    got = {r["row_id"]: r["density"] for r in G.neighbour_density(df, 6, by="s").collect()}
    w = np.maximum(weight, 0)
    for i in range(120):
        d = np.sqrt(((points - points[i]) ** 2).sum(1))
        others = sorted((d[j], j) for j in range(120) if j != i and group[j] == group[i])[:6]
        want = (w[i] + sum(w[j] for _, j in others)) / max(others[-1][0], 1e-12) ** 3 if others else w[i]
        assert got[i] == pytest.approx(want)
    flat = {r["row_id"]: r["density"] for r in G.neighbour_density(df, 6, power=0).collect()}
    assert all(v >= 0 for v in flat.values()) and len(flat) == 120


def test_slow_embedding():
    t = np.array([[0.98, 0.02, 0, 0], [0.02, 0.97, 0.01, 0], [0, 0.01, 0.5, 0.49], [0, 0, 0.49, 0.51]])
    e = G.slow_embedding(t, 2)
    assert e.shape[0] == 4 and np.allclose(e.mean(0), 0) and np.allclose(e.std(0), 1)
    assert e.shape[1] == int((np.sort(np.abs(np.linalg.eigvals(t)))[::-1][1:] >= 0.8).sum())
    assert G.slow_embedding(t, 4).shape[1] == 3 and G.slow_embedding(t, 4, most=1).shape[1] == 1 and G.slow_embedding(np.eye(1), 1) is None


# ---- groups inside labels ----------------------------------------------------------------


def slow_kmeans(points, first, rounds=25):
    centers = first.copy()
    for _ in range(rounds):
        own = ((points[:, None] - centers) ** 2).sum(2).argmin(1)
        fresh = np.array([points[own == k].mean(0) if (own == k).any() else centers[k] for k in range(len(centers))])
        done, centers = np.abs(fresh - centers).max() <= 1e-12, fresh
        if done:
            break
    return centers, ((points[:, None] - centers) ** 2).sum(2).argmin(1)


def test_keyed_kmeans_is_kmeans_of_each_group(spark):
    rng = np.random.default_rng(6)
    points, key = rng.normal(size=(500, 2)), rng.choice([0, 0, 0, 1, 4], 500)
    df = spark.createDataFrame([(i, int(s), p.tolist()) for i, (p, s) in enumerate(zip(points, key, strict=True))], "row_id long, state int, x array<double>").repartition(5)
    first, _ = C.keyed_kmeans(df, {0: 6, 1: 3}, rounds=0)
    centers, cells = C.keyed_kmeans(df, {0: 6, 1: 3})
    got = {r["row_id"]: r["cell"] for r in cells.collect()}
    assert set(centers) == {0, 1} and all(got[i] is None for i in np.flatnonzero(key == 4)) and len(got) == 500
    for s in (0, 1):
        mine = np.flatnonzero(key == s)
        want, own = slow_kmeans(points[mine], first[s])
        assert len(first[s]) == {0: 6, 1: 3}[s] and np.allclose(centers[s], want) and [got[i] for i in mine.tolist()] == own.tolist()
    assert C.keyed_kmeans(df, {})[1].where("cell is not null").isEmpty()


def test_kinetic_groups_of_all_labels_at_once(spark):
    """Label 0 hops between two wells that exchange slowly, label 1 has one well, label 2 too few frames."""
    rng, rows = np.random.default_rng(5), []
    for t in range(8):
        for f in range(150):
            well = (f // 75 + t) % 2
            rows.append((len(rows), t, f, 0, 0.9, 0, [float(6 * well + rng.normal(0, 0.3)), float(rng.normal(0, 0.3))], int(well)))
            rows.append((len(rows), 100 + t, f, 1, 0.9, 1, [float(rng.normal(0, 0.3)), float(9 + rng.normal(0, 0.3))], 2))
    rows += [(len(rows) + k, 200, k, 2, 0.9, 2, [20.0, 20.0], 3) for k in range(10)]
    df = spark.createDataFrame(rows, "row_id long, traj_id int, frame int, state int, q_own double, q_argmax int, x array<double>, well int")
    got = R.kinetic_groups(df, [1]).join(df.select("row_id", "well"), "row_id").collect()
    assert len(got) == len(rows) and {r["why"] for r in got if r["state"] == 2} == {"too few frames"}
    assert len({(r["group"], r["well"]) for r in got if r["state"] == 0}) == 2 and {r["n_groups"] for r in got if r["state"] == 0} == {2}
    assert {r["group"] for r in got if r["state"] == 1} == {0}


# ---- shooting ----------------------------------------------------------------------------


def images(paths):
    return {(r["path_id"], r["image_id"]): (np.array(r["x"]), np.array(r["q"])) for r in paths.collect()}


def test_noise_does_not_depend_on_the_partitioning(spark):
    net = Net((2, 8, 3))
    starts = spark.createDataFrame([(k, [0.01 * k, -0.02 * k]) for k in range(40)], "path_id long, x array<double>")
    runs = [images(Q.shoot(starts.repartition(n), net, 1, noise=0.4, max_steps=25, seed=7)) for n in (1, 3, 9)]
    assert all(r.keys() == runs[0].keys() for r in runs) and all(np.allclose(r[k][0], runs[0][k][0], atol=1e-9) for r in runs for k in r)
    other = images(Q.shoot(starts, net, 1, noise=0.4, max_steps=25, seed=8))
    assert any(not np.allclose(other[k][0], runs[0][k][0]) for k in other if k in runs[0] and k[1] > 0)
    z = Q.counter_normals(np.arange(20_000), 3, 3, 1)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs(np.corrcoef(z.T)[0, 1]) < 0.03
    assert not np.allclose(z, Q.counter_normals(np.arange(20_000), 4, 3, 1))


def slow_shoot(net, start, path_id, target, s):
    x, out = np.array(start, float), []
    for n in range(s.max_steps + 1):
        h = 1e-6
        q = net(x[None])[0]
        value = (lambda p: np.log(p / (1 - p))) if s.expansion else (lambda p: p)
        g = np.array([(value(net((x + h * e)[None])[0][target]) - value(net((x - h * e)[None])[0][target])) / (2 * h) for e in np.eye(len(x))])
        out.append(x.copy())
        if (s.expansion and s.basin is not None and np.linalg.norm(x - np.array(s.basin)) <= s.radius) or (not s.expansion and q[target] >= s.target_q):
            break
        step = g / np.linalg.norm(g) if s.normalize else g
        if s.noise:
            step = step + s.noise * Q.counter_normals(np.array([path_id]), n, len(x), s.seed)[0]
        x = x + s.step * step
        if s.periodic:
            x = np.array([s.low + (v - s.low) % (s.high - s.low) if p else v for v, p in zip(x, s.periodic, strict=True)])
    return out


@pytest.mark.parametrize(
    "how",
    [
        Q.Shooting(max_steps=15, noise=0.3, seed=2),
        Q.Shooting(max_steps=60, expansion=True, basin=(1.0, 0.5), radius=0.6),
        Q.Shooting(max_steps=20, normalize=False, step=0.5),
        Q.Shooting(max_steps=40, step=0.2, periodic=(True, False), low=-1.0, high=1.0),
        Q.Shooting(max_steps=10, expansion=True),
    ],
)
def test_shooting_equals_single_paths(spark, how):
    net = Net((2, 6, 2))
    starts = [(k + 3, [0.3 * k - 0.5, 0.2 - 0.1 * k]) for k in range(5)]
    got = images(Q.shoot(spark.createDataFrame(starts, "path_id long, x array<double>"), net, 0, how))
    for k, start in starts:
        want = slow_shoot(net, start, k, 0, how)
        mine = [got[k, n][0] for n in range(len(want))]
        assert (k, len(want)) not in got and np.allclose(mine, want, atol=1e-4)


def test_basins_and_ends(spark):
    with pytest.raises(ValueError, match="radius"):
        Q.Shooting(expansion=True, basin=(0.0,))
    with pytest.raises(ValueError, match="step"):
        Q.Shooting(step=0)
    legs = spark.createDataFrame([(0, leg, k, [150.0 + sign * 10 * k]) for leg, sign in ((0, -1), (1, 1)) for k in range(3)], "path_id long, leg int, image_id int, x array<double>")
    path = [r["x"][0] for r in Q.stitch(legs, 7, iterations=0, ends=((110.0,), (-170.0,)), periods=(360.0,)).orderBy("image_id").collect()]
    assert path == pytest.approx(np.linspace(110, 190, 7))
