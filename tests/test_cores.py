"""Quantiles, ranks, neighbours and cores against plain definitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwell.operators import cluster as C
from lagwell.operators.cores import CoreSettings, label_cores, state_density
from lagwell.operators.neighbours import nearest, square_distances, visiting
from lagwell.operators.quantiles import exact_quantiles, ranked_within

# ---- quantiles and ranks -----------------------------------------------------------------


def values(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.normal(size=n), np.zeros(n // 2), np.full(7, 3.0), 10.0 ** rng.uniform(-300, 300, 50), [np.inf, -np.inf]])
    return [(int(i), None if i % 17 == 0 else int(i % 3) if i % 3 else None, float(x)) for i, x in enumerate(v)]


@pytest.mark.parametrize("leaf", [3, 20_000])
@pytest.mark.parametrize("by", [[], ["s"]])
def test_quantiles_are_percentiles(spark, by, leaf):
    """Also with ties that hold a third of the rows, NULL groups, infinite and far apart values, and ranges narrowed many times."""
    df = spark.createDataFrame(values(), "row_id int, s int, v double").repartition(5)
    df = df.union(df.limit(20).selectExpr("row_id", "s", "cast(null as double)"))
    ps = [0.0, 0.013, 0.25, 0.5, 0.8, 0.999, 1.0]
    want = {r["s"] if by else 0: r["q"] for r in df.groupBy(*by).agg(F.percentile("v", ps).alias("q")).collect()}
    got = {r["s"] if by else 0: r["quantiles"] for r in exact_quantiles(df, "v", ps, by, leaf=leaf, accuracy=50).collect()}
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k], equal_nan=True) for k in want)


def test_quantiles_of_little(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 3.0), (3, None)], "s int, v double")
    got = {r["s"]: r["quantiles"] for r in exact_quantiles(df, "v", [0.5], ["s"]).collect()}
    assert got == {1: [5.0], 2: [2.0]} and exact_quantiles(df.where("s = 3"), "v", [0.5]).count() == 0


def test_ranks_are_the_windows(spark):
    df = spark.createDataFrame([(i, None if i % 11 == 0 else i % 2 * (i % 5), i * 7 % 13, float(i % 4)) for i in range(2000)], "row_id int, s int, v int, weight double").repartition(6)
    got = ranked_within(df, ["s"], [F.desc("v"), F.col("row_id")], "weight")
    over, whole = W.partitionBy("s").orderBy(F.desc("v"), "row_id"), W.partitionBy("s")
    want = df.select("*", F.row_number().over(over).cast("long"), F.count("*").over(whole), F.coalesce(F.sum("weight").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), F.sum("weight").over(over.rowsBetween(W.unboundedPreceding, 0)), F.sum("weight").over(whole))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_sample_of_groups_is_the_largest_keys(spark):
    df = spark.createDataFrame([(i, i % 3, 1.0 + i % 5) for i in range(4000)], "row_id long, state int, weight double")
    u = (F.pmod(F.xxhash64("row_id", F.lit(4)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    over = W.partitionBy("state").orderBy(F.desc("_k"), "row_id")
    want = {r["row_id"] for r in df.withColumn("_k", F.ln(u) / F.col("weight")).withColumn("r", F.row_number().over(over)).where("r <= 9").collect()}
    got = C.weighted_sample(df, 9, seed=4, by=("state",))
    assert got.columns == df.columns and {r["row_id"] for r in got.collect()} == want


# ---- neighbours --------------------------------------------------------------------------


def cloud(kind, n, seed=2):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        c = rng.normal(size=(25, 3)) * 20
        return c[rng.integers(0, 25, n)] + rng.normal(size=(n, 3)) * 0.3
    if kind == "copies":  # a third is one point, the rest stands on a grid with many equal distances
        return np.concatenate([np.zeros((n // 3, 2)), rng.integers(0, 12, (n - n // 3, 2))]).astype(float)
    if kind == "line":
        return np.concatenate([np.linspace(0, 1, n - 1), [1e6]])[:, None]
    return rng.normal(size=(n, 12))


def brute(points, ids, group, k):
    out = {}
    for i in range(len(points)):
        d2 = square_distances(points[i : i + 1], points)[0]
        d2[(group != group[i]) | (ids == ids[i])] = np.inf
        order = np.lexsort((ids, d2))[:k]
        order = order[np.isfinite(d2[order])]
        out[int(ids[i])] = (ids[order].tolist(), np.sqrt(d2[order]).tolist())
    return out


@pytest.mark.parametrize("kind", ["clusters", "copies", "line", "wide"])
@pytest.mark.parametrize("by", [None, "s"])
def test_neighbours_equal_brute_force(spark, kind, by):
    points = cloud(kind, 900)
    rng = np.random.default_rng(7)
    ids, group = rng.permutation(5000)[: len(points)], rng.choice([0, 0, 0, 1, 2], len(points))
    group[:2] = 3  # fewer than k
    df = spark.createDataFrame([(int(i), p.tolist(), int(g)) for i, p, g in zip(ids, points, group, strict=True)], "row_id long, x array<double>, s int").repartition(4)
    got = {r["row_id"]: (r["ids"], r["dists"]) for r in nearest(df, 6, by=by, cell=40, block=64).collect()}
    want = brute(points, ids, group if by else np.zeros(len(points)), 6)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_clustered_rows_meet_few_others(spark):
    """The pairs compared grow with the rows and not with their square."""
    met = []
    for n in (2000, 8000):
        df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(cloud("clusters", n))], "row_id long, x array<double>")
        _, visitors, cells = visiting(df, 6, cell=100)
        pairs = sum(int(cells.count[list(r["cells"])].sum()) for r in visitors.collect())
        met.append(pairs / n)
    assert met[1] < 0.15 * 8000 and met[1] < 2 * met[0]
    assert nearest(df.limit(0), 3).count() == 0


# ---- cores -------------------------------------------------------------------------------


def lobes(seed=5):
    """Two macrostates of two lobes each, one lobe lighter, and rows without weight or state."""
    rng = np.random.default_rng(seed)
    rows = []
    for macro, lobe in ((0, (0, 0)), (0, (6, 0)), (1, (0, 30)), (1, (6, 30))):
        for _ in range(90 if lobe[0] else 130):
            rows.append((np.array(lobe) + rng.normal(size=2) * (0.5 if lobe[0] == 0 else 0.7), macro, float(rng.integers(1, 4))))
    rows += [(np.array([3.0, 15.0]) + rng.normal(size=2) * 9, int(rng.integers(-1, 2)), 0.0) for _ in range(40)]
    return [(i * 3 + 1, x.tolist(), m, w) for i, (x, m, w) in enumerate(rows)]


def slow_cores(rows, s):
    ids, x, macro, weight = (np.array(c) for c in zip(*rows, strict=True))
    fit = x[weight > 0]
    z = (x - fit.mean(0)) / fit.std(0) if s.standardize else x
    density, kth, units = np.zeros(len(x)), np.full(len(x), np.inf), []
    for m in sorted({int(v) for v in macro[(weight > 0) & (macro >= 0)]}):
        own = np.flatnonzero((weight > 0) & (macro == m))
        w = weight[own] / weight[own].sum()
        d2 = square_distances(z[own], z[own])
        near = np.argsort(d2, axis=1, kind="stable")[:, : min(s.k, len(own))]
        kth[own] = np.sqrt(np.take_along_axis(d2, near, 1).max(1))
        density[own] = w[near].sum(1) / kth[own] ** 2
        order = own[np.lexsort((ids[own], -density[own]))]
        share = np.cumsum(weight[order]) / weight[own].sum()
        core = order[: int(np.ceil(s.fraction * len(own)))] if s.by == "count" else order[(share <= s.fraction) | (np.arange(len(order)) == 0)]
        if s.mode == "top_density":
            groups = [core]
        else:
            cut = s.max_edge_distance if s.max_edge_distance is not None else s.edge_scale * np.quantile(kth[core], s.edge_quantile)
            root = {int(i): int(i) for i in core}
            for i, (near_ids, dists) in brute(z[core], core, np.zeros(len(core)), s.graph_k).items():
                for j, d in zip(near_ids, dists, strict=True):
                    if d <= cut:
                        a, b = root[i], root[j]
                        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
            groups = [np.array([i for i in core if root[int(i)] == r]) for r in sorted(set(root.values()))]
            groups = [g for g in groups if len(g) >= s.min_size]
            top = lambda g: density[g].max()
            if not groups:
                groups = [core[:1]]
            elif s.split:
                groups = sorted(groups, key=top, reverse=True)[: s.max_pockets]
            else:
                groups = [next((g for g in groups if core[0] in g), max(groups, key=top))]
        units += [(m, g) for g in groups]
    centers = [g[np.lexsort((ids[g], -density[g]))[0]] for _, g in units]
    dist = np.sqrt(square_distances(z, z[centers]).min(1))
    energy = np.full(len(x), np.nan)
    energy[density > 0] = -np.log(density[density > 0])
    energy -= np.nanmin(energy)
    state = np.full(len(x), -1)
    for k, (_, g) in enumerate(units):
        state[g] = k
    told = [(k, m, int(ids[c]), density[c], energy[c], density[g].min(), dist[g].max(), len(g)) for k, ((m, g), c) in enumerate(zip(units, centers, strict=True))]
    return {int(i): (int(a), d, e, r) for i, a, d, e, r in zip(ids, state, density, energy, dist, strict=True)}, told


@pytest.mark.parametrize(
    "settings",
    [
        {"fraction": 0.5, "split": True, "min_size": 5, "graph_k": 9},
        {"fraction": 0.5},
        {"fraction": 0.6, "split": True, "max_pockets": 1, "by": "weight", "min_size": 3},
        {"fraction": 0.3, "mode": "top_density", "standardize": False},
        {"fraction": 0.5, "max_edge_distance": 1e-9, "min_size": 2},
        {"fraction": 0.5, "split": True, "max_edge_distance": 0.05, "min_size": 4},
    ],
)
def test_cores_equal_brute_force(spark, settings):
    rows, s = lobes(), CoreSettings(**{"k": 8, "graph_k": 4, **settings})
    df = spark.createDataFrame(rows, "row_id long, x array<double>, macro int, weight double").withColumn("tag", F.lit("t")).repartition(3)
    labelled, centers = label_cores(df, s)
    frames, told = slow_cores(rows, s)
    got = {r["row_id"]: (r["state"], r["density"], np.nan if r["free_energy"] is None else r["free_energy"], r["dist"]) for r in labelled.collect()}
    assert labelled.columns == [*df.columns, "state", "density", "free_energy", "dist"] and got.keys() == frames.keys()
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in frames.items()}
    assert all(got[k][1:] == pytest.approx(frames[k][1:], rel=1e-9, nan_ok=True) for k in frames)
    found = [(r["state"], r["macro"], r["center_row"], r["density"], r["free_energy"], r["density_threshold"], r["dist_threshold"], r["n_frames"]) for r in centers.orderBy("state").collect()]
    assert len(found) == len(told) and all(a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9) for a, b in zip(found, told, strict=True))
    if settings.get("split") and settings.get("min_size") == 5:
        assert len(told) == 4  # two lobes of each of two states


def test_cores_refuse(spark):
    with pytest.raises(ValueError, match="mode"):
        CoreSettings(mode="other")
    df = spark.createDataFrame([(1, [0.0], -1, 1.0), (2, [1.0], 0, 0.0)], "row_id long, x array<double>, macro int, weight double")
    with pytest.raises(ValueError, match="macrostate"):
        label_cores(df)


def test_distances_held_do_not_grow_with_the_references():
    """A part of a batch and its references stay under the bound, and every row is in one part."""
    batch = pa.RecordBatch.from_pydict({"row_id": list(range(5000))})
    for references in (0, 1, 900, 56_000, 5_000_000):
        parts = list(C.few_rows(batch, references, 1024))
        assert sum((p.column("row_id").to_pylist() for p in parts), []) == list(range(5000))
        assert all(p.num_rows == 1 or p.num_rows * references <= C.MOST_HELD for p in parts) and max(p.num_rows for p in parts) <= 1024


def test_densities_among_many_references(spark):
    """40 000 references of a state, as many as leave 50 rows to a part: the same as by definition."""
    rng = np.random.default_rng(7)
    points, at = rng.normal(size=(40_000, 2)), rng.normal(size=(120, 2))
    df = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(at)], "row_id long, macro long, z array<double>").coalesce(1)
    got = [tuple(r) for r in state_density(df, {0: (points, np.ones(len(points)))}, 5, "z").orderBy("row_id").select("density", "kth").collect()]
    kth = np.sqrt(np.sort(square_distances(at, points), 1)[:, 4])
    assert np.allclose([k for _, k in got], kth, rtol=1e-12) and np.allclose([d for d, _ in got], 5 / 40_000 / kth**2, rtol=1e-9)
