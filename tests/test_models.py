"""Networks by finite differences; training, paths, readers, sinks, stages, streams on small inputs."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagwell.functions import kinetics as K2
from lagwell.functions.committor import AdamW, Loss, Net, boundary_weight, flux_spread, flux_sums, losses, partial_gradient, split_train_val
from lagwell.operators import cluster as C
from lagwell.operators import exchange as E
from lagwell.operators import model as M
from lagwell.operators import paths as Q
from lagwell.operators import relabel as R
from lagwell.operators import reweight as V
from lagwell.plans import stages as S
from lagwell.sinks import writers as K
from lagwell.sources import readers as D


@pytest.mark.parametrize("head", ["softmax", "softplus", "sigmoid"])
@pytest.mark.parametrize(("activation", "mode", "tau"), [("elu", "cross_entropy", None), ("tanh", "mse", 3.0), ("silu", "cross_entropy", 0.5)])
def test_gradients(head, activation, mode, tau):
    rng = np.random.default_rng(1)
    net = Net((2, 5, 3), head=head, activation=activation)
    x, y = rng.normal(size=(8, 2)), rng.normal(size=(8, 2))
    pairwise = head == "sigmoid"
    label = rng.integers(-1, 2, (8, 3)) if pairwise else rng.integers(-1, 3, 8)
    w = rng.uniform(0.5, 2, 8)
    loss = Loss(simplex=0.5, pairwise=pairwise, pairs=((0, 1), (2, 0)), thresholds=(0.3, 0.5, 0.7), eps=0.2, boundary_mode=mode, tau=tau)

    def spread():
        return flux_spread(flux_sums(net(x), net(y), w, loss), w.sum())

    def value():
        _, parts, mass = partial_gradient(net, x, y, label, label, w, loss, 0.7)
        return sum(getattr(loss, k) * v for k, v in parts.items()) + loss.flux * mass * spread()[0]

    grads, _, _ = partial_gradient(net, x, y, label, label, w, loss, 0.7, spread()[1])
    # batches add up, whatever the split
    halves = [partial_gradient(net, x[s], y[s], label[s], label[s], w[s], loss, 0.7, spread()[1])[0] for s in (slice(0, 3), slice(3, 8))]
    assert all(np.allclose(g, a + b) for gs, *parts in zip(grads, *halves, strict=True) for g, a, b in zip(gs, *parts, strict=True))
    for (a, b), (ga, gb) in zip(net.layers, grads, strict=True):
        for p, g in ((a, ga), (b, gb)):
            at = tuple(rng.integers(0, n) for n in p.shape)
            p[at] += 1e-6
            up = value()
            p[at] -= 2e-6
            down = value()
            p[at] += 1e-6
            assert np.isclose((up - down) / 2e-6, g[at], rtol=1e-3, atol=1e-5)


def test_input_gradient():
    net, x = Net((2, 6, 3)), np.array([[0.3, -0.2]])
    q, g = net.value_and_input_gradient(x, 1)
    for k in range(2):
        d = np.zeros((1, 2))
        d[0, k] = 1e-6
        assert np.isclose((net(x + d) - net(x - d))[0, 1] / 2e-6, g[0, k], rtol=1e-4)
    assert np.isclose(q.sum(), 1)


def test_training_lowers_the_loss(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    label = np.where(x[:, 0] > 0.8, 1, np.where(x[:, 0] < -0.8, 0, -1))
    rows = [(i, x[i].tolist(), (x[i] + 0.01).tolist(), int(label[i]), int(label[i]), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, x_tau array<double>, label int, label_tau int, weight double")
    net, history = M.train(df, Net((2, 8, 2)), Loss(flux=0.0), epochs=12, rate=0.05)
    assert history[-1]["validation"] < 0.6 * history[0]["validation"]
    net.save(str(tmp_path / "n.npz"), {"space": "cv"})
    back, meta = Net.load(str(tmp_path / "n.npz"))
    assert np.allclose(back(x), net(x)) and meta == {"space": "cv"}
    q = np.array([r[0] for r in M.infer(df, net).orderBy("row_id").select("q").collect()])
    assert np.allclose(q, net(x), atol=1e-5)


def test_reconstruction(spark):
    q = np.array([0.2, 0.5, 0.3])
    pair = [float(q[j] / (q[i] + q[j])) for i in range(3) for j in range(i + 1, 3)]
    got = M.reconstruct(spark.createDataFrame([(0, pair)], "row_id long, Q array<double>"), 3).first()["q"]
    assert np.allclose(got, q)


def test_schedules_and_split():
    assert boundary_weight(1, 10, 1, "linear") == 10 and np.isclose(boundary_weight(51, 10, 1, "linear"), 5.5) and boundary_weight(500, 10, 1, "linear") == 1
    assert np.isclose(boundary_weight(101, 10, 1, "cosine"), 1) and np.isclose(boundary_weight(51, 10, 1, "cosine"), 5.5) and boundary_weight(7, 10, 1) == 10
    assert np.isclose(boundary_weight(101, 10, 1, "exp"), 1 + 9 / np.e) and np.isclose(boundary_weight(26, 10, 0, "exp", start=6, decay=20), 10 / np.e)
    for wrong in ({"start": 0}, {"decay": 0}):
        with pytest.raises(ValueError):
            boundary_weight(1, 10, 1, "exp", **wrong)
    a, b = split_train_val(11, 0.2)
    assert len(b) == 3 and sorted([*a, *b]) == list(range(11))
    net = Net((1, 2))
    before = net.layers[0][0].copy()
    AdamW(0.1).step(net, [(np.ones((1, 2)), np.zeros(2))])
    assert (net.layers[0][0] < before).all()


def test_boundary_is_the_mean_over_labelled_ends(spark):
    q = np.array([[0.5, 0.5], [0.25, 0.75], [0.9, 0.1], [0.2, 0.8]])
    label, label_tau = np.array([0, -1, -1, -1]), np.array([-1, 1, -1, -1])
    w = np.array([1.0, 2.0, 3.0, 4.0])
    ends = (1 + 2) / w.sum()
    for mode, first, second in (("cross_entropy", np.log(2), -np.log(0.75)), ("mse", 0.5, 0.125)):
        parts, *_ = losses(q, q, label, label_tau, w, Loss(boundary_mode=mode), ends)
        assert np.isclose(parts["boundary"] / w.sum(), (1 * first + 2 * second) / 3)
    df = spark.createDataFrame([(i, q[i].tolist(), int(label[i]), int(label_tau[i]), float(w[i])) for i in range(4)], "row_id long, q array<double>, label int, label_tau int, weight double")
    assert np.isclose(M.labelled_ends(df), ends)
    assert np.isclose(M.boundary_loss(df, label="label_tau").first()[0], -np.log(0.75)) and M.boundary_loss(df.where("label = 5"), label="label").first()[0] is None
    assert losses(q, q, label * 0 - 1, label * 0 - 1, w, Loss(), 0.0)[0]["boundary"] == 0


def test_training_does_not_depend_on_partitions(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=2).tolist(), rng.normal(size=2).tolist(), int(rng.integers(-1, 2)), int(rng.integers(-1, 2)), float(rng.uniform(0.5, 2))) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, x_tau array<double>, label int, label_tau int, weight double")
    loss = Loss(flux=0.5, pairs=((0, 1),), thresholds=(0.3, 0.6))
    runs = [M.train(df.repartition(n), Net((2, 4, 2)), loss, epochs=3, batches=2, schedule="exp", final_boundary=1.0, last=str(tmp_path / "last.npz"))[1] for n in (1, 5)]
    assert np.allclose([h["train"] for h in runs[0]], [h["train"] for h in runs[1]], rtol=1e-9) and runs[0][0]["flux"] > 0
    assert Net.load(str(tmp_path / "last.npz"))[1] == {"epoch": 2}


def test_shooting_and_stitching(spark):
    net = Net((1, 2), layers=[(np.array([[-2.0, 2.0]]), np.zeros(2))])
    starts = spark.createDataFrame([(0, [0.0]), (1, [0.1])], "path_id long, x array<double>")
    up, down = Q.shoot(starts, net, 1), Q.shoot(starts, net, 0)
    assert up.groupBy("path_id").agg(F.max(F.col("q")[1]).alias("m")).where("m < 0.98").isEmpty()
    legs = down.withColumn("leg", F.lit(0)).unionByName(up.withColumn("leg", F.lit(1))).select("path_id", "leg", "image_id", "x")
    path = [r["x"][0] for r in Q.stitch(legs, 12).where("path_id = 0").orderBy("image_id").collect()]
    assert len(path) == 12 and path == sorted(path) and path[0] < -0.9 < 0.9 < path[-1]


def test_path_clusters_and_shared_nodes(spark):
    rows = [(p, k, [k / 4, off], 1.0) for p, off in enumerate((0.0, 0.05, 2.0)) for k in range(5)]
    im = spark.createDataFrame(rows, "path_id long, image_id int, x array<double>, weight double")
    assert Q.cluster_paths(im, {0: 1, 1: 1, 2: 1}, 0.25)[0] == [[0, 1], [2]]
    labels = E.shared_nodes([((0, 1), (1, 1))], [(p, k) for p in (0, 1) for k in range(3)])
    assert list(E.shared_segments(labels).values()) == [[(0, 1), (1, 1)]]
    adjacency, _, branch = E.network({0: 3, 1: 3}, [((0, 1), (1, 1))])
    assert branch == [1, 4] and len(E.reactive_routes({0: 3, 1: 3}, [((0, 1), (1, 1))])) > 2


def test_nearest_centers_agree(spark):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(200, 3)), rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "row_id long, x array<double>, weight double")
    want = ((x[:, None] - c) ** 2).sum(2).argmin(1)
    assert [r["cell"] for r in C.nearest_centers(df, c.tolist()).orderBy("row_id").collect()] == want.tolist()
    assert [r["cell"] for r in C.nearest_centers(df, c[:5].tolist()).orderBy("row_id").collect()] == ((x[:, None] - c[:5]) ** 2).sum(2).argmin(1).tolist()
    near = C.knn(df, x, np.arange(200), 3).orderBy("row_id").first()
    assert near["ids"] == np.argsort(((x - x[0]) ** 2).sum(1), kind="stable")[1:4].tolist()
    centers, cells = C.kmeans(df, 4, rounds=30)
    means = cells.groupBy("cell").agg(*(F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(3))).collect()
    assert all(np.allclose([r["m0"], r["m1"], r["m2"]], centers[r["cell"]]) for r in means)


def test_neighbours_search_every_row(spark):
    from lagwell import catalog
    from lagwell.queries.views import frames_emb

    rows = frames_emb(spark, "/root/testdata/sf0.1").select("row_id", "x").collect()
    ids, x = np.array([r["row_id"] for r in rows]), np.array([r["x"] for r in rows])
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    want = {i: np.sort(d)[:5] for i, d in zip(ids, d2, strict=True)}
    listed = catalog.queries()["j09_nearest_neighbours"](spark, "/root/testdata/sf0.1")
    assert listed.count() == 5 * len(rows) and listed.where("rank = 1").count() == len(rows)
    got = C.knn_all(frames_emb(spark, "/root/testdata/sf0.1"), 5).collect()
    split = C.knn_all(frames_emb(spark, "/root/testdata/sf0.1"), 5, block=700).collect()
    for found in (got, split):
        assert len(found) == len(rows)
        assert all(len(set(r["ids"]) - {r["row_id"]}) == 5 and np.allclose(np.square(r["dists"]), want[r["row_id"]], atol=1e-9) for r in found)


def test_reweighting_and_matching(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 1))
    seg = spark.createDataFrame([(i, [float(v[0])], [float(x[(i * 7 + 3) % 200, 0])]) for i, v in enumerate(x)], "row_id long, x array<double>, x_tau array<double>")
    w, history = V.reweight_segments(seg, 5, rounds=4)
    assert np.isclose(w.agg(F.sum("weight")).first()[0], 1) and len(history) == 4
    a = spark.createDataFrame([(0, 1.0), (1, 1.001), (2, 9.0)], "row_id long, v double")
    b = spark.createDataFrame([(10, 1.0005), (11, 1.0), (12, 5.0)], "row_id long, v double")
    got = sorted((r["target_id"], r["source_id"]) for r in V.tolerance_match(a, b, ["v"], 0.1).collect())
    assert len(got) == 2 and {t for t, _ in got} == {0, 1}
    xyz = np.array([[[0, 0, 0], [1, 0, 0], [1, 1, 0], [1, 1, 1.0]]])
    assert np.allclose(V.internal_coordinates(xyz)[0], [1, 1, 1, 1, 1, 0, 0, -1, 0]) or np.allclose(np.abs(V.internal_coordinates(xyz)[0]), [1, 1, 1, 1, 1, 0, 0, 1, 0])


def test_readers(spark, tmp_path):
    f = tmp_path / "a_1.colvars"
    f.write_text("# junk = 1\n# step x y\n0 1.0 2.0\n1 3.0 4.0\n# step x y\n2 5.0 6.0\n")
    df = D.colvars(spark, str(f))
    assert df.columns[2:] == ["step", "x", "y"] and [r["x"] for r in df.orderBy("line").collect()] == [1, 3, 5]
    assert D.count_rows(spark, str(f)) == 3 and D.strided_length(7, 3) == 3
    (tmp_path / "t.csv").write_text("traj_id,step,x\nA,0,1\nA,1,2\n")
    both = D.scan(spark, tables=[str(tmp_path / "t.csv")], colvars_files=[str(f)])
    assert both.count() == 5 and "y" in both.columns
    with pytest.raises(ValueError):
        D.require_columns(both, ["nope"])
    assert D.folder_tables(spark, str(tmp_path), "*.colvars", r"_(\d+)").select("traj_id").distinct().collect()[0][0] == "1"
    m = tmp_path / "p.csv"
    m.write_text(",0,1\n0,0.1,0.9\n1,0.4,0.6\n")
    assert D.square_matrix(str(m)).tolist() == [[0.1, 0.9], [0.4, 0.6]]
    a = spark.createDataFrame([("d", "s1", "1"), ("d", "s2", "2")], "folder string, stem string, tag string")
    b = spark.createDataFrame([("d", "s1", "1"), ("e", "z", "2")], "folder string, stem string, tag string")
    assert sorted(map(tuple, D.pair_files(a, b).collect())) == [("s1", "s1", "exact"), ("s2", "z", "tag")]
    (tmp_path / "c.yaml").write_text("msm:\n  lag: 3\n")
    assert D.config(str(tmp_path / "c.yaml"), ["x", "msm"]) == {"lag": 3}
    assert D.default_names(2, "cv", ["a"]) == ["cv_0", "cv_1"]


def test_sinks_and_stages(spark, tmp_path):
    df = spark.createDataFrame([(i, i // 50, i % 50, [float(i % 7), float(i % 3)], 1.0) for i in range(200)], "row_id long, traj_id long, frame int, x array<double>, weight double")
    K.save_dataset(df, str(tmp_path / "ds"), {"a": np.float64("nan"), "b": np.arange(2)})
    back, meta = D.dataset(spark, str(tmp_path / "ds"))
    assert back.count() == 200 and meta == {"a": None, "b": [0, 1]} and "state" in back.columns
    cfg = {"n_clusters": 6, "lags": (1, 2), "n_macro": 2, "references": 50, "k": 5, "rounds": 5}
    out = S.run_msm(df, cfg, str(tmp_path / "msm"))
    assert set(out) == set(S.SUBSTEPS["0"]) and out["summary"].count() == 2
    stamp = out["cluster"].inputFiles()
    assert S.run_msm(df, cfg, str(tmp_path / "msm"))["cluster"].inputFiles() == stamp
    assert S.run_msm(df, {**cfg, "n_clusters": 5}, str(tmp_path / "msm"))["cluster"].inputFiles() != stamp
    assert K.scientific(1234.5, 12.3) == "$(1.23 \\pm 0.01) \\times 10^{3}$" and K.scientific(float("nan")) == "--"
    assert "0 $\\to$ 1" in K.latex_directed(np.array([[0, 2.0], [3, 0]]), "c", "l")
    assert json.loads(json.dumps(K.rate_table(*(np.array([[0, 1.0], [np.inf, 0]]),) * 4)))[1]["k"] is None


def test_dispatch():
    assert S.canonical_stage("MSM") == "0" and S.canonical_stage("3") == "3"
    for bad in (lambda: S.canonical_stage("x"), lambda: S.substeps("1", "nope"), lambda: S.force_plan({}, "nope", True)):
        with pytest.raises(ValueError):
            bad()
    cfg = {"force": True, "a": [1]}
    for target in S.SUBSTEPS["0"]:
        plan = S.force_plan(cfg, target, False)
        assert [s for s, f in plan if f] == [target]
    assert cfg == {"force": True, "a": [1]}
    seen = []
    S.run_stage("relabel", None, {}, {"3.diagnostics": lambda *_: seen.append(1)}, "diagnostics")
    assert seen == [1]


def test_relabel_settings():
    assert R.settings({"relabel": {"lag_list": 3, "min_pairs": 7}}).lags == (3,)
    assert R.settings({"analysis": {"lags": [5, 2]}, "relabel": {"lag_list": 3}}).lags == (2, 5)
    with pytest.raises(ValueError):
        R.settings({"analysis": {"lags": [0]}})


def test_streaming_counts(spark, tmp_path):
    from lagwell.operators.counting import count_matrix
    from lagwell.operators.lag import sequence_pairs
    from lagwell.streaming.counts import streaming_pairs

    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"row_id": range(60), "traj_id": [i % 3 for i in range(60)], "frame": [i // 3 for i in range(60)], "state": rng.integers(-1, 3, 60), "weight": rng.uniform(0, 1, 60)})
    df = spark.createDataFrame(rows).selectExpr("row_id", "traj_id", "cast(frame as int) frame", "cast(state as int) state", "weight")
    df.where("frame < 9").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    df.where("frame >= 9").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_pairs(stream, 2).writeStream.format("memory").queryName("lagpairs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("lagpairs").where("i >= 0 and j >= 0 and weight > 0").groupBy("i", "j").agg(F.round(F.sum("weight"), 9).alias("c"))
    want = count_matrix(sequence_pairs(df, [2], ["state"])).select("i", "j", F.round("count", 9).alias("c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stages_need_their_handlers():
    from lagwell.plans import stages as S

    ran = []
    with pytest.raises(ValueError, match="no handler for 3.diagnostics"):
        S.run_stage("relabel", None, {}, {}, "diagnostics")
    with pytest.raises(ValueError, match="no handler"):
        S.run_stage("all", None, {}, {"3.diagnostics": lambda *_: ran.append(1)})
    assert not ran


def test_principal_axes_and_elbow(spark):
    rng = np.random.default_rng(9)
    x, w = rng.normal(size=(200, 3)) * [3.0, 1.0, 0.2] + [1, 2, 3], rng.uniform(0.5, 2, 200)
    df = spark.createDataFrame([(i, x[i].tolist(), float(w[i])) for i in range(200)], "row_id long, x array<double>, weight double")
    mean, axes = C.principal_axes(df, 2)
    cov = np.cov(x.T, aweights=w, ddof=0)
    assert np.allclose(mean, np.average(x, axis=0, weights=w)) and np.allclose(cov @ axes[0], np.linalg.eigvalsh(cov)[-1] * axes[0])
    got = np.array([r[0] for r in C.projected(df, mean, axes).orderBy("row_id").select("x").collect()])
    assert np.allclose(got, (x - mean) @ axes.T)
    assert K2.elbow([100, 40, 35, 33, 32], [2, 3, 4, 5, 6]) == 3 and K2.elbow([5, 4], [2, 3]) == 2


def test_sampled_kmeans_labels_every_row(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(300, 2)) * 0.1, rng.normal(size=(300, 2)) * 0.1 + 5])
    df = spark.createDataFrame([(i, x[i].tolist(), 1.0) for i in range(600)], "row_id long, x array<double>, weight double")
    centers, cells = C.kmeans(df, 2, rounds=20, sample=60)
    got = {r["row_id"]: r["cell"] for r in cells.collect()}
    assert len(got) == 600 and len({got[i] for i in range(300)}) == 1 and got[0] != got[599] and np.allclose(sorted(centers[:, 0]), [0, 5], atol=0.2)


def test_folder_of_colvars(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "run_1.traj").write_text("# step phi\n" + "# note = 3\n" * 3 + "0 1.5\n# step phi\n1 2.5\n")
    (tmp_path / "a" / "run_2.traj").write_text("# step phi\n0 3.5\n")
    (tmp_path / "run_3.traj").write_text("# step psi x\n0 4.5 6\n")
    (tmp_path / "run_4.traj").write_text("0 9 9 9\n")
    rows = {(r["traj_id"], r["line"]): r for r in D.folder_tables(spark, str(tmp_path), "*.traj", r"run_(\d)").collect()}
    assert {k: (r["phi"], r["psi"], r["col3"]) for k, r in rows.items()} == {("a/1", 0): (1.5, None, None), ("a/1", 1): (2.5, None, None), ("a/2", 0): (3.5, None, None), ("3", 0): (None, 4.5, None), ("4", 0): (None, None, 9.0)}
    with pytest.raises(ValueError):
        D.folder_tables(spark, str(tmp_path), "*.none", "x")
