"""Formats and compositions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwell.functions.committor import Net
from lagwell.operators import fields as B
from lagwell.operators.reweight import frame_weights, split_by_components, with_internal_coordinates
from lagwell.plans import pathways as P
from lagwell.queries.views import frames_emb
from lagwell.sources import dcd

DATA = "/root/testdata/sf0.001"


def test_dcd(spark, tmp_path):
    xyz = np.random.default_rng(0).normal(size=(5, 4, 3)).astype(np.float32)
    data = dcd.encode(xyz)
    (tmp_path / "a.dcd").write_bytes(data)
    assert dcd.frame_count(data) == 5 and dcd.header(data)["n_atoms"] == 4
    assert [k for k, _ in dcd.frames(data[:-10])] == [0, 1, 2, 3]
    df = dcd.read(spark, str(tmp_path), stride=2)
    rows = df.orderBy("frame").collect()
    assert [r["frame"] for r in rows] == [0, 2, 4] and np.allclose(np.array(rows[1]["xyz"]).reshape(4, 3), xyz[2])
    assert len(with_internal_coordinates(df).first()["x"]) == 3 + 2 * 2 + 2
    assert dcd.pdb(xyz[0]).count("ATOM") == 4
    with pytest.raises(ValueError):
        dcd.header(b"no such file")
    named = spark.createDataFrame([("a",), ("b",)], "traj_id string")
    assert {r["traj_id"]: r["state"] for r in dcd.with_anchor_states(named, {"b": 0}).collect()} == {"a": -1, "b": 0}
    with pytest.raises(ValueError):
        dcd.with_anchor_states(named, {"b": 1})


def test_periods():
    assert P.resolve_periods({"periodic": [True, False]}, 2) == [360.0, 0.0] and P.wrap_bounds([360.0, 0]) == [(-180.0, 180.0), None]
    with pytest.raises(ValueError):
        P.resolve_periods({"periods": [1]}, 2)


def test_gradient_paths(spark):
    net = Net((3, 3), layers=[(np.eye(3) * 6, np.zeros(3))])
    out = P.gradient_paths(frames_emb(spark, DATA), net, 0, 1, starts=8, max_steps=60, n_images=10, cutoff=5.0)
    assert sum(map(len, out["clusters"])) == 8 and out["paths"].groupBy("path_id").count().where("count != 10").isEmpty()
    assert out["centers"].where("cluster = 0").count() == 10
    scores = P.path_scores(out["paths"], net, 0, 1).agg(F.min("channel"), F.max("channel")).first()
    assert 0 <= scores[0] <= scores[1] <= 0.25 + 1e-9
    assert P.state_pairs(np.array([[0, 0.9, 0.1], [0.2, 0, 0.3], [0.5, 0.1, 0]]), 0.2) == [(0, 1), (0, 2), (1, 2)]


def test_field_centers_and_diagnostics(spark):
    f = frames_emb(spark, DATA)
    got = P.field_centers(f, [("x0", -0.3, 0.3, 8), ("x1", -0.3, 0.3, 8)], 0, 1)
    assert got["free_energy"].min() == 0 and len(got["centers"]) >= 1
    assert {k: v.count() for k, v in P.diagnose_labels(f, [1, 2]).items()}["frames"] == f.count()
    assert P.thinned(f, 10).count() == 10


def test_smoothing_keeps_mass():
    g = np.zeros((8, 8))
    g[0, 4] = 1
    assert np.isclose(B.smooth(g, [1.0, 1.0], [True, True]).sum(), 1)


def test_frame_weights_and_splits(spark):
    seg = spark.createDataFrame([(0, 0, 2, 1.0), (0, 2, 3, 3.0)], "traj_id long, first int, last int, weight double")
    assert {r["frame"]: r["weight"] for r in frame_weights(seg).collect()} == {0: 1, 1: 1, 2: 2, 3: 3}
    df = spark.createDataFrame([(i, 0) for i in range(5)], "row_id long, state int")
    comp = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 7), (4, 0, 7)], "row_id long, state int, component int")
    slow = spark.createDataFrame([(0, 1, 0.01)], "state int, lag int, max_exchange double")
    assert [r["state"] for r in split_by_components(df, comp, slow, 0.05, 3).orderBy("row_id").collect()] == [0, 0, 0, 3, 3]
    assert [r["state"] for r in split_by_components(df, comp, slow, 0.001, 3).orderBy("row_id").collect()] == [0] * 5


def test_images_yaml_and_adapters(spark, tmp_path):
    from lagwell.sinks.writers import save_inspection, write_yaml
    from lagwell.sources.readers import array_file, config, first_matrix, images, samples

    two = np.arange(12.0).reshape(2, 3, 2)
    np.savetxt(tmp_path / "p.txt", np.ones((4, 2)))
    im = images(spark, [two, str(tmp_path / "p.txt")])
    assert im.groupBy("path_id").count().orderBy("path_id").collect() == [(0, 3), (1, 3), (2, 4)]
    write_yaml({"a": np.float64("inf"), "b": [np.int64(2)]}, str(tmp_path / "s.yaml"))
    assert config(str(tmp_path / "s.yaml")) == {"a": None, "b": [2]}
    np.save(tmp_path / "X.npy", two[0])
    assert array_file(spark, str(tmp_path / "X.npy")).count() == 3
    (tmp_path / "f.csv").write_text('META={"n": 1}\n1,2\n3,4\n')
    assert array_file(spark, str(tmp_path / "f.csv")).orderBy("row_id").first()["x"] == [1, 2]
    np.save(tmp_path / "P_jump.npy", np.eye(2))
    assert first_matrix(str(tmp_path), ["none.csv", "P_jump.npy"]).shape == (2, 2)
    with pytest.raises(FileNotFoundError):
        first_matrix(str(tmp_path), ["none.csv"])
    cells = spark.createDataFrame([(3, [0.1, 0.2], 2.0)], "cell int, x array<double>, mass double")
    assert P.channel_from_grid(cells).first()["weight"] == 2.0
    f = frames_emb(spark, DATA)
    f.select("row_id").write.parquet(str(tmp_path / "rows"))
    assert samples(spark, str(tmp_path / "rows"), 100).count() == 5
    save_inspection(f, str(tmp_path / "csv"), ["row_id", "state"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).where("is_intermediate = 'true'").count() == f.where("state < 0").count()


def test_blocks_of_a_source(spark):
    from lagwell.sources.readers import blocks

    df = spark.createDataFrame([(0, i, s) for i, s in enumerate([0, 1, 2, 0, 1, 0])], "source_order int, row long, step int")
    ids = lambda d: [r["traj_id"] for r in d.orderBy("row").collect()]
    assert ids(blocks(df, name="a", order="row", step="step")) == ["a:000000"] * 3 + ["a:000001"] * 2 + ["a:000002"]
    assert ids(blocks(df, name="a", order="row", frames_per_traj=4)) == ["a:000000"] * 4 + ["a:000001"] * 2
    assert ids(blocks(df, name="a", order="row")) == ["a:000000"] * 6
    assert blocks(df.withColumn("traj_id", F.lit("x")), name="a", order="row").first()["traj_id"] == "x"


def test_tables_are_deleted(spark):
    import os

    from lagwell.plans.lineage import discard, materialize, passing, session_dir

    folder = session_dir(spark).removeprefix("file://")
    a = materialize(spark.range(5).toDF("id"))
    held = set(os.listdir(folder))
    with passing(spark):
        b = materialize(a.where("id > 1"))
        assert b.count() == 3 and len(os.listdir(folder)) == len(held) + 1
    assert set(os.listdir(folder)) == held
    discard(a)
    discard(spark.range(1))
    assert len(os.listdir(folder)) == len(held) - 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lagwell.plans.lineage import shared_dir

    def session(master, **known):
        context = SimpleNamespace(master=master, getConf=lambda: {})
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: known.get(key, default)), sparkContext=context)

    assert shared_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs://x"})) == "hdfs://x"
    assert shared_dir(session("local[4]")).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_dir(session(master))


def test_datasets_are_built_and_relabelled(spark, tmp_path):
    from lagwell.plans.datasets import build_dataset, relabel_dataset

    rows = [(i, 0, i, float(i), float(10 * i), 1.0) for i in range(40)]
    frames = spark.createDataFrame(rows, "row_id long, traj_id long, frame int, cv1 double, phi double, weight double")
    path = str(tmp_path / "set")
    df, meta = build_dataset(frames, path, ["cv1", "phi"], [(0, [5.0], [2.0]), (1, [30.0], [3.0])], periodic=["phi"], basin_columns=["cv1"], discard_before=4, stride=2)
    got = {r["row_id"]: r for r in df.collect()}
    assert sorted(got) == list(range(4, 40, 2)) and meta["features"] == ["cv1", "sinphi", "cosphi"] and meta["states"] == {"0": 2, "1": 3, "-1": 13}
    assert np.allclose(got[6]["x"], [6, np.sin(np.radians(60)), np.cos(np.radians(60))]) and (got[6]["state"], got[28]["state"], got[20]["state"]) == (0, 1, -1)
    again, meta = relabel_dataset(spark, path, [(2, [20.0], 1.5)], "distance")
    assert {r["row_id"]: r["state"] for r in again.collect()} == {i: 2 if i == 20 else -1 for i in got}
    assert meta["states"] == {"2": 1, "-1": 17} and meta["shape"] == "distance" and again.columns == df.columns
    df.sparkSession.createDataFrame([(1,)], "state int").write.parquet(str(tmp_path / "bare"))
    with pytest.raises(ValueError, match="basins"):
        relabel_dataset(spark, str(tmp_path / "bare"), [])


def test_msm_options(spark, tmp_path):
    from lagwell.operators import counting as N
    from lagwell.plans import stages as S

    df = frames_emb(spark, DATA).select("row_id", "traj_id", "frame", "x", "weight")
    cfg = {"n_clusters": 6, "lags": [1], "n_macro": 2, "rounds": 5}
    plain = S.run_msm(df, cfg, str(tmp_path / "a"))
    chosen = S.run_msm(df, {**cfg, "cluster_sample": 100, "active_set": True, "reversible": True}, str(tmp_path / "b"))
    assert chosen["cluster"].count() == plain["cluster"].count()
    ends = {x for r in chosen["msm"].collect() for x in (r["i"], r["j"])}
    assert {r["micro"] for r in chosen["pcca"].collect()} == ends and chosen["summary"].count() == 1
    n = 1 + max(ends)
    t = {(r["i"], r["j"]): r["p"] for r in N.transition_matrix(chosen["msm"], n, reversible=True).collect()}
    assert all(np.isclose(sum(t[i, j] for j in range(n)), 1) for i in range(n))


def test_path_grid_and_training_artefacts(spark, tmp_path):
    import json

    from lagwell.functions.committor import Loss, Net
    from lagwell.operators.flux import flux_profiles
    from lagwell.operators.model import infer, train
    from lagwell.plans.workflow import net_table, read_net
    from lagwell.sinks import writers

    net = Net((2, 3))
    images = spark.createDataFrame([(p, k, [k + 0.5, -1e-7 * p]) for p in (0, 3) for k in range(12)], "path_id long, image_id int, x array<double>").repartition(5)
    scored = P.path_scores(images, net, 0, 1).withColumn("q0", F.get("q", F.lit(0)))
    for _ in range(2):
        writers.save_paths(scored, str(tmp_path / "paths"), ["q0", "channel"])
    files = list((tmp_path / "paths" / "path_id=3").glob("part-*"))
    lines = files[0].read_text().splitlines()
    q = net(np.array([[k + 0.5, -3e-7] for k in range(12)], np.float32))
    assert len(files) == 1 and np.allclose([[float(v) for v in x.split()] for x in lines], [[k + 0.5, -3e-7, q[k, 0], q[k, 0] * q[k, 1]] for k in range(12)])
    axes = [("phi", -1.0, 1.0, 4), ("psi", 0.0, 3.0, 3)]
    found = P.field_centers(spark.createDataFrame([(i, 0.5 * (i % 4) - 0.75, float(i % 3) + 0.5, 1.0, [0.4, 0.6]) for i in range(50)], "row_id long, phi double, psi double, weight double, q array<double>"), axes, 0, 1, sigma=0.0)
    grid = writers.save_grid(spark, str(tmp_path / "grid"), axes, {k: found[k] for k in ("density", "free_energy", "channel")}, {"centers": found["centers"]})
    rows = {(r["b0"], r["b1"]): r for r in grid.collect()}
    assert len(rows) == 12 and rows[1, 2]["phi"] == -0.25 and rows[1, 2]["psi"] == 2.5 and rows[1, 2]["channel"] == pytest.approx(0.24) and rows[1, 2]["density"] == found["density"][1, 2]
    meta = json.loads((tmp_path / "grid.meta.json").read_text())
    assert [a["name"] for a in meta["axes"]] == ["phi", "psi"] and len(meta["centers"]) == len(found["centers"])
    pairs = spark.createDataFrame([(i, [i / 10, 0.0], [i / 10 + 0.1, 0.0], 0, 1, 1.0) for i in range(20)], "row_id long, x array<double>, x_tau array<double>, label int, label_tau int, weight double")
    fitted, history = train(pairs, Net((2, 3)), Loss(flux=0.0), epochs=2)
    both = infer(infer(pairs, fitted), fitted, "x_tau", "q_tau").withColumn("weight_tau", F.lit(1.0))
    writers.save_training(spark, str(tmp_path / "fit"), net_table(spark, fitted), history, flux_profiles(both, [(0, 1)], [0.2, 0.5]))
    assert np.array_equal(read_net(spark.read.parquet(str(tmp_path / "fit/network")))(np.ones((1, 2))), fitted(np.ones((1, 2))))
    kept = spark.read.csv(str(tmp_path / "fit/history"), header=True, inferSchema=True).collect()
    assert [r["epoch"] for r in kept] == [0, 1] and kept[1]["train"] == pytest.approx(history[1]["train"]) and spark.read.parquet(str(tmp_path / "fit/flux")).count() == 2
