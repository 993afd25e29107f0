"""The workflow over two wells, from frames to labels: every stage without handlers, reuse, invalidation, the command line."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwell.functions.committor import Net
from lagwell.plans import workflow as W
from lagwell.sinks.writers import content_hash


def two_wells(seed=2, n_traj=6, length=160):
    """Overdamped hops between wells at -1 and 1 over a barrier that both coordinates see."""
    rng, rows = np.random.default_rng(seed), []
    for t in range(n_traj):
        x = -1.0 if t % 2 else 1.0
        for f in range(length):
            x += 0.08 * 4 * x * (1 - x * x) + 0.33 * rng.normal()
            x = float(np.clip(x, -1.8, 1.8))
            rows.append((t, f, float(rng.integers(1, 3)), [x, float(0.3 * rng.normal())]))
    return rows


CONFIG = {
    "msm": {"n_clusters": 8, "lags": [1, 2], "rounds": 20, "core_fraction": 0.5, "core_k": 8, "core_graph_k": 6},
    "committor": {"lag": 2, "hidden": [8], "epochs": 25, "rate": 0.05, "blocks": 4},
    "gradpath": {"starts": 12, "n_images": 8, "max_steps": 60, "channel_threshold": 0.05, "cluster_cutoff": 0.5, "rounds": 2, "min_count": 1},
    "relabel": {"lags": [1, 2], "least_frames": 20, "least_pairs": 5, "merge_probability": 0.2, "merge_time": 1e6},
}


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(two_wells(), "traj_id long, frame int, weight double, x array<double>").repartition(3)


def test_all_stages_run_and_are_reused(spark, frames, tmp_path):
    folder = str(tmp_path / "run")
    done = W.Workflow(spark, frames, folder, CONFIG).run()
    assert {"0.core", "1.rate_constant", "2.voronoi", "3.relabel_entropy", "3.rate_merge"} <= set(done)
    q = done["1.infer"]
    assert q.where(F.abs(F.aggregate("q", F.lit(0.0), lambda a, v: a + v) - 1) > 1e-6).isEmpty()
    side = q.where("state >= 0").select("state", F.get("x", F.lit(0)).alias("x0"), F.array_max("q").alias("m"), (F.array_position("q", F.array_max("q")) - 1).alias("best"))
    assert side.where("best != state").count() <= 0.05 * side.count()  # labelled cores know their own state
    rates = {(r["i"], r["j"]): r for r in done["1.rate_constant"].collect()}
    assert rates[0, 1]["k"] > 0 and rates[1, 0]["mfpt"] > 0
    paths = done["2.shoot"].groupBy("path_id", "cluster").agg(F.count("*").alias("n"), F.min(F.get("x", F.lit(0))).alias("lo"), F.max(F.get("x", F.lit(0))).alias("hi")).collect()
    assert paths and all(r["n"] == 8 and r["lo"] < 0 < r["hi"] for r in paths)
    assert done["2.voronoi"].count() >= 8 and done["3.diagnostics"].count() == 2
    assert done["3.rate_merge"].where("old_state >= 0").select("state").distinct().count() == 1  # both are merged at these cutoffs
    files = {n: t.inputFiles() for n, t in done.items()}
    again = W.Workflow(spark, frames.repartition(2), folder, CONFIG).run()
    assert {n: t.inputFiles() for n, t in again.items()} == files
    # other settings of stage 2 leave stages 0 and 1 alone and make stage 2 anew
    changed = W.Workflow(spark, frames, folder, {**CONFIG, "gradpath": {**CONFIG["gradpath"], "n_images": 6}}).run("2")
    assert changed["2.cluster"].groupBy("cluster").count().first()["count"] == 6 and changed["2.shoot"].inputFiles() != files["2.shoot"]
    single = W.Workflow(spark, frames, folder, CONFIG)
    assert single.run("1", "infer")["1.infer"].inputFiles() == files["1.infer"] and "2.shoot" not in single.tables
    # forcing makes the named step alone anew
    forced = W.Workflow(spark, frames, folder, {**CONFIG, "committor": {**CONFIG["committor"], "force": True}}).run("1", "rate_constant")
    assert forced["1.rate_constant"].inputFiles() != files["1.rate_constant"] and W.Workflow(spark, frames, folder, CONFIG).run("1", "train")["1.train"].inputFiles() == files["1.train"]


def test_changed_frames_invalidate_everything_after(spark, frames, tmp_path):
    folder = str(tmp_path / "run")
    labelled = frames.withColumn("state", F.when(F.get("x", F.lit(0)) < -0.8, 0).when(F.get("x", F.lit(0)) > 0.8, 1).otherwise(-1))
    short = {"committor": {**CONFIG["committor"], "epochs": 1}}
    one = W.Workflow(spark, labelled, folder, short).run("1", "infer")["1.infer"].inputFiles()
    assert W.Workflow(spark, labelled, folder, short).run("1", "infer")["1.infer"].inputFiles() == one
    other = labelled.withColumn("weight", F.when(F.col("frame") == 3, 9.0).otherwise(F.col("weight")))
    assert W.Workflow(spark, other, folder, short).run("1", "infer")["1.infer"].inputFiles() != one
    assert content_hash(labelled) == content_hash(labelled.repartition(7)) != content_hash(other)


def test_unknown_names_fail_first(spark, frames, tmp_path):
    w = W.Workflow(spark, frames, str(tmp_path / "none"), {})
    for stage, substep in (("nope", None), ("1", "nope"), ("all", "train")):
        with pytest.raises(ValueError):
            w.run(stage, substep)
    with pytest.raises(ValueError, match="known"):
        w.table("1.nope")
    with pytest.raises(ValueError, match="two labelled"):
        W.Workflow(spark, frames.withColumn("state", F.lit(-1)), str(tmp_path / "none"), {}).run("1", "train")
    assert not (tmp_path / "none" / "1").exists()


def test_networks_as_tables(spark):
    net = Net((3, 5, 2), head="softplus", activation="tanh")
    back = W.read_net(W.net_table(spark, net))
    x = np.random.default_rng(0).normal(size=(9, 3))
    assert (back.sizes, back.head, back.activation) == ((3, 5, 2), "softplus", "tanh") and np.array_equal(back(x), net(x))


def test_command_line(spark, frames, tmp_path):
    frames.withColumn("state", F.when(F.get("x", F.lit(0)) < 0, 0).otherwise(1)).write.parquet(f"{tmp_path}/frames")
    (tmp_path / "c.yaml").write_text("committor: {epochs: 1, hidden: [4]}\n")
    done = W.main(["--input", f"{tmp_path}/frames", "--output", f"{tmp_path}/run", "--config", f"{tmp_path}/c.yaml", "--step", "committor", "--substep", "infer"])
    assert list(done) == ["1.infer"] and done["1.infer"].count() == frames.count()
