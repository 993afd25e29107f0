"""The jobs and what they are made of: growing input, late and repeated rows, a failure half-way, reruns, the command line."""

from __future__ import annotations

import json
import os
import random
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import dialogue_flow, msm_report
from lagwell.operators.frames import number_rows
from lagwell.operators.lag import halo_pairs, sequence_pairs

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def walks(n=400, seed=1):
    """Two thirds of the rows are one trajectory, some rows have none."""
    rng = random.Random(seed)
    return [(rng.choice([7, 7, 7, 7, 1, 2, None]), k, rng.randint(-1, 2), float(rng.randint(0, 3))) for k in range(n)]


@pytest.mark.parametrize("block", [5, 16, 1 << 16])
def test_halo_pairs_are_sequence_pairs(spark, block):
    df = spark.createDataFrame(walks(), "traj_id long, frame int, state int, weight double")
    numbered = number_rows(df, ["traj_id", "frame"])
    assert sorted(r["row_id"] for r in numbered.collect()) == list(range(400))
    got = halo_pairs(numbered, [1, 2, 5], ["state", "weight"], block=block)
    want = sequence_pairs(numbered.where("traj_id is not null"), [1, 2, 5], ["state", "weight"])
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_number_rows(spark):
    df = spark.createDataFrame([(k % 7, -k, "x") for k in range(1000)], "a int, b int, c string").repartition(9)
    got = [(r["a"], r["b"]) for r in number_rows(df, ["a", "b"]).orderBy("row_id").collect()]
    assert got == sorted(got) and len(got) == 1000
    assert number_rows(df.limit(0), ["a"]).count() == 0
    nulls = number_rows(spark.createDataFrame([(None,), (3,), (3,), (1,)], "a int"), ["a"])
    assert [r["a"] for r in nulls.orderBy("row_id").collect()] == [None, 1, 3, 3]
    with pytest.raises(ValueError, match="block"):
        halo_pairs(nulls.withColumn("traj_id", F.lit(1)), [9], ["a"], block=4)


# ---- transition report -------------------------------------------------------------------

CONFIG = {"traj": "user", "order": ["at"], "label": "kind", "states": ["a", "b"], "weight": "w", "weightless": ["b0"], "lags": [1, 2], "blocks": 3}


def slow_report(rows):
    paths = defaultdict(list)
    for user, at, kind, w in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        w = 0.0 if kind == "b0" or w is None or w != w or w < 0 else w
        paths[user].append(({"a": 0, "b": 1}.get(kind, -1), w))
    c, n = np.zeros((3, 3, 2, 2)), np.zeros((3, 2, 2), int)
    for user, path in paths.items():
        for lag in (1, 2):
            for (s, w), (t, _) in zip(path, path[lag:], strict=False):
                if user is not None and s >= 0 and t >= 0 and w > 0:
                    c[lag, user % 3, s, t] += w
                    n[lag, s, t] += 1
    out = {}
    t1 = c[1].sum(0) / c[1].sum((0, 2))[:, None]
    for lag in (1, 2):
        total = c[lag].sum(0)
        p = total / total.sum(1, keepdims=True)
        less = np.stack([(total - c[lag, b]) / (total - c[lag, b]).sum(1, keepdims=True) for b in range(3)])
        for i in range(2):
            for j in range(2):
                out[lag, i, j] = (n[lag, i, j], total[i, j], p[i, j], np.sqrt(2 * less[:, i, j].var()), np.linalg.matrix_power(t1, lag)[i, j])
    return out


def test_msm_report_equals_brute_force_and_reruns(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, 2, 3, 4, 4, 4, None]), k, rng.choice(["a", "b", "b0", "x", None]), rng.choice([1.0, 2.5, 0.0, None, float("nan"), -1.0])) for k in range(900)]
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame(rows, "user long, at int, kind string, w double").selectExpr("*", "1 as state", "2 as row_id", "3 as lag").repartition(5).write.parquet(src)
    before = spark.conf.getAll
    said = msm_report.run(spark, src, out, CONFIG)
    assert said == {"frames": 900, "report": 8} and spark.conf.getAll == before
    first = sorted(spark.read.parquet(f"{out}/report").collect(), key=lambda r: (r["lag"], r["i"], r["j"]))
    for (lag, i, j), want in slow_report(rows).items():
        r = next(r for r in first if (r["lag"], r["i"], r["j"]) == (lag, i, j))
        assert (r["n_pairs"], r["count"], r["p"], r["p_std"], r["p_ck"]) == pytest.approx(want)
    assert msm_report.run(spark, src, out, CONFIG) == said
    again = sorted(spark.read.parquet(f"{out}/report").collect(), key=lambda r: (r["lag"], r["i"], r["j"]))
    assert [tuple(r)[:4] for r in again] == [tuple(r)[:4] for r in first] and all(a["p"] == pytest.approx(b["p"], rel=1e-12) for a, b in zip(again, first, strict=True))


def test_msm_report_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "user long, at int, kind string, w double").write.parquet(f"{tmp_path}/in")
    assert msm_report.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", CONFIG)["report"] == 8
    assert spark.read.parquet(f"{tmp_path}/out/report").where("p is not null or p_std is not null or p_ck is not null").count() == 0


# ---- dialogue flow -----------------------------------------------------------------------

FLOW = {"roles": ["user", "bot"], "long_from_words": 3, "lags": [1, 2], "span": 5, "files_per_batch": 2}
KIND = "conv_id long, turn long, role string, text string"


def add(spark, rows, path):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)


def turns(seed, ids):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "bot", "tool", None]), rng.choice(["hi", "one two three four", "", None, "a b c"])) for c in ids for t in range(rng.randint(1, 6))]


def slow_flow(rows):
    """``rows`` in order of arrival; a later one replaces an earlier one of the same turn."""
    kept = {(c, t): (role, text) for c, t, role, text in rows if c is not None}
    paths = defaultdict(list)
    for (c, _), (role, text) in sorted(kept.items()):
        words = len((text or "").split())
        paths[c].append(({"user": 0, "bot": 2}.get(role, -1), words))
        if paths[c][-1][0] >= 0:
            paths[c][-1] = (paths[c][-1][0] + (words >= 3), words)
    out = defaultdict(lambda: [0, 0.0])
    for path in paths.values():
        for lag in (0, 1, 2):
            for (s, w), (t, _) in zip(path, path[lag:], strict=False):
                if lag == 0 or (s >= 0 and t >= 0 and w > 0):
                    out[lag, s, t][0] += 1
                    out[lag, s, t][1] += w
    return {k: tuple(v) for k, v in out.items()}


def flow(spark, out):
    return {(r["lag"], r["i"], r["j"]): (r["n_pairs"], r["count"]) for r in spark.read.parquet(f"{out}/report").collect()}


def test_dialogue_flow_over_growing_input(spark, tmp_path):
    src, out, marks = (f"{tmp_path}/{x}" for x in ("in", "out", "marks"))
    first = turns(1, range(12)) + [(None, 0, "user", "lost")]
    add(spark, first, src)
    assert dialogue_flow.run(spark, src, out, marks, FLOW)["new_rows"] == len(first) - 1
    assert flow(spark, out) == slow_flow(first)
    untouched = spark.read.parquet(f"{out}/counts/span=0").inputFiles()
    # late turns of an old dialogue, a turn that comes again, new dialogues
    later = [(6, 2, "bot", "replaced now by this"), (7, 40, "user", "late but a long one"), *turns(2, range(20, 33))]
    add(spark, later, src)
    assert dialogue_flow.run(spark, src, out, marks, FLOW)["new_rows"] == len(later)
    assert flow(spark, out) == slow_flow(first + later)
    assert spark.read.parquet(f"{out}/counts/span=0").inputFiles() == untouched  # its files were not written again
    report = spark.read.parquet(f"{out}/report")
    assert all(abs(r["s"] - 1) < 1e-12 for r in report.where("lag > 0 and p is not null").groupBy("lag", "i").agg(F.sum("p").alias("s")).collect())
    assert dialogue_flow.run(spark, src, out, marks, FLOW)["new_rows"] == 0
    assert flow(spark, out) == slow_flow(first + later)


def test_dialogue_flow_after_a_failure(spark, tmp_path, monkeypatch):
    """The batch that failed between its two writes is taken again and counted once."""
    src, out, marks = (f"{tmp_path}/{x}" for x in ("in", "out", "marks"))
    rows = turns(5, range(9))
    add(spark, rows, src)

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(dialogue_flow, "span_counts", fails)
        with pytest.raises(Exception, match="lost"):
            dialogue_flow.run(spark, src, out, marks, FLOW)
    assert dialogue_flow.run(spark, src, out, marks, FLOW)["new_rows"] == len(rows)
    assert flow(spark, out) == slow_flow(rows)


def test_dialogue_flow_of_nothing_and_of_a_file(spark, tmp_path):
    src, out, marks = (f"{tmp_path}/{x}" for x in ("in", "out", "marks"))
    os.makedirs(src)
    assert dialogue_flow.run(spark, src, out, marks, FLOW) == {"new_rows": 0, "report": 0}
    got = dialogue_flow.run(spark, f"{DATA}/conversations.parquet", f"{tmp_path}/o2", f"{tmp_path}/m2", dialogue_flow.shipped_config(dialogue_flow.__file__))
    assert got["new_rows"] == spark.read.parquet(f"{DATA}/conversations.parquet").count()


def test_command_line(spark, tmp_path):
    del spark
    config = json.loads(open(f"{REPO}/jobs/msm_report.json").read()) | {"lags": [3]}
    (tmp_path / "own.json").write_text(json.dumps(config))
    call = [sys.executable, "-m", "jobs.msm_report", "--input", f"{DATA}/events.parquet", "--output", f"{tmp_path}/out", "--config", f"{tmp_path}/own.json"]
    done = subprocess.run(call, cwd=REPO, capture_output=True, text=True, timeout=200, check=True)
    assert "wrote 9 rows" in done.stderr and os.path.isdir(tmp_path / "out/report/lag=3")
