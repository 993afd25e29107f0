"""Frame operators on inline fixtures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwell.operators import frames as P
from lagwell.operators import lag as L
from lagwell.operators.graph import connected_components


def test_burn_in_blocks(spark):
    df = spark.createDataFrame(list(enumerate([4, 4, 4, 9, 9, 4, 4])), "row_id long, traj_id long")
    kept = [r["keep"] for r in P.burn_in(df, 2, []).orderBy("row_id").collect()]
    assert kept == [False, False, True, False, False, False, False]
    with pytest.raises(ValueError, match="nonnegative"):
        P.burn_in(df, -1, [])


def test_weights(spark):
    df = spark.createDataFrame([(0, 0, 0, float("nan")), (1, 0, 1, -2.0), (2, 0, 2, None), (3, 0, 3, 4.0)], "row_id long, traj_id long, frame int, weight double")
    assert [r["weight"] for r in P.frame_table(df).orderBy("row_id").collect()] == [0, 0, 0, 4]
    assert [r["weight"] for r in P.frame_table(df.where("row_id < 3")).orderBy("row_id").collect()] == [1, 1, 1]


def test_lag_meanings_differ_on_gaps(spark):
    rows = [(0, 1, 0), (1, 1, 1), (2, 1, 3), (3, 2, 0), (4, 1, 4)]
    df = spark.createDataFrame(rows, "row_id long, traj_id long, frame int").withColumn("id", F.col("row_id"))
    pairs = lambda d: sorted((r["row_id"], r["id_tau"]) for r in d.collect())
    assert pairs(L.positional_pairs(df, 1, ["id"])) == [(0, 1), (1, 2)]
    assert pairs(L.positional_pairs(df, 2, ["id"])) == [(0, 2), (2, 4)]
    assert pairs(L.keyed_pairs(df, [1], ["id"])) == [(0, 1), (2, 4)]
    assert pairs(L.sequence_pairs(df, [1], ["id"])) == [(0, 1), (1, 2), (2, 4)]
    assert len(pairs(L.positional_pairs(df, 1, ["id"], allow_cross=True))) == 4


def test_lag_timing():
    assert L.lag_timing(10, 5, 0.5) == (2, 5.0)
    with pytest.raises(ValueError):
        L.lag_timing(7, 5)


def test_wrapping(spark):
    x = np.linspace(-500, 500, 41)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = np.array([r[0] for r in df.select(P.minimum_image(F.col("v"), 360.0)).collect()])
    assert np.allclose(got, (x + 180) % 360 - 180)
    twice = df.select(P.wrap(P.wrap(F.col("v"), -180.0, 180.0), -180.0, 180.0).alias("a"), P.wrap(F.col("v"), -180.0, 180.0).alias("b")).where("a != b")
    assert twice.isEmpty()


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (None, 3), (5, 4)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + k] == 1000 for k in range(50)) and len(got) == 251
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_random(spark):
    rng = np.random.default_rng(4)
    edges = [tuple(map(int, rng.integers(0, 300, 2))) for _ in range(220)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == find(i) for i in got)
