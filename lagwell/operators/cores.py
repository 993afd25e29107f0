"""Cores of macrostates: density, the densest rows, the pockets they form, and what is told about each.

All states go through every step together, keyed by the state. Only the
references of the densities and the centers of the cores, both bounded and
checked, are held by every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.operators.cluster import _matrix, _shipped, distances, few_rows, nearest_centers, weighted_sample
from lagwell.operators.frames import number_rows
from lagwell.operators.graph import connected_components
from lagwell.operators.neighbours import nearest
from lagwell.operators.quantiles import exact_quantiles, ranked_within
from lagwell.plans.lineage import materialize


@dataclass(frozen=True)
class CoreSettings:
    """``references`` of a state (drawn by weight) and ``k`` give the density; ``fraction`` of a state's rows (``by='count'``) or
    weight (``by='weight'``) are its candidates. ``mode='top_density'`` labels them all, ``'density_connected'`` one pocket of
    their neighbour graph: the one of the densest row or, with ``split``, each, densest first, ``max_pockets`` of a state at
    most. Edges join ``graph_k`` nearest candidates up to ``max_edge_distance`` or, without one, ``edge_scale`` times the
    ``edge_quantile`` of the candidates' k-th distances. Pockets under ``min_size`` rows do not count."""

    k: int = 25
    references: int = 5000
    fraction: float = 0.05
    by: str = "count"
    mode: str = "density_connected"
    graph_k: int = 10
    max_edge_distance: float | None = None
    edge_scale: float = 2.5
    edge_quantile: float = 0.9
    min_size: int = 1
    split: bool = False
    max_pockets: int | None = None
    standardize: bool = True
    eps: float = 1e-8
    seed: int = 0

    def __post_init__(self) -> None:
        if self.mode not in ("top_density", "density_connected") or self.by not in ("count", "weight"):
            raise ValueError("mode is top_density or density_connected, by is count or weight")


def scaled(df: DataFrame, center: np.ndarray, scale: np.ndarray, x: str, out: str) -> DataFrame:
    c, s = F.array(*map(F.lit, center.tolist())), F.array(*map(F.lit, scale.tolist()))
    return df.withColumn(out, F.transform(x, lambda v, i: (v - F.get(c, i)) / F.get(s, i)))


def standard_scale(df: DataFrame, x: str, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each number of ``x``; a deviation under ``eps`` counts as 1."""
    d = len(df.select(x).first()[0])
    r = df.agg(*(f(F.get(x, F.lit(i))).alias(f"{n}{i}") for i in range(d) for n, f in (("c", F.avg), ("s", F.stddev_pop)))).first()
    scale = np.array([r[f"s{i}"] for i in range(d)])
    return np.array([r[f"c{i}"] for i in range(d)]), np.where(scale < eps, 1.0, scale)


def state_density(df: DataFrame, references: dict[int, tuple[np.ndarray, np.ndarray]], k: int, x: str = "x", label: str = "macro") -> DataFrame:
    """Add ``density`` and ``kth`` of each row against its own state's ``(points, weights)``, all states in one pass.

    The density is the weight of the k nearest references, as a share of all
    of the state's, over the k-th distance to the power of the dimension. A
    row whose state has no references gets 0 and an infinite distance.
    """
    known = {s: (np.ascontiguousarray(p, float), np.asarray(w, float) / np.sum(w)) for s, (p, w) in references.items()}
    _shipped(np.concatenate([p.ravel() for p, _ in known.values()]) if known else np.zeros(0))
    largest = max((len(p) for p, _ in known.values()), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in few_rows(batch, largest, 1024):
                state = part.column(label).to_numpy(zero_copy_only=False)
                density, kth = np.zeros(len(state)), np.full(len(state), np.inf)
                for s in np.unique(state).tolist():
                    if s not in known:
                        continue
                    points, weights = known[s]
                    mine = np.flatnonzero(state == s)
                    d2 = distances(_matrix(part.column(x).take(pa.array(mine)), points.shape[1]), points)
                    n = min(k, len(points))
                    near = np.argpartition(d2, n - 1, axis=1)[:, :n]
                    r = np.sqrt(np.take_along_axis(d2, near, 1).max(1))
                    log = np.log(np.maximum(weights[near].sum(1), 1e-300)) - points.shape[1] * np.log(np.maximum(r, 1e-12))
                    density[mine], kth[mine] = np.exp(np.clip(log, -745, 709)), r
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(density), pa.array(kth)], [*part.schema.names, "density", "kth"])

    return df.mapInArrow(run, df.withColumns({"density": F.lit(0.0), "kth": F.lit(0.0)}).schema)


def pockets(core: DataFrame, s: CoreSettings) -> DataFrame:
    """``(row_id, pocket)`` of the candidates ``(row_id, z, macro, kth)``: components of each state's neighbour graph, named by their smallest row."""
    if s.mode == "top_density":
        return core.select("row_id", F.col("macro").cast("long").alias("pocket"))
    near = nearest(core, s.graph_k, "z", by="macro").select(F.col("row_id").alias("a"), F.explode(F.arrays_zip("ids", "dists")).alias("n"))
    if s.max_edge_distance is not None:
        short = near.where(F.col("n.dists") <= s.max_edge_distance)
    else:
        finite = core.where("kth > 0 and kth < double('infinity')")
        cut = exact_quantiles(finite, "kth", [s.edge_quantile], ["macro"]).select("macro", (F.col("quantiles")[0] * s.edge_scale).alias("cut"))
        owned = near.join(core.select(F.col("row_id").alias("a"), "macro"), "a").join(cut, "macro", "left")
        short = owned.where("cut is null or n.dists <= cut")
    found = connected_components(short.select("a", F.col("n.ids").alias("b")))
    return core.select("row_id").join(found.withColumnRenamed("id", "row_id"), "row_id", "left").select("row_id", F.coalesce("component", "row_id").alias("pocket"))


def _chosen(core: DataFrame, grouped: DataFrame, s: CoreSettings) -> DataFrame:
    """``(macro, pocket, place, density_threshold, center_row)`` of the pockets that become cores; a state none of whose pockets is large enough keeps its densest row alone (``pocket`` NULL)."""
    ahead = F.struct(-F.col("density"), "row_id")
    rows = core.join(grouped, "row_id")
    every = rows.groupBy("macro", "pocket").agg(F.count("*").alias("n"), F.max("density").alias("top"), F.min("density").alias("density_threshold"), F.min_by("row_id", ahead).alias("center_row"))
    fit = every.where(F.col("n") >= s.min_size)
    first = core.groupBy("macro").agg(F.min_by("row_id", ahead).alias("center_row"), F.max("density").alias("density_threshold"))
    if s.split:
        placed = ranked_within(fit, ["macro"], [F.desc("top"), "pocket"]).withColumnRenamed("_rank", "place")
        kept = placed if s.max_pockets is None else placed.where(F.col("place") <= s.max_pockets)
    else:
        # the pocket of the state's densest row comes before all others, then the densest
        home = first.select("macro", F.col("center_row").alias("_home"))
        best = fit.join(home, "macro").withColumn("_order", F.struct((F.col("center_row") != F.col("_home")).cast("int"), -F.col("top"), "pocket"))
        kept = best.groupBy("macro").agg(F.min_by(F.struct("pocket", "density_threshold", "center_row"), "_order").alias("p")).select("macro", "p.*").withColumn("place", F.lit(1))
    kept = kept.select("macro", "pocket", F.col("place").cast("long").alias("place"), "density_threshold", "center_row")
    alone = first.join(kept, "macro", "left_anti").select("macro", F.lit(None).cast("long").alias("pocket"), F.lit(1).cast("long").alias("place"), "density_threshold", "center_row")
    return kept.union(alone)


def label_cores(frames: DataFrame, settings: CoreSettings | None = None, x: str = "x") -> tuple[DataFrame, DataFrame]:
    """``(labelled, centers)`` from frames with ``row_id``, ``x``, ``weight`` and a ``macro`` state (negative: none).

    ``labelled`` adds ``state`` (the core's number, -1 outside), ``density``
    (0 without weight or state), ``free_energy`` (minus its logarithm, from
    0; NULL where the density is 0) and ``dist`` to the nearest center.
    ``centers`` has a row a core: ``state``, ``macro``, ``center_row``, ``x``,
    ``density``, ``free_energy``, ``density_threshold`` (the least of its
    rows), ``dist_threshold`` (the largest distance of its rows) and
    ``n_frames``. Cores are numbered by state, then by density. Rows without
    weight take part in distances alone. Equal densities go by ``row_id``.
    """
    s = settings or CoreSettings()
    own = frames.where("weight > 0 and macro >= 0")
    weighty = frames.where("weight > 0")
    if own.isEmpty():
        raise ValueError("no frame of positive weight has a macrostate")
    dims = len(own.select(x).first()[0])
    center, scale = standard_scale(weighty, x, s.eps) if s.standardize else (np.zeros(dims), np.ones(dims))
    points = materialize(scaled(own.select("row_id", x, "weight", F.col("macro").cast("long").alias("macro")), center, scale, x, "z").select("row_id", "z", "weight", "macro"))
    drawn: dict[int, tuple[list, list]] = {}
    for r in weighted_sample(points, s.references, seed=s.seed, by=("macro",)).select("macro", "z", "weight", "row_id").orderBy("row_id").collect():
        at, w = drawn.setdefault(r["macro"], ([], []))
        at.append(r["z"])
        w.append(r["weight"])
    dense = materialize(state_density(points, {m: (np.array(p), np.array(w)) for m, (p, w) in drawn.items()}, s.k, "z"))
    ranked = ranked_within(dense, ["macro"], [F.desc("density"), F.col("row_id")], "weight")
    near = F.col("_rank") <= F.ceil(F.col("_size") * s.fraction) if s.by == "count" else F.col("_upto") / F.col("_mass") <= s.fraction
    core = materialize(ranked.where((near | (F.col("_rank") == 1)) & F.lit(s.fraction > 0)).select(*dense.columns))
    grouped = materialize(pockets(core, s))
    units = materialize(number_rows(_chosen(core, grouped, s), ["macro", "place"], "state").withColumn("state", F.col("state").cast("int")))
    members = core.join(grouped, "row_id").join(units.where("pocket is not null").select("macro", "pocket", "state"), ["macro", "pocket"]).select("row_id", "state")
    members = members.union(units.where("pocket is null").select(F.col("center_row").alias("row_id"), "state"))
    lowest = dense.agg(F.min(F.when(F.col("density") > 0, -F.ln(F.greatest("density", F.lit(1e-300))))).alias("_lowest"))
    energy = F.when(F.col("density") > 0, -F.ln(F.greatest("density", F.lit(1e-300))) - F.col("_lowest"))
    told = dense.crossJoin(F.broadcast(lowest)).select("row_id", "density", energy.alias("free_energy"))
    spots = units.join(told.withColumnRenamed("row_id", "center_row"), "center_row").join(frames.select(F.col("row_id").alias("center_row"), x), "center_row").orderBy("state").collect()
    at = (np.array([r[x] for r in spots], float).reshape(-1, dims) - center) / scale
    every = scaled(frames, center, scale, x, "_z")
    away = nearest_centers(every, at, "_z", label="_cell") if len(at) else every.withColumn("dist2", F.lit(None).cast("double")).withColumn("_cell", F.lit(-1))
    joined = away.join(told, "row_id", "left").join(members, "row_id", "left")
    labelled = materialize(joined.select(*frames.columns, F.coalesce("state", F.lit(-1)).alias("state"), F.coalesce("density", F.lit(0.0)).alias("density"), "free_energy", F.sqrt("dist2").alias("dist")))
    sizes = labelled.where("state >= 0").groupBy("state").agg(F.max("dist").alias("dist_threshold"), F.count("*").alias("n_frames"))
    kind = "state int, macro long, center_row long, x array<double>, density double, free_energy double, density_threshold double"
    centers = frames.sparkSession.createDataFrame([(r["state"], r["macro"], r["center_row"], [float(v) for v in r[x]], r["density"], r["free_energy"], r["density_threshold"]) for r in spots], kind)
    return labelled, centers.join(sizes, "state")
