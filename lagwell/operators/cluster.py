"""Nearest centers, k-means, neighbour density, cores and components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwell.functions.arrays import square_distance
from lagwell.operators.neighbours import nearest
from lagwell.operators.quantiles import exact_quantiles, joined_on, ranked_within
from lagwell.plans.lineage import materialize

#: Most numbers in a set of centers or references that travels with a task (32 MB).
MOST_SHIPPED = 4_000_000


def _shipped(points: np.ndarray) -> np.ndarray:
    if points.size > MOST_SHIPPED:
        raise ValueError(f"{points.size} numbers exceed what is sent to every task; sample the references or raise MOST_SHIPPED")
    return np.ascontiguousarray(points, float)


#: Distances that a task holds at once (16 MB).
MOST_HELD = 2_000_000


def few_rows(batch: pa.RecordBatch, references: int, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows, fewer where their distances to the references would pass ``MOST_HELD``."""
    step = max(1, min(most, MOST_HELD // max(1, references)))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, d)


def nearest_centers(df: DataFrame, centers: Sequence[Sequence[float]], x: str = "x", periods: Sequence[float] | None = None, label: str = "cell") -> DataFrame:
    """``cell`` (first index on ties) and ``dist2`` of each point; differences wrap where a period is positive.

    A few dozen centers of a few numbers stay in the JVM as literals; larger
    sets go to Arrow batches, one matrix product each.
    """
    c = _shipped(np.asarray(centers, float))
    if c.size <= 96 and periods is None:
        options = F.array(*(F.struct(square_distance(F.col(x), F.array(*map(F.lit, row))).alias("d2"), F.lit(k).alias("k")) for k, row in enumerate(c.tolist())))
        best = F.array_min(options)
        return df.withColumn(label, best.k).withColumn("dist2", best.d2)
    period = None if periods is None else np.asarray(periods, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in few_rows(batch, len(c)):
                points = _matrix(part.column(x), c.shape[1])
                d2 = distances(points, c, period)
                cell = d2.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d2[np.arange(len(cell)), cell])], [*part.schema.names, label, "dist2"])

    schema = df.withColumn(label, F.lit(0).cast("int")).withColumn("dist2", F.lit(0.0)).schema
    return df.mapInArrow(run, schema)


def distances(points: np.ndarray, centers: np.ndarray, period: np.ndarray | None = None) -> np.ndarray:
    """Squared distances, with minimum images where a period is positive."""
    out = np.zeros((len(points), len(centers)))
    for k in range(points.shape[1]):
        d = points[:, k, None] - centers[:, k]
        if period is not None and period[k] > 0:
            d = (d + period[k] / 2) % period[k] - period[k] / 2
        out += d * d
    return out


def initial_centers(df: DataFrame, k: int, x: str = "x", weight: str = "weight", seed: int = 0) -> np.ndarray:
    """A weighted draw without replacement: the k largest of ln(u)/w with u hashed from the row id."""
    u = (F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    drawn = df.where(F.col(weight) > 0).withColumn("_key", F.ln(u) / F.col(weight)).orderBy(F.desc("_key"), "row_id").limit(k)
    return np.array([r[0] for r in drawn.select(x).collect()], float)


def kmeans(df: DataFrame, k: int, x: str = "x", weight: str = "weight", rounds: int = 100, seed: int = 0, tol: float = 1e-10, sample: int | None = None) -> tuple[np.ndarray, DataFrame]:
    """(centers, labelled rows) by Lloyd rounds: assignment and partial sums on the cluster, k means on the driver.

    An empty cluster keeps its center. Sums per cluster and dimension are
    partially aggregated, so a round shuffles k x d rows per task. With
    ``sample``, the rounds run over so many rows drawn by weight; every row
    is labelled all the same.
    """
    points = materialize(df if sample is None else weighted_sample(df, sample, weight, seed))
    centers = initial_centers(points, k, x, weight, seed)
    for _ in range(rounds):
        cell = nearest_centers(points.select(x, weight), centers, x)
        sums = cell.select("cell", weight, F.posexplode(x).alias("dim", "v")).groupBy("cell", "dim").agg(F.sum(F.col("v") * F.col(weight)).alias("s"), F.sum(weight).alias("w")).collect()
        fresh = centers.copy()
        for r in sums:
            if r["w"] > 0:
                fresh[r["cell"], r["dim"]] = r["s"] / r["w"]
        moved = float(np.abs(fresh - centers).max()) if len(centers) else 0.0
        centers = fresh
        if moved <= tol:
            break
    return centers, nearest_centers(points if sample is None else df, centers, x)


def keyed_nearest(df: DataFrame, centers: dict[int, np.ndarray], key: str = "state", x: str = "x", label: str = "cell") -> DataFrame:
    """``cell`` of each row among the centers of its own ``key``, the first on ties; NULL where the key has none."""
    known = {k: np.ascontiguousarray(c, float) for k, c in centers.items()}
    _shipped(np.concatenate([c.ravel() for c in known.values()]) if known else np.zeros(0))
    largest = max(map(len, known.values()), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in few_rows(batch, largest):
                owner = part.column(key).to_numpy(zero_copy_only=False)
                cell = np.full(len(owner), -1, np.int32)
                for k in np.unique(owner).tolist():
                    if k in known:
                        mine = np.flatnonzero(owner == k)
                        cell[mine] = distances(_matrix(part.column(x).take(pa.array(mine)), known[k].shape[1]), known[k]).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, mask=cell < 0)], [*part.schema.names, label])

    return df.mapInArrow(run, df.withColumn(label, F.lit(None).cast("int")).schema)


def keyed_kmeans(df: DataFrame, sizes: dict[int, int], key: str = "state", x: str = "x", rounds: int = 25, seed: int = 0) -> tuple[dict[int, np.ndarray], DataFrame]:
    """(centers of every key, labelled rows): k-means inside every group of ``key`` at once, ``sizes[key]`` centers each.

    A round assigns every row among its own group's centers and sums by
    (group, center, dimension), partially aggregated; only the means reach
    the driver. The first centers are rows drawn by the hash of their ids.
    An empty cluster keeps its center. Groups of no size get no label.
    """
    points = materialize(df)
    asked = max(sizes.values(), default=0)
    drawn: dict[int, list] = {}
    if asked:
        draw = weighted_sample(points.select("row_id", key, x, F.lit(1.0).alias("_one")), asked, "_one", seed, by=(key,))
        for r in draw.select(key, x, "row_id").orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").collect():
            if len(drawn.setdefault(r[key], [])) < sizes.get(r[key], 0):
                drawn[r[key]].append(r[x])
    centers = {k: np.array(v, float) for k, v in drawn.items() if v}
    for _ in range(rounds if centers else 0):
        sums = keyed_nearest(points.select(key, x), centers, key, x).where("cell is not null").select(key, "cell", F.posexplode(x).alias("dim", "v")).groupBy(key, "cell", "dim").agg(F.avg("v").alias("m")).collect()
        fresh = {k: c.copy() for k, c in centers.items()}
        for r in sums:
            fresh[r[key]][r["cell"], r["dim"]] = r["m"]
        moved = max(float(np.abs(fresh[k] - c).max()) for k, c in centers.items())
        centers = fresh
        if moved <= 1e-12:
            break
    return centers, keyed_nearest(points, centers, key, x)


def principal_axes(df: DataFrame, n: int, x: str = "x", weight: str = "weight") -> tuple[np.ndarray, np.ndarray]:
    """(weighted mean, [n, d] axes of largest variance, largest first) from one aggregation of d(d + 3)/2 sums.

    An axis points to the side of its largest component.
    """
    d = len(df.select(x).first()[0])
    v, w = [F.get(x, F.lit(i)) for i in range(d)], F.col(weight)
    sums = df.agg(F.sum(w).alias("w"), *(F.sum(w * v[i]).alias(f"m{i}") for i in range(d)), *(F.sum(w * v[i] * v[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d))).first()
    mean = np.array([sums[f"m{i}"] for i in range(d)]) / sums["w"]
    second = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / sums["w"]
    _, axes = np.linalg.eigh(second - np.outer(mean, mean))
    axes = axes[:, ::-1].T[:n]
    side = np.sign(np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1))
    return mean, axes * side


def projected(df: DataFrame, mean: np.ndarray, axes: np.ndarray, x: str = "x", out: str = "x") -> DataFrame:
    """The coordinates along the axes, as JVM arithmetic."""
    rows = [sum(((F.get(x, F.lit(i)) - float(mean[i])) * float(a) for i, a in enumerate(axis)), F.lit(0.0)) for axis in axes]
    return df.withColumn(out, F.array(*rows))


def beyond_quantile(labelled: DataFrame, quantile: float, label: str = "cell") -> DataFrame:
    """-1 for points farther from their center than the quantile of their cluster's distances."""
    cut = exact_quantiles(labelled.withColumn("_d", F.sqrt("dist2")), "_d", [quantile], [label]).select(label, F.col("quantiles")[0].alias("_cut"))
    return labelled.join(cut, label).withColumn(label, F.when(F.sqrt("dist2") <= F.col("_cut"), F.col(label)).otherwise(-1)).drop("_cut")


def weighted_sample(df: DataFrame, n: int, weight: str = "weight", seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """``n`` rows (of each group) drawn without replacement with odds by weight; reproducible from the row ids."""
    u = (F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = df.where(F.col(weight) > 0).withColumn("_key", F.ln(u) / F.col(weight))
    if not by:
        return keyed.orderBy(F.desc("_key"), "row_id").limit(n).drop("_key")
    # a sketch of each group's keys leaves a few times n rows of it, of which the exact n are taken
    shares = [2.0**-i for i in range(1, 11)]
    sketch = keyed.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_key", [1 - s for s in shares], 20_000).alias("_cuts"))
    enough = F.filter(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("_cuts").alias("cut")), lambda c: (c.share - 1e-4) * F.col("_n") > n)
    cut = sketch.select(*by, F.element_at(F.concat(F.array(F.lit(None).cast("double")), F.transform(enough, lambda c: c.cut)), -1).alias("_cut"))
    few = joined_on(keyed, cut, by).where("_cut is null or _key >= _cut").drop("_cut")
    return ranked_within(few, by, [F.desc("_key"), F.col("row_id")]).where(F.col("_rank") <= n).drop("_rank", "_size", "_key")


def knn(df: DataFrame, references: np.ndarray, reference_ids: np.ndarray, k: int, x: str = "x", exclude_self: bool = True) -> DataFrame:
    """``ids`` and ``dists`` of the k nearest references of each row, nearest first, lower id on ties."""
    ref, ids = _shipped(references), np.asarray(reference_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in few_rows(batch, len(ref), 1024):
                d2 = distances(_matrix(part.column(x), ref.shape[1]), ref)
                if exclude_self:
                    d2[part.column("row_id").to_numpy()[:, None] == ids[None, :]] = np.inf
                order = np.lexsort((np.broadcast_to(ids, d2.shape), d2), axis=1)[:, :k]
                found = np.take_along_axis(d2, order, 1)
                yield pa.RecordBatch.from_arrays([part.column("row_id"), pa.array(list(ids[order].astype(np.int64))), pa.array(list(np.sqrt(found)))], ["row_id", "ids", "dists"])

    return df.select("row_id", x).mapInArrow(run, "row_id long, ids array<long>, dists array<double>")


def knn_all(df: DataFrame, k: int, x: str = "x", block: int = 4096) -> DataFrame:
    """:func:`knn` with every other row as a reference, exact; cells that cannot hold a nearer row are not visited."""
    return nearest(df, k, x, block=block)


def knn_density(df: DataFrame, references: np.ndarray, weights: np.ndarray, k: int, x: str = "x") -> DataFrame:
    """Add ``density``: sum of the k nearest references' weights over r_k^min(d, 6), in logs and clipped to what a double holds."""
    ref, w = _shipped(references), np.asarray(weights, float) / np.sum(weights)
    k = min(k, len(ref))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in few_rows(batch, len(ref), 1024):
                d2 = distances(_matrix(part.column(x), ref.shape[1]), ref)
                order = np.argpartition(d2, k - 1, axis=1)[:, :k]
                r = np.sqrt(np.take_along_axis(d2, order, 1).max(1))
                log = np.log(np.maximum(w[order].sum(1), 1e-300)) - min(ref.shape[1], 6) * np.log(np.maximum(r, 1e-300))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.exp(np.clip(log, -745, 709)))], [*part.schema.names, "density"])

    return df.mapInArrow(run, df.withColumn("density", F.lit(0.0)).schema)


def densest_fraction(df: DataFrame, fraction: float, mode: str = "count", by: str = "state") -> DataFrame:
    """The densest rows of each group: ceil(f n) of them, or those whose cumulative weight is at most f (at least one; the crossing row is out)."""
    ranked = ranked_within(df, [by], [F.desc("density"), F.col("row_id")], None if mode == "count" else "weight")
    if mode == "count":
        return ranked.where(F.col("_rank") <= F.ceil(F.col("_size") * fraction)).select(*df.columns)
    return ranked.where((F.col("_upto") / F.col("_mass") <= fraction) | (F.col("_rank") == 1)).select(*df.columns)


def weighted_core(df: DataFrame, fraction: float, by: str = "state", least: int = 1, most: int | None = None) -> DataFrame:
    """``core``: rows by falling density until their weight reaches the fraction, the crossing row included, within size limits."""
    ranked = ranked_within(df, [by], [F.desc("density"), F.col("row_id")], "weight")
    core = (F.col("_before") < F.col("_mass") * fraction) | (F.col("_rank") <= least)
    return ranked.select(*df.columns, (core if most is None else core & (F.col("_rank") <= most)).alias("core"))


def neighbour_edges(neighbours: DataFrame, scale: float = 2.5, quantile: float = 0.9, mutual: bool = False) -> DataFrame:
    """``(a, b)``, a < b, of neighbours within scale times the quantile of the finite positive k-th distances."""
    kth = neighbours.select(F.element_at("dists", -1).alias("d")).where("d > 0 and d < double('infinity')")
    cut = exact_quantiles(kth, "d", [quantile]).select((F.col("quantiles")[0] * scale).alias("cut"))
    long = neighbours.select("row_id", F.explode(F.arrays_zip("ids", "dists")).alias("n")).crossJoin(F.broadcast(cut)).where("n.dists <= cut")
    pairs = long.select(F.least("row_id", "n.ids").alias("a"), F.greatest("row_id", "n.ids").alias("b")).where("a != b")
    return pairs.groupBy("a", "b").count().where(F.col("count") >= (2 if mutual else 1)).select("a", "b")


def center_frames(df: DataFrame, by: str = "state") -> DataFrame:
    """The row of smallest distance of each labelled group, the first on ties."""
    best = df.where(F.col(by) >= 0).groupBy(by).agg(F.min(F.struct("dist", "row_id")).alias("b"))
    return best.select(by, F.col("b.row_id").alias("row_id"), F.col("b.dist").alias("dist"))


def renumber_by_population(df: DataFrame, label: str = "state") -> DataFrame:
    """``old -> new`` label, most frames first, then lower label; -1 stays -1."""
    n = df.where(F.col(label) >= 0).groupBy(label).count()
    return n.select(F.col(label).alias("old"), (F.row_number().over(W.orderBy(F.desc("count"), label)) - 1).cast("int").alias("new"), F.col("count").alias("n_frames"))
