"""Paths of images ``(path_id, image_id, x array, weight)``: smoothing, arcs, averages, channels."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwell.functions.arrays import square_distance
from lagwell.plans.lineage import discard, materialize


def _along() -> W:
    return W.partitionBy("path_id").orderBy("image_id")


def _every() -> W:
    return W.partitionBy("path_id")


def coarsen(images: DataFrame, stride: int = 1, n_images: int | None = None) -> DataFrame:
    """Every ``stride``-th image and the last; then ``n_images`` evenly spaced ones (places rounded half to even)."""
    n = F.count("*").over(_every())
    ranked = images.withColumn("_r", F.row_number().over(_along()) - 1).withColumn("_n", n)
    kept = ranked.where((F.pmod("_r", F.lit(stride)) == 0) | (F.col("_r") == F.col("_n") - 1))
    if n_images is not None:
        again = kept.withColumn("_r", F.row_number().over(_along()) - 1).withColumn("_n", n)
        places = F.transform(F.sequence(F.lit(0), F.lit(n_images - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / max(n_images - 1, 1)).cast("int"))
        kept = again.where((F.col("_n") <= n_images) | F.array_contains(places, F.col("_r")))
    return kept.withColumn("image_id", (F.row_number().over(_along()) - 1).cast("int")).drop("_r", "_n")


def smooth(images: DataFrame, window: int = 3, iterations: int = 1) -> DataFrame:
    """Centered moving average with the ends repeated beyond them and kept fixed."""
    if window % 2 == 0 or window < 1:
        raise ValueError("window must be odd")
    h = window // 2
    out = images
    for _ in range(iterations):
        first, last = F.first("x").over(_every().orderBy("image_id")), F.last("x").over(_along().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        around = [F.coalesce((F.lag if d < 0 else F.lead)("x", abs(d)).over(_along()), first if d < 0 else last) if d else F.col("x") for d in range(-h, h + 1)]
        flat = out.withColumn("_around", F.array(*around)).withColumn("_rank", F.row_number().over(_along())).withColumn("_n", F.count("*").over(_every()))
        mean = F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda k: F.aggregate("_around", F.lit(0.0), lambda a, v: a + F.get(v, k)) / window)
        out = flat.withColumn("x", F.when((F.col("_rank") == 1) | (F.col("_rank") == F.col("_n")), F.col("x")).otherwise(mean)).drop("_around", "_rank", "_n")
    return out


def arcs(images: DataFrame) -> DataFrame:
    """``arc``: length from the path's start; segments of at most 1e-14 add nothing."""
    step = F.sqrt(square_distance(F.col("x"), F.lag("x").over(_along())))
    return images.withColumn("_step", F.coalesce(F.when(step > 1e-14, step), F.lit(0.0))).withColumn("arc", F.sum("_step").over(_along().rowsBetween(W.unboundedPreceding, 0))).drop("_step")


def reparameterise(images: DataFrame, n_images: int) -> DataFrame:
    """Images at equal arc lengths by linear interpolation: each target joins the segment that holds it."""
    a = arcs(images).withColumn("next_arc", F.lead("arc").over(_along())).withColumn("next_x", F.lead("x").over(_along())).withColumn("length", F.max("arc").over(_every())).withColumn("_last", F.lead("image_id").over(_along()).isNull())
    place = F.transform(F.sequence(F.lit(0), F.lit(n_images - 1)), lambda k: F.struct(k.alias("k"), (k * F.col("length") / max(n_images - 1, 1)).alias("at")))
    inside = F.filter(place, lambda p: ((F.col("arc") <= p.at) & (p.at < F.col("next_arc")) & (p.k < n_images - 1)) | (F.col("_last") & ((p.at >= F.col("arc")) | (p.k == n_images - 1))))
    hit = a.select("path_id", "x", "next_x", "arc", "next_arc", F.explode(inside).alias("p"))
    f = (F.col("p.at") - F.col("arc")) / (F.col("next_arc") - F.col("arc"))
    value = F.when(F.col("next_x").isNull(), F.col("x")).otherwise(F.zip_with("x", "next_x", lambda u, v: u + (v - u) * f))
    return hit.select("path_id", F.col("p.k").alias("image_id"), value.alias("x"))


def unwrap(images: DataFrame, periods: Sequence[float]) -> DataFrame:
    """Cumulative minimum-image steps from the first image."""
    p = F.array(*map(F.lit, map(float, periods)))
    mini = lambda d, per: F.when(per > 0, F.pmod(d + per / 2, F.when(per > 0, per).otherwise(1.0)) - per / 2).otherwise(d)
    before = F.lag("x").over(_along())
    step = F.when(before.isNull(), F.col("x")).otherwise(F.zip_with(F.zip_with("x", before, lambda a, b: a - b), p, mini))
    out = images.withColumn("_step", step)
    gathered = F.collect_list("_step").over(_along().rowsBetween(W.unboundedPreceding, 0))
    zero = F.transform("x", lambda _: F.lit(0.0))
    return out.withColumn("x", F.aggregate(gathered, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))).drop("_step")


def periodic_segments(images: DataFrame, periods: Sequence[float]) -> DataFrame:
    """``segment``: a new one where any periodic axis jumps by more than half its period; segments of one image are dropped unless nothing else is left."""
    before = F.lag("x").over(_along())
    jumps = [F.abs(F.get("x", F.lit(k)) - F.get(before, F.lit(k))) > p / 2 for k, p in enumerate(periods) if p > 0]
    jump = jumps[0]
    for j in jumps[1:]:
        jump |= j
    out = images.withColumn("segment", F.sum(F.when(jump, 1).otherwise(0)).over(_along().rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    size = F.count("*").over(W.partitionBy("path_id", "segment"))
    out = out.withColumn("_n", size)
    return out.withColumn("_any", F.max("_n").over(_every())).where((F.col("_n") >= 2) | (F.col("_any") < 2)).drop("_n", "_any")


def center_path(images: DataFrame, by: Sequence[str] = ("cluster",)) -> DataFrame:
    """Weighted mean of each image over the paths of a group."""
    long = images.select(*by, "image_id", "weight", F.posexplode("x").alias("dim", "v"))
    m = long.groupBy(*by, "image_id", "dim").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("v"))
    return m.groupBy(*by, "image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s.v).alias("x"))


def periodic_mean(angle: Column, weight: Column, period: float) -> Column:
    """Aggregate: the weighted circular mean, in (-period/2, period/2]."""
    k = 2 * np.pi / period
    return F.atan2(F.sum(weight * F.sin(angle * k)), F.sum(weight * F.cos(angle * k))) / k


def path_rmsd(images: DataFrame, periods: Sequence[float] | None = None) -> DataFrame:
    """``(path_a, path_b, rmsd)`` over images and dimensions, a < b; the paths are the few that shooting keeps."""
    long = images.select("path_id", "image_id", F.posexplode("x").alias("dim", "v"))
    other = long.select(F.col("path_id").alias("path_b"), "image_id", "dim", F.col("v").alias("u"))
    d = F.col("v") - F.col("u")
    if periods:
        per = F.get(F.array(*map(F.lit, map(float, periods))), F.col("dim"))
        d = F.when(per > 0, F.pmod(d + per / 2, F.when(per > 0, per).otherwise(1.0)) - per / 2).otherwise(d)
    both = long.withColumnRenamed("path_id", "path_a").join(other, ["image_id", "dim"]).where("path_a < path_b")
    return both.groupBy("path_a", "path_b").agg(F.sqrt(F.avg(d * d)).alias("rmsd"))


def medoids(rmsd: DataFrame, weights: DataFrame) -> DataFrame:
    """The path of least weighted distance to the others (lower id on ties)."""
    both = rmsd.select(F.col("path_a").alias("path_id"), F.col("path_b").alias("other"), "rmsd").union(rmsd.select("path_b", "path_a", "rmsd"))
    cost = both.join(F.broadcast(weights.select(F.col("path_id").alias("other"), F.col("weight").alias("w"))), "other").groupBy("path_id").agg(F.sum(F.col("rmsd") * F.col("w")).alias("cost"))
    return cost.agg(F.min(F.struct("cost", "path_id")).alias("m")).select(F.col("m.path_id").alias("path_id"), F.col("m.cost").alias("cost"))


#: Paths of a block, of which any two meet in one task; clusters from which one task joins the rest; bytes of distances that a task writes, about.
PATHS, REST, STRIP = 256, 1024, 16 << 20


def _points_of(part: pa.Table) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """``(image, dimension)`` of each column, values and which of them a path has; an image that a path holds twice has two columns."""
    owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("v")).to_numpy())
    image, dim, v = (part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("image", "dim", "v"))
    order = np.lexsort((dim, image, owner))
    owner, image, dim, v = owner[order], image[order], dim[order], v[order]
    again = np.concatenate([[False], (owner[1:] == owner[:-1]) & (image[1:] == image[:-1]) & (dim[1:] == dim[:-1])])[: len(v)]
    at = np.arange(len(v))
    turn = at - np.maximum.accumulate(np.where(again, 0, at)) if len(v) else at
    keys, column = np.unique(np.stack([image, dim, turn], 1), axis=0, return_inverse=True)
    values, held = np.zeros((part.num_rows, len(keys))), np.zeros((part.num_rows, len(keys)), bool)
    values[owner, column.ravel()], held[owner, column.ravel()] = v, True
    return [(i, d) for i, d, _ in keys.tolist()], values, held


def _rmsds(a: pa.Table, b: pa.Table, periods: Sequence[float] | None) -> np.ndarray:
    """Distances of two blocks of paths over the images both have, NaN where there are none."""
    (keys, x, has_x), (others, y, has_y) = _points_of(a), _points_of(b)
    total, count = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
    at: dict[tuple, list[int]] = {}
    for q, key in enumerate(others):
        at.setdefault(key, []).append(q)
    for p, key in enumerate(keys):
        for q in at.get(key, ()):
            d = x[:, p, None] - y[:, q]
            if periods and key[1] < len(periods) and periods[key[1]] > 0:
                d = (d + periods[key[1]] / 2) % periods[key[1]] - periods[key[1]] / 2
            both = has_x[:, p, None] & has_y[:, q]
            total += np.where(both, d * d, 0.0)
            count += both
    return np.sqrt(np.divide(total, count, out=np.full(total.shape, np.nan), where=count > 0))


def _strips(images: DataFrame, order: list[int], periods: Sequence[float] | None) -> DataFrame:
    """``(k, d)``: of each path its distances to all paths, in order of the ids; blocks of paths meet by twos."""
    n, kind = len(order), "k long, part int, d binary"
    known = images.sparkSession.createDataFrame(list(zip(order, range(n), strict=True)), "path_id long, k long")
    long = images.select("path_id", F.col("image_id").cast("long").alias("image"), F.posexplode("x").alias("dim", "v")).where("v is not null").join(known, "path_id")
    paths = long.groupBy("k").agg(F.collect_list(F.struct("image", "dim", F.col("v").cast("double").alias("v"))).alias("e"))
    paths = materialize(paths.select("k", F.col("e.image").alias("image"), F.col("e.dim").alias("dim"), F.col("e.v").alias("v")))
    own = F.floor(F.col("k") / PATHS).cast("int")
    met = paths.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.lit(max(0, (n - 1) // PATHS))))}).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(block: pa.Table) -> pa.Table:
        i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()
        a, b = (block.filter(pc.equal(block.column("own"), side)) for side in (i, j))
        if not a.num_rows or not b.num_rows:
            return pa.table({"k": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "d": pa.array([], pa.binary())})
        d = _rmsds(a, b, periods)
        if i == j:
            d = np.triu(d, 1) + np.triu(d, 1).T
        rows, parts, found = [], [], []
        for mine, theirs, part, m in ((a, b, j, d), (b, a, i, d.T))[: 1 + (i != j)]:
            wide = np.full((len(m), PATHS), np.nan)
            wide[:, theirs.column("k").to_numpy() - part * PATHS] = m
            rows += mine.column("k").to_pylist()
            parts += [part] * len(m)
            found += [r.tobytes() for r in wide]
        return pa.table({"k": pa.array(rows, pa.int64()), "part": pa.array(parts, pa.int32()), "d": pa.array(found, pa.binary())})

    chunks = met.groupBy("i", "j").applyInArrow(compare, kind).repartition(max(1, -(-n * n * 8 // STRIP)), "k")
    whole = chunks.groupBy("k").agg(F.collect_list(F.struct("part", "d")).alias("parts"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, parts in zip(batch.column("k").to_pylist(), batch.column("parts"), strict=True):
                d = np.full(-(-n // PATHS) * PATHS, np.nan)
                for p in parts.as_py():
                    d[p["part"] * PATHS : (p["part"] + 1) * PATHS] = np.frombuffer(p["d"])
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([d[:n].tobytes()], pa.binary())], ["k", "d"])

    return whole.mapInArrow(assemble, "k long, d binary")


class Merging:
    """Clusters, their weights, and how the distances of two that merge become those of one."""

    def __init__(self, live: np.ndarray, w: np.ndarray, pairs: Sequence[tuple[int, int]] = ()) -> None:
        gone = {b: a for a, b in pairs}
        self.w, self.live, self.old = w, np.array([c for c in live.tolist() if c not in gone], np.int64), live
        self.first, self.second = np.searchsorted(live, self.live), np.full(len(self.live), -1)
        self.second[np.searchsorted(self.live, [a for a, _ in pairs])] = np.searchsorted(live, [b for _, b in pairs])
        self.mass = w[self.first] + np.where(self.second < 0, 0.0, w[self.second])

    def joined(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """``(d, s)`` of one cluster from those of its one or two parts ``(id, d, s)``, the sum of weights behind each distance being s.

        The sums are such that both clusters of a pair find the same number to the last bit.
        """
        second, alone = np.maximum(self.second, 0), self.second < 0
        sums = []
        for _, d, s in rows:
            sd = np.where(s > 0, s * d, 0.0)
            sums.append([(v[self.first], np.where(alone, 0.0, v[second])) for v in (sd, s)])
        if len(rows) == 1:
            num, den = (x + y for x, y in sums[0])
        else:
            num, den = ((x + v) + (y + u) for (x, y), (u, v) in zip(*sums, strict=True))
        out = np.divide(num, den, out=np.full(len(num), np.nan), where=den > 0)
        return (np.where(alone, rows[0][1][self.first], out) if len(rows) == 1 else out), den

    def nearest(self, k: int, d: np.ndarray) -> tuple[int, float]:
        """The nearest other cluster, the lower on ties."""
        d = np.where(np.isnan(d), np.inf, d)
        d[np.searchsorted(self.live, k)] = np.inf
        c = int(d.argmin())
        return int(self.live[c]), float(d[c])


def linkage_rounds(strips: DataFrame, weights: np.ndarray, cutoff: float) -> list[tuple[int, int, float]]:
    """The merges ``(kept, gone, distance)`` of average linkage, weighted, while distances are at most the cutoff.

    ``strips`` are the ``(k, d)`` of :func:`_strips`. Each round merges all
    pairs of clusters that are each other's nearest (lower ids first on
    ties): no later merge can come between them, since an average is never
    below the lesser of what it averages. A cluster is a row with its
    distances to all others; a round shortens every row where it lies and
    shuffles only those that merge. What is left at ``REST`` clusters, a
    number that does not grow with the input, is joined in one task. The
    ids and weights of the clusters travel with the tasks. A cluster is named
    by its smallest path.
    """
    schema = "k long, d binary, s binary, to long, least double"
    now = Merging(np.arange(len(weights)), np.asarray(weights, float))

    def told(m: Merging, k: int, d: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        to, least = m.nearest(k, d)
        return pa.RecordBatch.from_arrays([pa.array([k]), pa.array([d.tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary()), pa.array([to]), pa.array([least])], ["k", "d", "s", "to", "least"])

    def begin(batches: Iterator[pa.RecordBatch], m: Merging = now) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, d in zip(batch.column("k").to_pylist(), batch.column("d"), strict=True):
                d = np.frombuffer(d.as_buffer())
                yield told(m, k, d, np.where(np.isnan(d), 0.0, m.w[k] * m.w))

    def read(part: pa.Table | pa.RecordBatch) -> list[tuple[int, np.ndarray, np.ndarray]]:
        columns = (part.column("k").to_pylist(), *(map(lambda v: np.frombuffer(v.as_buffer()), part.column(c)) for c in ("d", "s")))
        return list(zip(*columns, strict=True))

    def merge(m: Merging) -> Callable[[pa.Table], pa.Table]:
        def run(part: pa.Table) -> pa.Table:
            rows = sorted(read(part), key=lambda r: r[0])
            return pa.Table.from_batches([told(m, rows[0][0], *m.joined(rows))])

        return run

    def rest(part: pa.Table, m: Merging) -> pa.Table:
        rows = {k: (k, d, s) for k, d, s in read(part)}
        out: list[tuple[int, int, float]] = []
        while True:
            near = {k: m.nearest(k, d) for k, d, _ in rows.values()}
            pairs = sorted((d, k, to) for k, (to, d) in near.items() if k < to and d <= cutoff and near.get(to, (-1,))[0] == k)
            if not pairs:
                return pa.table({"n": pa.array(range(len(out)), pa.int64()), "a": pa.array([a for a, _, _ in out], pa.int64()), "b": pa.array([b for _, b, _ in out], pa.int64()), "d": pa.array([d for _, _, d in out], pa.float64())})
            out += [(a, b, d) for d, a, b in pairs]
            m = Merging(m.live, m.mass, [(a, b) for _, a, b in pairs])
            gone = {a: b for _, a, b in pairs}
            rows = {k: (k, *m.joined([rows[k], rows[gone[k]]] if k in gone else [rows[k]])) for k in rows.keys() & set(m.live.tolist())}

    held = materialize(strips.mapInArrow(begin, schema))
    merges: list[tuple[int, int, float]] = []
    while len(now.live) > REST:
        left = held.select("k", "to", "least").where(F.col("least") <= cutoff)
        right = held.select(F.col("k").alias("to"), F.col("to").alias("k"))
        mutual = left.where("k < to").join(right, ["k", "to"]).orderBy("least", "k", "to").collect()
        if not mutual:
            return merges
        merges += [(r["k"], r["to"], r["least"]) for r in mutual]
        now = Merging(now.live, now.mass, [(r["k"], r["to"]) for r in mutual])

        def shorten(batches: Iterator[pa.RecordBatch], m: Merging = now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in read(batch):
                    yield told(m, row[0], *m.joined([row]))

        moved = held.sparkSession.createDataFrame([(c, r["k"]) for r in mutual for c in (r["k"], r["to"])], "k long, kept long")
        alone = held.join(F.broadcast(moved), "k", "left_anti").mapInArrow(shorten, schema)
        both = held.join(F.broadcast(moved), "k").groupBy("kept").applyInArrow(merge(now), schema)
        longer, held = held, materialize(alone.union(both))
        discard(longer)
    last = held.select("k", "d", "s", F.lit(0).alias("one")).groupBy("one").applyInArrow(lambda part: rest(part, now), "n long, a long, b long, d double")
    merges += [(r["a"], r["b"], r["d"]) for r in last.orderBy("n").collect()]
    discard(held)
    return merges


def cluster_paths(images: DataFrame, weights: dict[int, float], cutoff: float = 0.25, periods: Sequence[float] | None = None) -> tuple[list[list[int]], list]:
    """(clusters of path ids by weight, merges) by average linkage of the paths' distances; the driver holds the ids and the merges alone."""
    order = sorted(weights)
    found = linkage_rounds(_strips(images, order, periods), np.array([weights[p] for p in order], float), cutoff) if order else []
    merges = [(order[a], order[b], d) for a, b, d in found]
    clusters = {p: [p] for p in order}
    for a, b, _ in merges:
        clusters[a] += clusters.pop(b)
    return sorted(map(sorted, clusters.values()), key=lambda c: (-sum(weights[p] for p in c), c[0])), merges


def channel_points(df: DataFrame, i: int, j: int, threshold: float = 0.1, most: int | None = None, power: float = 1.0, seed: int = 0) -> DataFrame:
    """Frames with q_i q_j >= threshold and positive weight; at most ``most`` by a draw with odds w (q_i q_j)^power."""
    score = F.get("q", F.lit(i)) * F.get("q", F.lit(j))
    out = df.withColumn("channel", score).where((F.col("channel") >= threshold) & (F.col("weight") > 0))
    if most is None:
        return out
    u = (F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return out.withColumn("_key", F.ln(u) / (F.col("weight") * F.col("channel") ** power)).orderBy(F.desc("_key"), "row_id").limit(most).drop("_key")


def ranked_transitions(p_jump: DataFrame, threshold: float, most: int | None = None) -> DataFrame:
    """Unordered pairs with the larger direction's probability above the threshold, descending."""
    both = p_jump.where("i != j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "i", "j", "value")
    best = both.groupBy("a", "b").agg(F.min(F.struct((-F.col("value")).alias("v"), "i", "j")).alias("m")).select(F.col("m.i").alias("i"), F.col("m.j").alias("j"), (-F.col("m.v")).alias("value")).where(F.col("value") > threshold)
    return best.orderBy(F.desc("value"), "i", "j").limit(most) if most else best


def _resample(x: np.ndarray, n: int) -> np.ndarray:
    step = np.linalg.norm(np.diff(x, axis=0), axis=1)
    keep = np.concatenate([[True], step > 1e-14])
    x, arc = x[keep], np.concatenate([[0.0], np.cumsum(step[step > 1e-14])])
    at = np.linspace(0, arc[-1], n)
    return np.stack([np.interp(at, arc, x[:, k]) for k in range(x.shape[1])], 1)


def aligned(point: np.ndarray, near: np.ndarray, periods: Sequence[float] | None) -> np.ndarray:
    """The copy of a point that is nearest to another in each periodic direction."""
    p = np.zeros(len(point)) if periods is None else np.asarray(periods, float)
    turns = np.round(np.divide(near - point, p, out=np.zeros(len(point)), where=p > 0))
    return point + turns * p


def stitch(legs: DataFrame, n_images: int, window: int = 3, iterations: int = 1, *, ends: tuple[Sequence[float] | None, Sequence[float] | None] = (None, None), periods: Sequence[float] | None = None) -> DataFrame:
    """One path from two legs that left the same start: the first reversed, then the second without its start; resampled and smoothed.

    ``legs`` holds ``(path_id, leg, image_id, x)`` with leg 0 or 1; each path
    is a group of a few hundred images. ``ends`` are points at which the path
    begins and ends in any case, as their copies nearest to it where
    ``periods`` are positive.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.array(g.sort_values("image_id").x.tolist(), float) for _, g in sorted(group.groupby("leg"), key=lambda t: t[0])]
        path = np.concatenate([parts[0][::-1], parts[1][1:]]) if len(parts) > 1 else parts[0][::-1]
        first, last = (None if e is None else aligned(np.asarray(e, float), near, periods)[None] for e, near in zip(ends, (path[0], path[-1]), strict=True))
        path = np.concatenate([p for p in (first, path, last) if p is not None])
        path = _resample(path, n_images)
        h = window // 2
        for _ in range(iterations):
            padded = np.pad(path, ((h, h), (0, 0)), mode="edge")
            inner = np.stack([np.convolve(padded[:, k], np.ones(window) / window, "valid") for k in range(path.shape[1])], 1)
            path = np.concatenate([path[:1], inner[1:-1], path[-1:]])
        return pd.DataFrame({"path_id": group.path_id.iloc[0], "image_id": np.arange(len(path)), "x": list(path)})

    return legs.groupBy("path_id").applyInPandas(run, "path_id long, image_id int, x array<double>")


def _scrambled(v: np.ndarray) -> np.ndarray:
    """Bits of a counter spread over 64 bits (the finaliser of splitmix64)."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def counter_normals(ids: np.ndarray, step: int, d: int, seed: int) -> np.ndarray:
    """[id, dimension] standard normal numbers that depend on id, step, dimension and seed alone, whatever else is drawn where."""
    key = _scrambled(ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64)))
    at = (np.arange(2 * d, dtype=np.uint64) + np.uint64(2 * d * step)) * np.uint64(0xD1342543DE82EF95)
    u = ((_scrambled(key[:, None] + at) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
    return np.sqrt(-2 * np.log(u[:, :d])) * np.cos(2 * np.pi * u[:, d:])


@dataclass(frozen=True)
class Shooting:
    """How a path moves and where it ends.

    Steps of length ``step`` go along the gradient, scaled to length one where
    ``normalize`` is set, plus ``noise`` times a normal vector drawn by path,
    step and ``seed``. A path ends where q of the target reaches ``target_q``,
    the gradient vanishes, or after ``max_steps``. With ``expansion`` it
    climbs the logit of q instead, which does not flatten near 0 and 1, and
    ends within ``radius`` of ``basin`` rather than by q. Directions that are
    ``periodic`` wrap into ``[low, high)``.
    """

    step: float = 0.05
    max_steps: int = 300
    target_q: float = 0.98
    min_grad: float = 1e-10
    normalize: bool = True
    expansion: bool = False
    expansion_eps: float = 1e-6
    basin: tuple[float, ...] | None = None
    radius: float | None = None
    noise: float = 0.0
    seed: int = 0
    periodic: tuple[bool, ...] | None = None
    low: float = -180.0
    high: float = 180.0

    def __post_init__(self) -> None:
        if self.step <= 0 or self.max_steps < 1:
            raise ValueError("the step is positive and there is one at least")
        if self.expansion and self.basin is not None and self.radius is None:
            raise ValueError("a basin to stop in needs a radius")

    def arrived(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        if not self.expansion:
            return q >= self.target_q
        return np.zeros(len(x), bool) if self.basin is None else np.linalg.norm(x - np.asarray(self.basin), axis=1) <= self.radius

    def climb(self, q: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        """The gradient that is followed: of q, or of its logit, which is flat beyond ``expansion_eps`` of 0 and 1."""
        if not self.expansion:
            return gradient
        inside = (q > self.expansion_eps) & (q < 1 - self.expansion_eps)
        return gradient * np.divide(1.0, q * (1 - q), out=np.zeros_like(q), where=inside)[:, None]

    def moved(self, x: np.ndarray, direction: np.ndarray) -> np.ndarray:
        at = x + self.step * direction
        if self.periodic is None:
            return at
        return np.where(np.asarray(self.periodic), self.low + np.mod(at - self.low, self.high - self.low), at)


def shoot(starts: DataFrame, net, target: int, how: Shooting | None = None, **changed) -> DataFrame:  # noqa: ANN001, ANN003
    """Gradient ascent towards state ``target`` from each start ``(path_id, x)``, all starts of a batch at once; every image with its q.

    ``how``, or single fields of it by name, tells how: see :class:`Shooting`.
    A path depends on its start and id alone, in any partitioning.
    """
    s = replace(how or Shooting(), **changed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, ids = np.array(batch.x.tolist(), float), batch.path_id.to_numpy()
            live, rows = np.arange(len(x)), []
            for n in range(s.max_steps + 1):
                q, gradient = net.value_and_input_gradient(x[live], target)
                rows += [(ids[k], n, x[k].copy(), q[i]) for i, k in enumerate(live)]
                gradient = s.climb(q[:, target], gradient)
                norm = np.linalg.norm(gradient, axis=1)
                going = ~s.arrived(x[live], q[:, target]) & np.isfinite(norm) & (norm >= s.min_grad)
                live, gradient, norm = live[going], gradient[going], norm[going]
                if not len(live):
                    break
                direction = gradient / norm[:, None] if s.normalize else gradient
                if s.noise > 0:
                    direction = direction + s.noise * counter_normals(ids[live], n, x.shape[1], s.seed)
                x[live] = s.moved(x[live], direction)
            yield pd.DataFrame({"path_id": [r[0] for r in rows], "image_id": [r[1] for r in rows], "x": [r[2] for r in rows], "q": [r[3] for r in rows]})

    return starts.select("path_id", "x").mapInPandas(run, "path_id long, image_id int, x array<double>, q array<double>")
