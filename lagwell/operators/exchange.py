"""Voronoi cells of path images, exchange between paths, shared segments, relaxation, routes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwell.functions.kinetics import UnionFind, simple_routes
from lagwell.operators.cluster import distances, nearest_centers
from lagwell.operators.lag import positional_pairs


def path_cells(samples: DataFrame, paths: dict[int, np.ndarray], periods: Sequence[float] | None = None) -> DataFrame:
    """``(row_id, traj_id, weight, path_id, image)``: the nearest image of every path to every sample."""
    out = None
    for p, images in sorted(paths.items()):
        cell = nearest_centers(samples.select("row_id", "traj_id", "weight", "x"), images.tolist(), periods=periods).select("row_id", "traj_id", "weight", F.lit(p).alias("path_id"), F.col("cell").alias("image"))
        out = cell if out is None else out.unionByName(cell)
    return out


def exchange_counts(cells: DataFrame, sizes: dict[int, int], lag: int = 1, margin: int = 1) -> DataFrame:
    """Symmetric counts ``(path_a, image_a, path_b, image_b, count)`` between interior images of different paths.

    A sample in image s of path a at t and image u of path b at t + lag counts
    for the pair in both directions.
    """
    wide = cells.groupBy("row_id", "traj_id").agg(F.max("weight").alias("weight"), F.collect_list(F.struct("path_id", "image")).alias("at"))
    pairs = positional_pairs(wide, lag, ["at"])
    size = F.create_map(*(F.lit(v) for kv in sizes.items() for v in kv))
    long = pairs.select("weight", F.explode("at").alias("a"), "at_tau").select("weight", "a", F.explode("at_tau").alias("b")).where("a.path_id != b.path_id")
    inner = lambda c: (F.col(f"{c}.image") >= margin) & (F.col(f"{c}.image") < size[F.col(f"{c}.path_id")] - margin)
    one = long.where(inner("a") & inner("b")).groupBy(F.col("a.path_id").alias("path_a"), F.col("a.image").alias("image_a"), F.col("b.path_id").alias("path_b"), F.col("b.image").alias("image_b")).agg(F.sum("weight").alias("count"))
    back = one.select(F.col("path_b").alias("path_a"), F.col("image_b").alias("image_a"), F.col("path_a").alias("path_b"), F.col("image_a").alias("image_b"), "count")
    return one.union(back).groupBy("path_a", "image_a", "path_b", "image_b").agg(F.sum("count").alias("count"))


def edge_table(counts: DataFrame, nodes: DataFrame, *, min_count: float = 0.0, min_probability: float = 0.0, max_distance: float | None = None) -> DataFrame:
    """One row per unordered edge: count, share of the smaller node's exchange, distance, accepted; accepted first, then by count and distance."""
    total = counts.groupBy("path_a", "image_a").agg(F.sum("count").alias("out"))
    n = F.broadcast(nodes)
    a = n.select(F.col("path_id").alias("path_a"), F.col("image_id").alias("image_a"), F.col("x").alias("xa"))
    b = n.select(F.col("path_id").alias("path_b"), F.col("image_id").alias("image_b"), F.col("x").alias("xb"))
    upper = counts.where("path_a < path_b or (path_a = path_b and image_a < image_b)")
    both = upper.join(total, ["path_a", "image_a"]).join(total.select(F.col("path_a").alias("path_b"), F.col("image_a").alias("image_b"), F.col("out").alias("out_b")), ["path_b", "image_b"]).join(a, ["path_a", "image_a"]).join(b, ["path_b", "image_b"])
    dist = F.sqrt(F.aggregate(F.zip_with("xa", "xb", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    ok = (F.col("count") > 0) & (F.col("count") >= min_count) & (F.col("probability") >= min_probability)
    if max_distance is not None:
        ok &= F.col("distance") <= max_distance
    out = both.select("path_a", "image_a", "path_b", "image_b", "count", (F.col("count") / F.least("out", "out_b")).alias("probability"), dist.alias("distance")).withColumn("accepted", ok)
    return out.orderBy(F.desc("accepted"), F.desc("count"), "distance", "path_a", "image_a", "path_b", "image_b")


def shared_nodes(edges: Sequence[tuple[tuple[int, int], tuple[int, int]]], nodes: Sequence[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Label per node, by first appearance; nodes joined by accepted edges share one."""
    at = {n: k for k, n in enumerate(nodes)}
    sets = UnionFind(len(nodes))
    for a, b in edges:
        sets.union(at[a], at[b])
    code: dict[int, int] = {}
    return {n: code.setdefault(sets.find(k), len(code)) for n, k in at.items()}


def shared_segments(labels: dict[tuple[int, int], int]) -> dict[int, list[tuple[int, int]]]:
    """Labels whose nodes lie on two paths or more."""
    groups: dict[int, list[tuple[int, int]]] = {}
    for node, label in labels.items():
        groups.setdefault(label, []).append(node)
    return {k: v for k, v in groups.items() if len({p for p, _ in v}) >= 2}


def decompose(images: DataFrame) -> DataFrame:
    """Runs of equal ``shared`` id (NULL where unshared) along each path: first and last image, length."""
    along = W.partitionBy("path_id").orderBy("image_id")
    changed = F.when(F.lag("shared").over(along).eqNullSafe(F.col("shared")) & (F.row_number().over(along) > 1), 0).otherwise(1)
    runs = images.withColumn("_c", changed).withColumn("segment", (F.sum("_c").over(along.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int"))
    return runs.groupBy("path_id", "segment").agg(F.first("shared").alias("shared"), F.min("image_id").alias("first_image"), F.max("image_id").alias("last_image"), F.count("*").alias("n_images"))


def relax(nodes: DataFrame, counts: DataFrame, relaxation: float = 0.5, periods: Sequence[float] | None = None) -> DataFrame:
    """Each node moves towards the mean of itself (weight: all its exchange) and its exchange neighbours; path ends stay."""
    other = nodes.select(F.col("path_id").alias("path_b"), F.col("image_id").alias("image_b"), F.posexplode("x").alias("dim", "u"))
    mine = nodes.select(F.col("path_id").alias("path_a"), F.col("image_id").alias("image_a"), F.posexplode("x").alias("dim", "v"))
    d = F.col("u") - F.col("v")
    if periods:
        per = F.get(F.array(*map(F.lit, map(float, periods))), F.col("dim"))
        d = F.when(per > 0, F.pmod(d + per / 2, F.when(per > 0, per).otherwise(1.0)) - per / 2).otherwise(d)
    pull = counts.join(other, ["path_b", "image_b"]).join(mine, ["path_a", "image_a", "dim"]).groupBy("path_a", "image_a", "dim").agg((F.sum(d * F.col("count")) / (2 * F.sum("count"))).alias("move"))
    ends = W.partitionBy("path_id")
    inner = nodes.withColumn("_end", (F.col("image_id") == F.min("image_id").over(ends)) | (F.col("image_id") == F.max("image_id").over(ends))).select("path_id", "image_id", "_end", F.posexplode("x").alias("dim", "v"))
    moved = inner.join(pull.withColumnsRenamed({"path_a": "path_id", "image_a": "image_id"}), ["path_id", "image_id", "dim"], "left").withColumn("v", F.when(F.col("_end") | F.col("move").isNull(), F.col("v")).otherwise(F.col("v") + relaxation * F.col("move")))
    return moved.groupBy("path_id", "image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s.v).alias("x"))


def network(sizes: dict[int, int], edges: Sequence[tuple[tuple[int, int], tuple[int, int]]]) -> tuple[dict[int, set[int]], list[tuple[int, int]], list[int]]:
    """(adjacency, nodes, branch points): neighbours along paths and accepted exchange; a branch point has more than two."""
    nodes = [(p, k) for p in sorted(sizes) for k in range(sizes[p])]
    at = {n: i for i, n in enumerate(nodes)}
    adjacency: dict[int, set[int]] = {i: set() for i in range(len(nodes))}
    for p, n in sizes.items():
        for k in range(n - 1):
            adjacency[at[p, k]].add(at[p, k + 1])
            adjacency[at[p, k + 1]].add(at[p, k])
    for a, b in edges:
        adjacency[at[a]].add(at[b])
        adjacency[at[b]].add(at[a])
    return adjacency, nodes, [i for i, v in adjacency.items() if len(v) > 2]


def reactive_routes(sizes: dict[int, int], edges: Sequence[tuple[tuple[int, int], tuple[int, int]]], most: int = 10_000) -> list[list[tuple[int, int]]]:
    adjacency, nodes, _ = network(sizes, edges)
    at = {n: i for i, n in enumerate(nodes)}
    return [[nodes[i] for i in route] for route in simple_routes(adjacency, [at[p, 0] for p in sizes], [at[p, n - 1] for p, n in sizes.items()], most)]


def cell_distance(points: np.ndarray, images: np.ndarray) -> np.ndarray:
    return np.sqrt(distances(points, images))
