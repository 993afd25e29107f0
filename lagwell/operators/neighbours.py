"""Exact nearest neighbours among all rows (of a group), with most pairs never compared.

Equal points are one, with the lowest ids they can contribute. Points drawn as
pivots cut the space into cells. Each point's own block gives a distance that
its k-th neighbour cannot exceed; by the triangle inequality most cells cannot
hold anything closer, and only the others are visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwell.plans.lineage import materialize

#: Points of a cell, about, and of a block of a cell or of its visitors at most, about; numbers in the pivots that travel with a task at most.
CELL, BLOCK, MOST_SHIPPED = 512, 4096, 4_000_000
#: What rounding may add to a squared distance; cells within it are visited.
SLACK = 1e-9


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, dimension by dimension, so that the same two points give the same number in any batch."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[:, k]
        out += d * d
    return out


def _points(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


class Cells:
    """The pivots of all groups, and what is known of the cells around them."""

    def __init__(self, group: np.ndarray, pivots: np.ndarray) -> None:
        self.pivots, self.of = pivots, {g: np.flatnonzero(group == g) for g in np.unique(group).tolist()}
        self.radius, self.count = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)

    def assign(self, group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(cell, squared distance to its pivot)`` of each point, the first pivot on ties."""
        cell, d2 = np.zeros(len(x), np.int64), np.zeros(len(x))
        for g in np.unique(group).tolist():
            mine = np.flatnonzero(group == g)
            d = square_distances(x[mine], self.pivots[self.of[g]])
            cell[mine], d2[mine] = self.of[g][d.argmin(1)], d.min(1)
        return cell, d2

    def visits(self, group: np.ndarray, x: np.ndarray, bound2: np.ndarray, k: int) -> list[np.ndarray]:
        """Of each point the cells that may hold a point within the squared bound, or within what the cells' sizes imply for its k-th neighbour."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(x)
        for g in np.unique(group).tolist():
            mine, cells = np.flatnonzero(group == g), self.of[g]
            used = cells[self.count[cells] > 0]
            d = np.sqrt(square_distances(x[mine], self.pivots[used]))
            # every point of a cell lies within d + radius: the first cells that hold k points bound the k-th distance
            reach = d + self.radius[used]
            order = np.argsort(reach, axis=1, kind="stable")
            enough = np.cumsum(self.count[used][order], axis=1) >= k
            least = np.where(enough.any(1), np.take_along_axis(reach, np.take_along_axis(order, enough.argmax(1)[:, None], 1), 1)[:, 0], np.inf)
            bound = np.minimum(np.sqrt(bound2[mine]), least)[:, None]
            own = d.min(1, keepdims=True)
            between = np.sqrt(square_distances(self.pivots[used][d.argmin(1)], self.pivots[used]))
            # a point of another cell is no nearer than the ball around the cell, nor than the plane between the two pivots
            plane = np.divide((d - own) * (d + own), 2 * between, out=np.zeros_like(d), where=between > 0)
            far = np.maximum(np.maximum(d - self.radius[used], plane), 0.0)
            open_ = far <= bound * (1 + SLACK) + SLACK * (1 + own + d)
            for i, row in zip(mine, open_, strict=True):
                out[i] = used[row]
        return out


def _distinct_points(df: DataFrame, x: str, keep: int) -> DataFrame:
    """``(g, point, x, ids)`` of each different point: the lowest ids of its rows, ``keep`` at most, of which ``point`` is the lowest."""
    first = W.partitionBy("g", x).orderBy("row_id")
    lowest = df.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= keep)  # cut before the shuffle, too
    return lowest.groupBy("g", x).agg(F.array_sort(F.collect_list("row_id")).alias("ids")).select("g", F.col("ids")[0].alias("point"), x, "ids")


def _draw_pivots(points: DataFrame, x: str, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """``(group, pivots)``: of each group a share of its points by the hash of their ids, one at least."""
    hashed = F.xxhash64("point", F.lit(17))
    sizes = {r["g"]: (r["n"], r["first"]) for r in points.groupBy("g").agg(F.count("*").alias("n"), F.min_by("point", hashed).alias("first")).collect()}
    if not sizes:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    dims = points.select(F.size(x).alias("d")).first()["d"]
    total = sum(n for n, _ in sizes.values())
    cell = max(cell, -(-total * dims // (MOST_SHIPPED // 2)))
    if len(sizes) * dims > MOST_SHIPPED // 2:
        raise ValueError(f"{len(sizes)} groups have more pivots than are sent to every task")
    share = F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53)) < F.lit(1.0 / cell)
    drawn = points.where(share | F.col("point").isin([p for _, p in sizes.values()])).select("g", "point", x).collect()
    drawn.sort(key=lambda r: (r["g"], r["point"]))
    return np.array([r["g"] for r in drawn], np.int64), np.array([r[x] for r in drawn], float)


def _kth(part: pa.Table, x: str, k: int) -> np.ndarray:
    """The squared distance of each point's k-th nearest in the block, itself included; infinite where the block has fewer."""
    p = _points(part.column(x))
    out = np.full(len(p), np.inf)
    if len(p) >= k:
        for a in range(0, len(p), 512):
            out[a : a + 512] = np.partition(square_distances(p[a : a + 512], p), k - 1, axis=1)[:, k - 1]
    return out


def visiting(df: DataFrame, k: int, x: str = "x", by: str | None = None, *, cell: int = CELL, block: int = BLOCK) -> tuple[DataFrame, DataFrame, Cells]:
    """``(points, visitors, cells)``: the points by cell and block, and which cells each must visit for its ``k`` nearest, itself included.

    Points are ``(g, point, x, ids, cell, sub)``, visitors ``(point, x, cells)``.
    """
    group = F.lit(0).cast("long") if by is None else F.coalesce(F.col(by).cast("long"), F.lit(-(1 << 62)))
    points = materialize(_distinct_points(df.select(group.alias("g"), "row_id", x), x, k))
    cells = Cells(*_draw_pivots(points, x, cell))
    if not len(cells.pivots):
        return points.withColumns({"cell": F.lit(0).cast("long"), "sub": F.lit(0).cast("long")}), points.select("point", x, F.array().cast("array<long>").alias("cells")), cells

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                c, d2 = cells.assign(part.column("g").to_numpy(), _points(part.column(x)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c), pa.array(d2)], [*part.schema.names, "cell", "d2"])

    schema = points.withColumns({"cell": F.lit(0).cast("long"), "d2": F.lit(0.0)}).schema
    assigned = materialize(points.mapInArrow(assign, schema))
    known = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("d2").alias("d2")).collect()
    for r in known:
        cells.radius[r["cell"]], cells.count[r["cell"]] = np.sqrt(r["d2"]), r["n"]
    subs = F.element_at(F.create_map(*(F.lit(v) for r in known for v in (r["cell"], -(-r["n"] // block)))), F.col("cell")) if any(r["n"] > block for r in known) else F.lit(1)
    placed = assigned.drop("d2").withColumn("sub", F.pmod(F.xxhash64("point", F.lit(5)), subs.cast("long")))

    def bounded(part: pa.Table) -> pa.Table:
        return part.select(["g", "point", x]).append_column("bound2", pa.array(_kth(part, x, k)))

    bounds = placed.select("g", "point", x, "cell", "sub").groupBy("cell", "sub").applyInArrow(bounded, f"g long, point long, {x} array<double>, bound2 double")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                open_ = cells.visits(part.column("g").to_numpy(), _points(part.column(x)), part.column("bound2").to_numpy(), k)
                yield pa.RecordBatch.from_arrays([part.column("point"), part.column(x), pa.array(open_, pa.list_(pa.int64()))], ["point", x, "cells"])

    return placed, materialize(bounds.mapInArrow(visits, f"point long, {x} array<double>, cells array<long>")), cells


def nearest(df: DataFrame, k: int, x: str = "x", by: str | None = None, *, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """``(row_id, ids, dists)``: of each row the k nearest others (of its group), nearest first, lower id on ties; all others where they are fewer.

    Exact. Pairs are compared in groups of at most about ``block`` points and
    ``block`` visitors, however large a cell is or however many visit it.
    Where distances say little, as between random points of many dimensions,
    all cells are visited and the work is that of all pairs. ``row_id`` must
    be unique, points without NULLs and of one length.
    """
    asked = k + 1  # a row is its own nearest
    wide = df.withColumn(x, F.col(x).cast("array<double>"))
    points, visitors, cells = visiting(wide, asked, x, by, cell=cell, block=block)
    if not len(cells.pivots):
        return df.sparkSession.createDataFrame([], "row_id long, ids array<long>, dists array<double>")
    per_cell = visitors.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    parts = materialize(per_cell.select("cell", F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("long").alias("parts")))
    size = points.groupBy("cell").agg((F.max("sub") + 1).alias("subs"))
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(name)
    queries = visitors.select("point", x, F.explode("cells").alias("cell")).join(parts, "cell").join(size, "cell").withColumn("part", F.pmod(F.xxhash64("point", F.lit(9)), F.col("parts"))).select("cell", "part", "point", x, each("subs", "sub"))
    given = points.select("cell", "sub", x, "ids").join(parts, "cell").select("cell", "sub", x, "ids", each("parts", "part"))

    def compare(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        point, near, ids = [], [], []
        if mine.num_rows and theirs.num_rows:
            asker, p = mine.column("point").to_numpy(), _points(mine.column(x))
            held = theirs.column("ids").combine_chunks()
            owner = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy())
            given_ids, q = held.flatten().to_numpy(), _points(theirs.column(x))
            for a in range(0, len(p), 256):
                d2 = square_distances(p[a : a + 256], q)[:, owner]
                if d2.shape[1] > 4 * asked:  # those beyond the k-th distance go before the sort
                    limit = np.partition(d2, asked - 1, axis=1)[:, asked - 1]
                    row, col = np.nonzero(d2 <= limit[:, None])
                else:
                    row, col = (v.ravel() for v in np.indices(d2.shape))
                order = np.lexsort((given_ids[col], d2[row, col], row))
                row, col = row[order], col[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[rank < asked], col[rank < asked]
                point.append(asker[a : a + 256][row])
                near.append(d2[row, col])
                ids.append(given_ids[col])
        join = lambda v, t: pa.array(np.concatenate([np.zeros(0, t), *v]))
        return pa.table({"point": join(point, np.int64), "d2": join(near, float), "id": join(ids, np.int64)})

    found = queries.groupBy("cell", "part", "sub").cogroup(given.groupBy("cell", "part", "sub")).applyInArrow(compare, "point long, d2 double, id long")
    best = found.withColumn("_r", F.row_number().over(W.partitionBy("point").orderBy("d2", "id"))).where(F.col("_r") <= asked)
    lists = best.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("d2", "id"))).alias("best"))
    group = F.lit(0).cast("long") if by is None else F.coalesce(F.col(by).cast("long"), F.lit(-(1 << 62)))
    owners = wide.select(group.alias("g"), "row_id", x).join(points.select("g", x, "point"), ["g", x])
    others = F.slice(F.filter("best", lambda b: b.id != F.col("row_id")), 1, k)
    return owners.join(lists, "point").select("row_id", others.alias("best")).select("row_id", F.col("best.id").alias("ids"), F.transform("best.d2", F.sqrt).alias("dists"))
