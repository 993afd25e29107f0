"""Frame tables: identity, blocks, weights, featurisation, labels.

A frame is a row ``(row_id, traj_id, frame, weight, state, ...)``. ``state``
is -1 where unlabelled. Weights are non-negative doubles. NaN stands for
missing in inputs and is turned into NULL or a default on entry.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwell.functions.arrays import total
from lagwell.operators.quantiles import exact_quantiles
from lagwell.plans.lineage import materialize


def by_trajectory() -> W:
    return W.partitionBy("traj_id").orderBy("frame", "row_id")


def trajectory_metadata(df: DataFrame, traj: str, order: Sequence[str], source: str) -> DataFrame:
    """Add ``traj_id``, ``frame_in_traj`` (from 0) and ``source_file`` where the table lacks them."""
    out = df if "traj_id" in df.columns else df.withColumn("traj_id", F.col(traj))
    if "frame_in_traj" not in df.columns:
        out = out.withColumn("frame_in_traj", (F.row_number().over(W.partitionBy("traj_id").orderBy(*order)) - 1).cast("int"))
    return out if "source_file" in df.columns else out.withColumn("source_file", F.lit(source))


def clean_weight(weight: Column | str) -> Column:
    """Numeric, missing or NaN to 0, negative to 0."""
    w = F.expr(f"try_cast({weight} as double)") if isinstance(weight, str) else weight.cast("double")
    return F.greatest(F.coalesce(F.when(F.isnan(w), None).otherwise(w), F.lit(0.0)), F.lit(0.0))


def frame_table(df: DataFrame, *, step: str = "frame", discard_before: int = 0, stride: int = 1, weight: str = "weight") -> DataFrame:
    """Rows from ``discard_before`` on, every ``stride``-th of each trajectory, weights cleaned; an all-zero table weighs 1 each."""
    kept = df.where(F.col(step) >= discard_before)
    if stride > 1:
        rank = F.row_number().over(W.partitionBy("traj_id").orderBy(step)) - 1
        kept = kept.withColumn("_r", rank).where(F.pmod("_r", F.lit(stride)) == 0).drop("_r")
    cleaned = kept.withColumn(weight, clean_weight(weight))
    mass = cleaned.agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("_mass"))
    return cleaned.crossJoin(F.broadcast(mass)).withColumn(weight, F.when(F.col("_mass") > 0, F.col(weight)).otherwise(1.0)).drop("_mass")


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Add a dense ``row_id`` from 0 in the given order, NULLs first; ties in it are numbered in any order.

    A range partitioning sorts the table once. What meets on the driver is one
    count a partition, so no window and no task sees the whole table or a
    whole trajectory.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = materialize(dealt.withColumns({"_part": F.spark_partition_id(), "_at": local}))
    sizes = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts = list(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return held.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def global_stride(df: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th row of a table with a dense ``row_id``, across trajectories."""
    if stride < 1:
        raise ValueError("stride must be positive")
    return df.where(F.pmod("row_id", F.lit(stride)) == 0)


def consecutive_runs(df: DataFrame, value: str, over: W, name: str = "run") -> DataFrame:
    """Number the maximal runs of equal ``value`` in the window's order, from 0."""
    changed = F.when(F.lag(value).over(over).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("_changed", changed).withColumn(name, (F.sum("_changed").over(over.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int")).drop("_changed")


def burn_in(df: DataFrame, discard: int, within: Sequence[str], order: str = "row_id") -> DataFrame:
    """``keep``: false for the first ``discard`` rows of each consecutive run of one trajectory.

    Runs follow ``order``; a trajectory that comes back later starts a new
    run. ``within`` names columns that bound the runs already (a file or
    chunk), so that no single partition holds the table; without any all rows
    are sorted by one task.
    """
    if discard < 0:
        raise ValueError("discard_first_n_frames must be nonnegative")
    over = W.partitionBy(*within).orderBy(order)
    runs = consecutive_runs(df, "traj_id", over, "_run")
    rank = F.row_number().over(W.partitionBy(*within, "_run").orderBy(order))
    return runs.withColumn("keep", rank > discard).drop("_run")


def periodic_features(columns: Sequence[str], periodic: Sequence[str], degrees: bool = True) -> list[Column]:
    """Chosen columns; a periodic one becomes ``sin<name>`` and ``cos<name>``."""
    out = []
    for c in columns:
        if c in periodic:
            angle = F.radians(c) if degrees else F.col(c)
            out += [F.sin(angle).alias(f"sin{c}"), F.cos(angle).alias(f"cos{c}")]
        else:
            out.append(F.col(c))
    return out


def _at_cut(angle: Column, half: float) -> Column:
    """Half a turn backwards, to a billionth, is taken as half a turn forwards: which one rounding gives says nothing."""
    return F.when(angle <= -half * (1 - 1e-9), angle + 2 * half).otherwise(angle)


def angle_of(sine: Column, cosine: Column, degrees: bool = True) -> Column:
    """The angle, above minus half a turn and up to half a turn."""
    a = F.atan2(sine, cosine)
    return _at_cut(F.degrees(a), 180.0) if degrees else _at_cut(a, math.pi)


def minimum_image(delta: Column, period: float) -> Column:
    """The shortest of the periodic copies of a difference, in [-period/2, period/2)."""
    return F.pmod(delta + period / 2, F.lit(float(period))) - period / 2


def wrap(x: Column, low: float, high: float) -> Column:
    return F.pmod(x - low, F.lit(float(high - low))) + low


def scaled_circle(x: Column, period: float) -> tuple[Column, Column]:
    """A point on a circle of circumference ``period``, so that short distances keep their length."""
    scale = period / (2 * math.pi)
    return F.sin(x / scale) * scale, F.cos(x / scale) * scale


def from_circle(s: Column, c: Column, period: float) -> Column:
    """Back on the line, above -period/2 and up to period/2."""
    return _at_cut(F.atan2(s, c) * (period / (2 * math.pi)), period / 2)


def standardised(df: DataFrame, columns: Sequence[str], method: str = "standard", eps: float = 1e-12, fit: Column | None = None) -> DataFrame:
    """(x - center) / scale with parameters from the rows where ``fit`` holds (all by default).

    ``standard``: mean and population deviation; ``robust``: median and
    interquartile range; ``range``: minimum and extent; ``none``. A scale
    below ``eps`` counts as 1. The parameters are one row, broadcast.
    """
    chosen = df if fit is None else df.where(fit)
    if method == "robust":
        long = chosen.select(F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)))).alias("s")).select("s.*")
        found = {r["c"]: r["quantiles"] for r in exact_quantiles(long, "v", [0.25, 0.5, 0.75], ["c"]).collect()}
        low, center, high = ([found.get(k, [None] * 3)[i] for k in range(len(columns))] for i in range(3))
        parts = [p for c, a, m, b in zip(columns, low, center, high, strict=True) for p in (F.lit(m).cast("double").alias(f"_c_{c}"), (F.lit(b) - F.lit(a)).cast("double").alias(f"_s_{c}"))]
        out = df.select("*", *parts)
    else:
        center, scale = {"standard": (F.avg, F.stddev_pop), "range": (F.min, lambda x: F.max(x) - F.min(x)), "none": (lambda _: F.lit(0.0), lambda _: F.lit(1.0))}[method]
        out = df.crossJoin(F.broadcast(chosen.agg(*(p for c in columns for p in (center(c).alias(f"_c_{c}"), scale(c).alias(f"_s_{c}"))))))
    for c in columns:
        scale = F.when(F.abs(f"_s_{c}") < eps, 1.0).otherwise(F.col(f"_s_{c}"))
        out = out.withColumn(c, (F.col(c) - F.col(f"_c_{c}")) / scale)
    return out.drop(*(f"_{k}_{c}" for c in columns for k in "cs"))


def basin_labels(df: DataFrame, columns: Sequence[str], basins: Sequence[tuple[int, Sequence[float], Sequence[float] | float]], shape: str = "box") -> DataFrame:
    """Add ``state`` and ``dist`` from user-given basins ``(state, center, size or cutoff)``.

    Box: the largest of |x - c| / size, inside if at most 1. Distance:
    Euclidean, inside if at most the cutoff. The nearest basin that holds the
    frame wins, the first on ties; a frame in none is -1. ``dist`` is the
    smallest distance to any basin.
    """
    options = []
    for rank, (state, center, size) in enumerate(basins):
        deltas = [F.col(c) - float(m) for c, m in zip(columns, center, strict=True)]
        if shape == "box":
            scaled = [F.abs(d) / float(s) for d, s in zip(deltas, size, strict=True)]
            d = F.greatest(*scaled) if len(scaled) > 1 else scaled[0]
            inside = d <= 1
        else:
            d = F.sqrt(sum((x * x for x in deltas[1:]), deltas[0] * deltas[0]))
            inside = d <= float(size)
        options.append(F.struct(d.alias("d"), F.lit(rank).alias("rank"), F.lit(state).alias("state"), inside.alias("inside")))
    every = F.array(*options)
    best = F.array_min(F.filter(every, lambda o: o.inside))
    return df.withColumn("state", F.coalesce(best.state, F.lit(-1))).withColumn("dist", F.array_min(F.transform(every, lambda o: o.d)))


def normalised_weights(df: DataFrame, weight: str = "weight", within: Sequence[str] = ()) -> DataFrame:
    """Weights over their sum; missing and negative count as 0; an all-zero group is uniform."""
    w = clean_weight(F.col(weight))
    parts = df.withColumn("_w", w)
    sums = parts.groupBy(*within).agg(F.sum("_w").alias("_sum"), F.count("*").alias("_n"))
    joined = parts.join(F.broadcast(sums), list(within)) if within else parts.crossJoin(F.broadcast(sums))
    return joined.withColumn(weight, F.when(F.col("_sum") > 0, F.col("_w") / F.col("_sum")).otherwise(1.0 / F.col("_n"))).drop("_w", "_sum", "_n")


def quantised_key(columns: Sequence[str], tolerance: float) -> Column:
    """Round half to even of value / tolerance, per column."""
    return F.array(*(F.bround(F.col(c) / tolerance).cast("long") for c in columns))


def compact_labels(df: DataFrame, label: str = "state") -> DataFrame:
    """Labels present, in order, become 0..k-1; -1 stays."""
    present = df.select(label).where(F.col(label) >= 0).distinct()
    codes = present.withColumn("_code", (F.row_number().over(W.orderBy(label)) - 1).cast("int"))
    return df.join(F.broadcast(codes), label, "left").withColumn(label, F.coalesce("_code", F.lit(-1))).drop("_code")


def frame_index(df: DataFrame) -> DataFrame:
    """``index``: the rank of a row within its trajectory in row order, from 0."""
    return df.withColumn("index", (F.row_number().over(W.partitionBy("traj_id").orderBy("row_id")) - 1).cast("int"))


def reset_blocks(df: DataFrame, step: str, order: str, within: Sequence[str]) -> DataFrame:
    """``block``: a new one begins where ``step`` falls."""
    over = W.partitionBy(*within).orderBy(order)
    fell = F.when(F.col(step) < F.lag(step).over(over), 1).otherwise(0)
    return df.withColumn("_fell", fell).withColumn("block", F.sum("_fell").over(over.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_fell")


def fixed_blocks(df: DataFrame, length: int, row: str = "frame") -> DataFrame:
    return df.withColumn("block", F.floor(F.col(row) / length).cast("int"))


def block_names(df: DataFrame, name: str) -> DataFrame:
    """The id of a block: its source and a six-digit number."""
    return df.withColumn("block_id", F.format_string(f"{name}:%06d", "block"))


def probability_check(df: DataFrame, q: str = "q") -> DataFrame:
    """One row: rows, the largest distance of a row's sum from 1, the smallest entry, non-finite rows."""
    s = total(F.col(q))
    bad = F.exists(q, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return df.agg(F.count("*").alias("n_rows"), F.max(F.abs(s - 1)).alias("max_row_error"), F.min(F.array_min(q)).alias("min_q"), F.count_if(bad).alias("n_bad"))
