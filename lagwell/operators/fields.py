"""Binned fields over collective variables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bin_index(x: Column, low: float, high: float, bins: int) -> Column:
    """0-based bin of a value, the last bin closed on the right; NULL outside or missing."""
    b = F.floor((x - low) / ((high - low) / bins))
    return F.when((x >= low) & (x < high) & ~F.isnan(x), F.least(b, F.lit(bins - 1))).when(x == high, bins - 1).cast("int")


def weighted_mean_field(df: DataFrame, axes: Sequence[tuple[str, float, float, int]], value: Column, weight: str = "weight") -> DataFrame:
    """Weighted mean of ``value`` and the weight in each bin that holds any."""
    names = [f"b{k}" for k in range(len(axes))]
    binned = df.select(*(bin_index(F.col(c), lo, hi, n).alias(b) for b, (c, lo, hi, n) in zip(names, axes, strict=True)), value.alias("_v"), F.col(weight).alias("_w"))
    kept = binned.where(" and ".join(f"{b} is not null" for b in names))
    s = kept.groupBy(*names).agg(F.sum("_w").alias("mass"), F.sum(F.col("_w") * F.col("_v")).alias("wv"))
    return s.select(*names, "mass", F.when(F.col("mass") > 0, F.col("wv") / F.col("mass")).alias("mean"))


def marginal_fields(df: DataFrame, axes: Sequence[tuple[str, float, float, int]], value: Column, weight: str = "weight") -> DataFrame:
    """The 3-D field and its three 2-D marginals in one pass with grouping sets; a collapsed axis is NULL."""
    names = ["b0", "b1", "b2"]
    binned = df.select(*(bin_index(F.col(c), lo, hi, n).alias(b) for b, (c, lo, hi, n) in zip(names, axes, strict=True)), value.alias("_v"), F.col(weight).alias("_w")).where("b0 is not null and b1 is not null and b2 is not null")
    sets = [[F.col(b) for b in names], *([F.col(a), F.col(b)] for a, b in (("b0", "b1"), ("b0", "b2"), ("b1", "b2")))]
    s = binned.groupingSets(sets, *names).agg(F.sum("_w").alias("mass"), F.sum(F.col("_w") * F.col("_v")).alias("wv"))
    return s.select(*names, "mass", F.when(F.col("mass") > 0, F.col("wv") / F.col("mass")).alias("mean"))


def collapse(field: DataFrame, axis: str) -> DataFrame:
    """Density-weighted mean along one axis of a field."""
    keep = [c for c in field.columns if c.startswith("b") and c != axis]
    return field.groupBy(*keep).agg((F.sum(F.col("mean") * F.col("mass")) / F.sum("mass")).alias("mean"), F.sum("mass").alias("mass"))


def plain_average(field: DataFrame, axis: str) -> DataFrame:
    keep = [c for c in field.columns if c.startswith("b") and c != axis]
    return field.groupBy(*keep).agg(F.avg("mean").alias("mean"))


def winner(fields: DataFrame, key: str, value: str = "mean") -> DataFrame:
    """Of each bin, the key with the largest value, the lower key on ties."""
    bins = [c for c in fields.columns if c.startswith("b") and c[1:].isdigit()]
    return fields.groupBy(*bins).agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k"))).alias("w")).select(*bins, F.col("w.k").alias(key), (-F.col("w.v")).alias(value))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, weight: str = "weight", by: Sequence[str] = ()) -> DataFrame:
    b = df.select(*by, bin_index(value, low, high, bins).alias("bin"), F.col(weight).alias("_w")).where("bin is not null")
    return b.groupBy(*by, "bin").agg(F.sum("_w").alias("mass"))


def axis_limits(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Finite minimum and maximum of each column in one row."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    return df.agg(*(f(finite(c)).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def grid(spark, axes: Sequence[tuple[float, float, int]]) -> DataFrame:  # noqa: ANN001
    """Bin centers of a grid: ``b0, x0, b1, x1, ...``."""
    out = spark.range(1).select()
    for k, (lo, hi, n) in enumerate(axes):
        step = (hi - lo) / n
        axis = spark.range(n).select(F.col("id").cast("int").alias(f"b{k}"), (lo + (F.col("id") + 0.5) * step).alias(f"x{k}"))
        out = axis if k == 0 else out.crossJoin(axis)
    return out


def smooth(grid_mass: np.ndarray, sigma: Sequence[float], periodic: Sequence[bool], truncate: float = 4.0) -> np.ndarray:
    """Separable Gaussian filter of a density grid, wrapped or edge-repeated per axis."""
    out = np.asarray(grid_mass, float)
    for axis, (s, wrapped) in enumerate(zip(sigma, periodic, strict=True)):
        if s <= 0:
            continue
        r = int(truncate * s + 0.5)
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
        k /= k.sum()
        pad = [(r, r) if a == axis else (0, 0) for a in range(out.ndim)]
        padded = np.pad(out, pad, mode="wrap" if wrapped else "edge")
        out = np.apply_along_axis(lambda v, k=k: np.convolve(v, k, "valid"), axis, padded)
    return out


def smoothed_mass(mass: DataFrame, axis: str, bins: int, sigma: float, periodic: bool, others: Sequence[str] = (), truncate: float = 4.0) -> DataFrame:
    """One axis of the Gaussian filter as a join on bin offsets: each bin spreads its mass over its neighbours (zeros beyond an open end)."""
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    spread = mass.select(*others, F.col(axis), "mass", F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(float(w)).alias("w")) for d, w in zip(range(-r, r + 1), k, strict=True)))).alias("o"))
    to = F.col(axis) + F.col("o.d")
    moved = spread.select(*others, (F.pmod(to, F.lit(bins)) if periodic else to).alias(axis), (F.col("mass") * F.col("o.w")).alias("mass"))
    return moved.where(F.col(axis).between(0, bins - 1)).groupBy(*others, axis).agg(F.sum("mass").alias("mass"))


def free_energy(density: DataFrame, name: str = "mass") -> DataFrame:
    """F = -ln(rho / max rho) of the bins with density."""
    return density.where(F.col(name) > 0).withColumn("free_energy", F.ln(F.max(name).over(W.partitionBy(F.lit(0))) / F.col(name)))
