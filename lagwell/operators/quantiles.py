"""Exact quantiles, ranks and running sums of groups that no single task could hold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwell.plans.lineage import materialize

#: Relative accuracy of the sketches that propose ranges; bins of a refinement; distinct values of a range that are looked at one by one.
ACCURACY, BINS, LEAF = 2000, 64, 20_000


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (), *, leaf: int = LEAF, accuracy: int = ACCURACY) -> DataFrame:
    """``(*by, quantiles)``: of each group the interpolated quantiles of ``value``, equal to ``percentile``'s; NULLs do not count, a group without values has no row.

    The rank a quantile needs is closed in by histograms. A sketch proposes a
    range around it, an exact count of what lies below and inside keeps or
    shifts the range, and the rows inside become ``(value, count)``; while a
    range has more than ``leaf`` distinct values it is cut into ``BINS`` and
    the bins that hold the rank stay. Sketches and counts are partial
    aggregates, so a group may have any number of rows, all of them equal or
    all different.
    """
    by, key = list(by), [*by, "k"]
    rows = materialize(df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null"))  # read three times
    near = 4.0 / accuracy
    asked = sorted({max(0.0, min(1.0, q + d)) for q in probabilities for d in (-near, near)})
    cuts = materialize(rows.groupBy(*by).agg(F.percentile_approx("v", asked, accuracy).alias("cuts")))
    binned = joined_on(rows, cuts, by).select(*by, "v", _bin())
    bins = binned.groupBy(*by, "bin").agg(F.count("*").alias("m"))
    before, whole = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by)  # a row a bin
    counted = bins.withColumns({"before": F.coalesce(F.sum("m").over(before), F.lit(0)), "size": F.sum("m").over(whole)})
    targets = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(q) * (F.col("size") - 1)).alias("t")) for k, q in enumerate(probabilities)))).alias("target")
    held = _holding(counted.select(*by, "bin", "m", "before", targets).select(*by, "bin", "m", "before", "target.*"), key)
    inside = joined_on(binned, held, by).where(F.col("bin").between(F.col("b0"), F.col("b1")))
    cells = materialize(inside.groupBy(*key, "v").agg(F.count("*").alias("n"), F.any_value("t").alias("t"), F.any_value("below").alias("below")))
    while cells.groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > leaf).limit(1).count():
        steps = [i / BINS for i in range(1, BINS)]
        cuts = cells.groupBy(*key).agg(F.percentile_approx("v", steps, 100 * BINS).alias("cuts"))
        cells = _narrowed(joined_on(cells, cuts, key), key)
    run = F.col("below") + F.sum("n").over(W.partitionBy(*key).orderBy("v"))
    ends = cells.withColumn("_upto", run).groupBy(*key).agg(F.any_value("t").alias("t"), *(F.min(F.when(F.col("_upto") > f("t"), F.col("v"))).alias(name) for name, f in (("v0", F.floor), ("v1", F.ceil))))
    at = F.when(F.ceil("t") == F.floor("t"), F.col("v0")).otherwise((F.ceil("t") - F.col("t")) * F.col("v0") + (F.col("t") - F.floor("t")) * F.col("v1"))
    return ends.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", at.alias("x")))), lambda s: s.x).alias("quantiles")).where(F.size("quantiles") > 0)


def joined_on(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """An inner join in which NULL keys meet; ``right`` has a row a group."""
    if not on:
        return left.crossJoin(F.broadcast(right))
    named = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    return left.join(named, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on))).drop(*(f"_on_{c}" for c in on))


def _bin() -> Column:
    """How many of the row's ``cuts`` lie below its value."""
    return F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bin")


def _holding(placed: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, b0, b1, below, t)``: the bins that hold the ranks around ``t``, and how many values lie before them."""
    held = placed.where((F.col("before") <= F.ceil("t")) & (F.col("before") + F.col("m") > F.floor("t")))
    return held.groupBy(*key).agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"), F.min("before").alias("below"), F.any_value("t").alias("t"))


def _narrowed(cells: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, v, n, t, below)`` of the bins between ``cuts`` that hold the ranks around ``t``."""
    binned = cells.withColumn("bin", _bin())
    bins = binned.groupBy(*key, "bin").agg(F.sum("n").alias("m"), F.any_value("t").alias("t"), F.any_value("below").alias("below"))
    over = W.partitionBy(*key).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # at most BINS rows
    held = _holding(bins.withColumn("before", F.col("below") + F.coalesce(F.sum("m").over(over), F.lit(0))), key)
    return materialize(joined_on(binned.select(*key, "v", "n", "bin"), held, key).where(F.col("bin").between(F.col("b0"), F.col("b1"))).select(*key, "v", "n", "t", "below"))


def ranked_within(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], weight: str | None = None) -> DataFrame:
    """Add ``_rank`` (from 1) and ``_size`` of each row in its group, with ``weight`` also its sums ``_before`` the row, ``_upto`` with it, and ``_mass`` over the group.

    What windows over the whole group give, for groups of any size: a range
    partitioning deals a large group to many tasks, windows number each
    task's share of it, and the sums of the shares before it are added.
    ``order`` must be total.
    """
    part = materialize(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    w = F.col(weight) if weight else F.lit(0.0)
    share = part.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.sum(w).alias("_w"))
    before, whole = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by)
    starts = share.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(before), F.lit(0.0)).alias("_w0"), F.sum("_n").over(whole).alias("_size"), F.sum("_w").over(whole).alias("_mass"))
    mine = W.partitionBy(*by, "_part").orderBy(*order)
    local = part.withColumns({"_rank": F.row_number().over(mine), "_before": F.coalesce(F.sum(w).over(mine.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), "_upto": F.sum(w).over(mine.rowsBetween(W.unboundedPreceding, 0))})
    found = joined_on(local, starts, [*by, "_part"]).withColumns({"_rank": F.col("_rank") + F.col("_n0"), "_before": F.col("_before") + F.col("_w0"), "_upto": F.col("_upto") + F.col("_w0")})
    columns = [*df.columns, "_rank", "_size"] + (["_before", "_upto", "_mass"] if weight else [])
    return found.select(*columns)
