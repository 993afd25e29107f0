"""Lag pairing. Three meanings that differ on gaps and re-appearing trajectories, and stay three functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwell.operators.frames import by_trajectory


def positional_pairs(df: DataFrame, lag: int, columns: Sequence[str], *, allow_cross: bool = False) -> DataFrame:
    """Row r with row r + lag of the table, kept where both are of one trajectory.

    Needs a dense ``row_id``. An equi-join on ``row_id + lag`` and not a
    window over the whole table, which would be one partition.
    """
    if lag < 1:
        raise ValueError("lag must be positive")
    later = df.select((F.col("row_id") - lag).alias("row_id"), F.col("traj_id").alias("traj_id_tau"), *(F.col(c).alias(f"{c}_tau") for c in columns))
    pairs = df.join(later, "row_id")
    return (pairs if allow_cross else pairs.where("traj_id = traj_id_tau")).drop("traj_id_tau")


def keyed_pairs(df: DataFrame, lags: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """(traj, frame) with (traj, frame + lag) for every lag; gaps give no pair, row order does not matter."""
    later = df.select("traj_id", F.col("frame").alias("_at"), *(F.col(c).alias(f"{c}_tau") for c in columns))
    starts = df.withColumn("lag", F.explode(F.array(*(F.lit(x) for x in lags)))).withColumn("_at", F.col("frame") + F.col("lag"))
    return starts.join(later, ["traj_id", "_at"]).drop("_at")


def sequence_pairs(df: DataFrame, lags: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """Each row of a trajectory with the one ``lag`` places later in frame order; gaps are bridged.

    All lags come from one window, hence one shuffle and one sort.
    """
    over = by_trajectory()
    shifted = [F.struct(F.lit(x).alias("lag"), F.lead(F.lit(True), x).over(over).alias("there"), *(F.lead(c, x).over(over).alias(f"{c}_tau") for c in columns)) for x in lags]
    wide = df.withColumn("_lags", F.array(*shifted))
    return wide.select(*df.columns, F.explode("_lags").alias("_l")).where("_l.there").select(*df.columns, "_l.lag", *(f"_l.{c}_tau" for c in columns))


def halo_pairs(df: DataFrame, lags: Sequence[int], columns: Sequence[str], *, block: int = 1 << 16) -> DataFrame:
    """The pairs of :func:`sequence_pairs` for a dense ``row_id`` in trajectory and frame order, whatever the length of a trajectory.

    The table is cut into blocks of so many rows, each with the rows of the
    widest lag that follow it, so a trajectory that holds most of the table
    lies in many groups and none holds more than ``block`` rows and a lag. One
    shuffle for all lags. Rows with a NULL ``traj_id`` pair with nothing.
    """
    widest = max(lags)
    if min(lags) < 1 or block < widest:
        raise ValueError("lags must be positive and no longer than a block")
    home = df.withColumns({"_block": F.floor(F.col("row_id") / block).cast("long"), "_home": F.lit(True)})
    halo = home.where(F.pmod("row_id", F.lit(block)) < widest).withColumns({"_block": F.col("_block") - 1, "_home": F.lit(False)})
    over = W.partitionBy("_block").orderBy("row_id")
    shifted = [F.struct(F.lit(x).alias("lag"), (F.lead("traj_id", x).over(over) == F.col("traj_id")).alias("there"), *(F.lead(c, x).over(over).alias(f"{c}_tau") for c in columns)) for x in lags]
    wide = home.union(halo).withColumn("_lags", F.array(*shifted)).where("_home")
    return wide.select(*df.columns, F.explode("_lags").alias("_l")).where("_l.there").select(*df.columns, "_l.lag", *(f"_l.{c}_tau" for c in columns))


def labelled_filter(pairs: DataFrame, require: str, a: str = "state", b: str = "state_tau") -> DataFrame:
    """Training pairs by label: ``none``, ``any`` end or ``both`` ends labelled."""
    rules: dict[str, Column] = {"none": F.lit(True), "any": (F.col(a) >= 0) | (F.col(b) >= 0), "both": (F.col(a) >= 0) & (F.col(b) >= 0)}
    if require not in rules:
        raise ValueError(f"require_labeled must be one of {sorted(rules)}")
    return pairs.where(rules[require])


def pair_labels(df: DataFrame, n_states: int) -> DataFrame:
    """For each i < j: 0 where the state is i, 1 where it is j, else -1, as ``pair_labels`` in pair order."""
    labels = [F.when(F.col("state") == i, 0).when(F.col("state") == j, 1).otherwise(-1) for i in range(n_states) for j in range(i + 1, n_states)]
    return df.withColumn("pair_labels", F.array(*labels))


def positive_pairs(pairs: DataFrame) -> DataFrame:
    """Both ends of positive weight."""
    return pairs.where("weight > 0 and weight_tau > 0")


def lag_timing(lag: int, stride: int, frame_time: float = 1.0, in_original_frames: bool = True) -> tuple[int, float]:
    """(lag in strided frames, tau). A lag in original frames must be a multiple of the stride."""
    if lag < 1 or stride < 1:
        raise ValueError("lag and stride must be positive")
    if in_original_frames:
        if lag % stride:
            raise ValueError(f"lag {lag} is not a multiple of the stride {stride}")
        return lag // stride, lag * frame_time
    return lag, lag * stride * frame_time
