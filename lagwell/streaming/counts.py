"""An extension: transition counts kept up to date by a stream of frames.

Counts are sums over lag pairs, so each new frame adds its own pairs. The
state per trajectory is its last ``lag`` frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_pairs(frames: DataFrame, lag: int) -> DataFrame:
    """``(traj_id, frame, i, j, weight)`` of lag pairs, from frames that arrive in frame order per trajectory."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        held = list(zip(*state.get, strict=True)) if state.exists else []
        new = pd.concat(list(batches)).sort_values("frame")
        out = []
        for f, s, w in zip(new.frame, new.state, new.weight, strict=True):
            held.append((int(f), int(s), float(w)))
            if len(held) > lag:
                a = held[-1 - lag]
                out.append((key[0], a[0], a[1], int(s), a[2]))
            held = held[-lag - 1 :]
        held = held[-lag:]
        state.update(tuple(list(c) for c in zip(*held, strict=True)))
        yield pd.DataFrame(out, columns=["traj_id", "frame", "i", "j", "weight"])

    return frames.groupBy("traj_id").applyInPandasWithState(run, "traj_id long, frame int, i int, j int, weight double", "frame array<int>, state array<int>, weight array<double>", "append", "NoTimeout")


def running_counts(pairs: DataFrame) -> DataFrame:
    kept = pairs.where("i >= 0 and j >= 0 and weight > 0")
    return kept.groupBy("i", "j").agg(F.sum("weight").alias("count"), F.count("*").alias("n_pairs"))


def tumbling_activity(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Frames and weight per state and window of event time, late rows beyond the watermark dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "state").agg(F.count("*").alias("n"), F.sum("weight").alias("mass"))
