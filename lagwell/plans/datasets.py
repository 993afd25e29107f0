"""Labelled datasets for training: built from frames, and relabelled in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwell.operators.counting import populations
from lagwell.operators.frames import basin_labels, frame_table, periodic_features
from lagwell.plans.lineage import file_system
from lagwell.sinks.writers import save_meta
from lagwell.sources.readers import dataset

Basin = tuple[int, Sequence[float], Sequence[float] | float]


def build_dataset(frames: DataFrame, path: str, columns: Sequence[str], basins: Sequence[Basin], *, periodic: Sequence[str] = (), basin_columns: Sequence[str] = (), shape: str = "box", discard_before: int = 0, stride: int = 1) -> tuple[DataFrame, dict]:
    """(dataset, metadata) written at ``path``: the frame table with the model's input ``x``, ``state`` and ``dist``.

    ``columns`` make the input, periodic ones as sine and cosine;
    ``basin_columns`` (the same by default) are those that basins are given
    in. The metadata tells how the labels came about and how many frames each
    state has.
    """
    over = list(basin_columns or columns)
    inputs = periodic_features(list(columns), list(periodic))
    table = basin_labels(frame_table(frames, discard_before=discard_before, stride=stride), over, basins, shape)
    names = [n for c in columns for n in ((f"sin{c}", f"cos{c}") if c in periodic else (c,))]
    out = table.withColumn("x", F.array(*(c.cast("double") for c in inputs)))
    return _written(out, path, {"features": names, "periodic": list(periodic), "discard_before": discard_before, "stride": stride, **_label_meta(over, basins, shape)})


def relabel_dataset(spark: SparkSession, path: str, basins: Sequence[Basin], shape: str = "box") -> tuple[DataFrame, dict]:
    """The dataset at ``path`` with labels by other basins; the old files go once the new ones are complete."""
    held, meta = dataset(spark, path)
    over = meta.get("basin_columns")
    if not over:
        raise ValueError(f"{path} does not tell the columns of its basins")
    fresh = basin_labels(held.drop("state", "dist"), over, basins, shape).select(*held.columns)
    _written(fresh, f"{path.rstrip('/')}.new", meta | _label_meta(over, basins, shape))
    for end in ("", ".meta.json"):
        old, files = file_system(spark, f"{path.rstrip('/')}{end}")
        new, _ = file_system(spark, f"{path.rstrip('/')}.new{end}")
        files.delete(old, True)
        files.rename(new, old)
    spark.catalog.refreshByPath(path)
    return dataset(spark, path)


def _label_meta(columns: Sequence[str], basins: Sequence[Basin], shape: str) -> dict:
    return {"basin_columns": list(columns), "basins": [[s, list(c), list(w) if isinstance(w, Sequence) else w] for s, c, w in basins], "shape": shape}


def _written(df: DataFrame, path: str, meta: dict) -> tuple[DataFrame, dict]:
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    states = {str(r["state"]): r["n_frames"] for r in populations(spark.read.parquet(path)).collect()}
    save_meta(spark, path, meta | {"states": states})
    return dataset(spark, path)
