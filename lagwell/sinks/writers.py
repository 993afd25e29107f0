"""Datasets with JSON sidecars, stage manifests, summaries, tables of rates, LaTeX."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Through Hadoop, so that any store Spark can write works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _plain(x):  # noqa: ANN001, ANN202
    """NumPy scalars and arrays to JSON; NaN and infinity to null."""
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, np.ndarray)):
        return [_plain(v) for v in x]
    if isinstance(x, np.generic):
        x = x.item()
    return None if isinstance(x, float) and not math.isfinite(x) else x


def save_dataset(df: DataFrame, path: str, meta: dict) -> None:
    """Frames as Parquet, metadata as ``<path>.meta.json``."""
    df.write.mode("overwrite").parquet(path)
    save_meta(df.sparkSession, path, meta)


def save_meta(spark: SparkSession, path: str, meta: dict) -> None:
    _write_text(spark, f"{path.rstrip('/')}.meta.json", json.dumps(_plain(meta), sort_keys=True))


def save_inspection(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A CSV folder of the chosen columns with ``is_intermediate``."""
    df.select(*columns, (F.col("state") < 0).alias("is_intermediate")).write.mode("overwrite").option("header", True).csv(path)


def assignments(df: DataFrame, n_states: int, extra: Sequence[str] = ()) -> DataFrame:
    """Frame, trajectory, weight, state, argmax and one column per probability."""
    best = (F.array_position("q", F.array_max("q")) - 1).cast("int")
    return df.select("row_id", "traj_id", "frame", "weight", "state", best.alias("q_argmax"), *(F.get("q", F.lit(k)).alias(f"q_{k}") for k in range(n_states)), *extra)


def manifest_hash(manifest: dict) -> str:
    return hashlib.sha256(json.dumps(_plain(manifest), sort_keys=True).encode()).hexdigest()[:16]


def content_hash(df: DataFrame) -> str:
    """A name for what a table holds, whatever the order of its rows: their number and the sum of their hashes."""
    columns = [F.to_json(c) if t.startswith("map") else F.col(c) for c, t in sorted(df.dtypes)]
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s")).first()
    return manifest_hash({"columns": sorted(df.dtypes), "rows": r["n"], "sum": str(r["s"])})


def save_stage(df: DataFrame, path: str, manifest: dict) -> None:
    """A stage table and its manifest; reuse compares the hash, so a changed configuration is not served old results."""
    df.write.mode("overwrite").parquet(path)
    _write_text(df.sparkSession, f"{path.rstrip('/')}.manifest.json", json.dumps({"hash": manifest_hash(manifest), "manifest": _plain(manifest)}, sort_keys=True))


def reusable(spark: SparkSession, path: str, manifest: dict) -> bool:
    from lagwell.sources.readers import _exists

    at = f"{path.rstrip('/')}.manifest.json"
    if not (_exists(spark, path) and _exists(spark, at)):
        return False
    text = "".join(r[0] for r in spark.read.text(at, wholetext=True).collect())
    return json.loads(text)["hash"] == manifest_hash(manifest)


def stage_table(df_of, spark: SparkSession, path: str, manifest: dict, force: bool = False) -> DataFrame:  # noqa: ANN001
    """The stage's table: read where its manifest matches, else computed, written and read back."""
    if force or not reusable(spark, path, manifest):
        save_stage(df_of(), path, manifest)
    return spark.read.parquet(path)


def rate_table(k_direct: np.ndarray, mfpt: np.ndarray, k_mfpt: np.ndarray, p_jump: np.ndarray, std: np.ndarray | None = None) -> list[dict]:
    """One row per ordered pair; ``k`` is the effective rate 1 / MFPT, ``k_direct`` the direct one."""
    n = len(k_direct)
    return [{"i": i, "j": j, "k": _plain(float(k_mfpt[i, j])), "k_direct": _plain(float(k_direct[i, j])), "mfpt": _plain(float(mfpt[i, j])), "p_jump": _plain(float(p_jump[i, j])), "std": None if std is None else _plain(float(std[i, j]))} for i in range(n) for j in range(n) if i != j]


def write_yaml(data: dict, path: str) -> None:
    import yaml

    with open(path, "w") as f:
        yaml.safe_dump(_plain(data), f, sort_keys=False)


def msm_summary(transitions: DataFrame, residence: DataFrame) -> DataFrame:
    """Per lag: smallest and mean self transition, shortest residence, longest escape."""
    diag = transitions.where("i = j").groupBy("lag").agg(F.min("p").alias("min_self"), F.avg("p").alias("mean_self"))
    times = residence.groupBy("lag").agg(F.min("residence").alias("min_residence"), F.max("escape").alias("max_escape"))
    return diag.join(times, "lag")


def save_paths(images: DataFrame, folder: str, scores: Sequence[str] = ()) -> None:
    """Every path as text under ``path_id=<id>``: an image a line in order, its coordinates and then the named scores, separated by blanks.

    ``images`` holds ``path_id``, ``image_id`` and ``x``; one task writes one
    path. A rerun replaces the folder.
    """
    numbers = F.concat(F.col("x"), F.array(*(F.col(c).cast("double") for c in scores))) if scores else F.col("x")
    line = F.array_join(F.transform(numbers, lambda v: F.format_string("%.10g", v)), " ")
    dealt = images.select("path_id", "image_id", line.alias("value")).repartition("path_id").sortWithinPartitions("path_id", "image_id")
    dealt.select("path_id", "value").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("path_id").text(folder)


def save_grid(spark: SparkSession, folder: str, axes: Sequence[tuple[str, float, float, int]], fields: dict[str, np.ndarray], meta: dict | None = None) -> DataFrame:
    """Fields over one grid as a table: bin and center of each axis and a column per field, non-finite values as NULL; axes and ``meta`` beside it."""
    shape = tuple(a[3] for a in axes)
    centers = [lo + (np.arange(n) + 0.5) * (hi - lo) / n for _, lo, hi, n in axes]
    rows = []
    for at in np.ndindex(*shape):
        values = (float(f[at]) for f in fields.values())
        rows.append((*at, *(float(c[b]) for b, c in zip(at, centers, strict=True)), *(v if math.isfinite(v) else None for v in values)))
    kinds = [*(f"b{k} int" for k in range(len(axes))), *(f"{a[0]} double" for a in axes), *(f"{n} double" for n in fields)]
    spark.createDataFrame(rows, ", ".join(kinds)).write.mode("overwrite").parquet(folder)
    save_meta(spark, folder, {"axes": [{"name": n, "low": lo, "high": hi, "bins": k} for n, lo, hi, k in axes], **(meta or {})})
    return spark.read.parquet(folder)


def save_training(spark: SparkSession, folder: str, network: DataFrame, history: Sequence[dict], flux: DataFrame | None = None) -> None:
    """What a training leaves: ``network`` (a table of its numbers), ``history`` (CSV, an epoch a line) and, with ``flux``, the profiles of the flux at its end."""
    network.write.mode("overwrite").parquet(f"{folder}/network")
    names = list(history[0]) if history else ["epoch", "train", "validation"]
    kinds = ", ".join(f"{n} {'int' if n == 'epoch' else 'double'}" for n in names)
    rows = spark.createDataFrame([tuple(int(h[n]) if n == "epoch" else float(h[n]) for n in names) for h in history], kinds)
    rows.coalesce(1).sortWithinPartitions("epoch").write.mode("overwrite").option("header", True).csv(f"{folder}/history")
    if flux is not None:
        flux.write.mode("overwrite").parquet(f"{folder}/flux")


def scientific(value: float | None, std: float | None = None, precision: int = 2) -> str:
    """LaTeX ``a \\times 10^{b}``, with an error under the same exponent; a dash where undefined."""
    if value is None or not math.isfinite(value):
        return "--"
    if value == 0:
        return "0"
    e = math.floor(math.log10(abs(value)))
    body = f"{value / 10**e:.{precision}f}"
    if std is not None and math.isfinite(std):
        body = f"({body} \\pm {std / 10**e:.{precision}f})"
    return f"${body} \\times 10^{{{e}}}$"


def latex_directed(k: np.ndarray, caption: str, label: str, std: np.ndarray | None = None, precision: int = 2) -> str:
    n = len(k)
    rows = [f"{i} $\\to$ {j} & {scientific(float(k[i, j]), None if std is None else float(std[i, j]), precision)} \\\\" for i in range(n) for j in range(n) if i != j]
    return "\n".join(["\\begin{table}", f"\\caption{{{caption}}}", f"\\label{{{label}}}", "\\begin{tabular}{lc}", "\\hline", "pair & $k$ \\\\", "\\hline", *rows, "\\hline", "\\end{tabular}", "\\end{table}"])


def latex_pairs(k: np.ndarray, caption: str, label: str, std: np.ndarray | None = None, reference: dict[tuple[int, int], float] | None = None, precision: int = 2) -> str:
    """Unordered pairs with both directions and an optional reference."""
    s = lambda i, j: scientific(float(k[i, j]), None if std is None else float(std[i, j]), precision)
    rows = [f"{i}, {j} & {s(i, j)} & {s(j, i)}" + (f" & {scientific((reference or {}).get((i, j)), None, precision)}" if reference is not None else "") + " \\\\" for i in range(len(k)) for j in range(i + 1, len(k))]
    head = "pair & forward & backward" + (" & reference" if reference is not None else "") + " \\\\"
    return "\n".join(["\\begin{table}", f"\\caption{{{caption}}}", f"\\label{{{label}}}", f"\\begin{{tabular}}{{lcc{'c' if reference is not None else ''}}}", "\\hline", head, "\\hline", *rows, "\\hline", "\\end{tabular}", "\\end{table}"])
