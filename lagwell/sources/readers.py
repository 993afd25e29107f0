"""Readers of frame tables, colvars text, feature matrices, images and small matrices."""

from __future__ import annotations

import json
import os
import re
from urllib.parse import unquote
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwell.operators.frames import fixed_blocks, global_stride, reset_blocks, trajectory_metadata


def csv_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV frame table; without a schema every column is read as a double but the identifiers."""
    if schema is None:
        names = spark.read.option("header", True).csv(path).columns
        text = {"traj_id", "source_file"}
        schema = T.StructType([T.StructField(n, T.StringType() if n in text else T.DoubleType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("nanValue", "nan").csv(path)


def _lines(text: DataFrame) -> DataFrame:
    """``(v, source_file, _at)`` of text files: the lines without blanks around them, in order within a file."""
    return text.select(F.trim("value").alias("v"), F.input_file_name().alias("source_file"), F.monotonically_increasing_id().alias("_at"))


_DATA = "v != '' and v not like '#%'"


def _told(text: DataFrame, strict: bool, by: Sequence[str] = ()) -> DataFrame:
    """The comment that names the columns and the number of fields of the first data line, of all files or of each.

    Every comment is looked at: the first one (strict), or the last one of two
    or more names without ``=``.
    """
    names = F.split(F.trim(F.regexp_replace("v", "^#+", "")), r"\s+")
    usable = F.col("v").like("#%")
    if not strict:
        usable &= (F.size(names) >= 2) & ~F.col("v").contains("=")
    place = F.struct("source_file", "_at")
    pick = F.min_by if strict else F.max_by
    header = pick(F.when(usable, names), F.when(usable, place))
    width = F.size(F.split(F.min_by(F.when(F.expr(_DATA), F.col("v")), F.when(F.expr(_DATA), place)), r"\s+"))
    return text.groupBy(*by).agg(header.alias("header"), width.alias("width"))


def _named(rows: DataFrame, header: Sequence[str] | None, width: int | None, kind: str) -> DataFrame:
    """The fields under their names; ``col0..`` where the header does not fit, a repeated name by its first field."""
    width = max(width or 0, 0)
    header = list(header or ()) if len(header or ()) == width else [f"col{k}" for k in range(width)]
    parts = F.split("v", r"\s+")
    columns = [F.get(parts, F.lit(header.index(n))).cast(kind).alias(n) for n in dict.fromkeys(header)]
    line = (F.row_number().over(W.partitionBy("source_file").orderBy("_at")) - 1).cast("long")
    return rows.where(_DATA).withColumn("line", line).select("source_file", "line", *columns)


def colvars(spark: SparkSession, path: str, strict: bool = False, skip_first: bool = False) -> DataFrame:
    """Whitespace columns named by a ``#`` line; ``source_file`` and ``line`` (order within the file) come along.

    Tolerant: the last comment of two or more names and no ``=`` counts, and a
    file whose width differs gets ``col0..``. Strict: the first comment line
    counts, repeated names keep their first column, values are single
    precision; ``skip_first`` drops the first data row of each file.
    """
    text = _lines(spark.read.text(path))
    told = _told(text, strict).first()
    if strict and len(told["header"] or ()) != max(told["width"] or 0, 0):
        raise ValueError(f"{path}: {len(told['header'] or ())} names for {max(told['width'] or 0, 0)} columns")
    rows = _named(text, told["header"], told["width"], "float" if strict else "double")
    return rows.where("line > 0").withColumn("line", F.col("line") - 1) if strict and skip_first else rows


def folder_tables(spark: SparkSession, root: str, glob: str, tag: str) -> DataFrame:
    """Colvars files under a folder; ``traj_id`` is the relative folder and the tag's first group.

    The folder is read as one table. What each file's comments say is found
    in one aggregation, and the plan has a branch per set of columns, not
    per file.
    """
    text = _lines(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root))
    files: dict[tuple, list[tuple[str, str]]] = {}
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    for r in _told(text, False, ["source_file"]).orderBy("source_file").collect():
        path = unquote(re.sub(r"^file:/*", "/", r["source_file"]))
        inner, name = os.path.split(path[path.find(base) + len(base) :].strip("/"))
        m = re.search(tag, name)
        files.setdefault((tuple(r["header"] or ()), r["width"]), []).append((r["source_file"], "/".join(x for x in (inner, m[1] if m else name) if x)))
    if not files:
        raise ValueError(f"no {glob} under {root}")
    out = None
    for (header, width), held in files.items():
        names = F.broadcast(spark.createDataFrame(held, "source_file string, traj_id string"))
        table = _named(text.join(names.select("source_file"), "source_file", "left_semi"), header, width, "double").join(names, "source_file")
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    return out


def scan(spark: SparkSession, *, tables: Sequence[str] = (), colvars_files: Sequence[str] = (), folders: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """The ordered union of tables (CSV or Parquet), colvars files and folders, by column name, with ``source_order``."""
    parts = []
    for p in tables:
        t = spark.read.parquet(p) if p.rstrip("/").endswith(".parquet") else csv_table(spark, p)
        parts.append(t if "traj_id" in t.columns else t.withColumn("traj_id", F.lit(os.path.splitext(os.path.basename(p))[0])))
    parts += [colvars(spark, p).withColumn("traj_id", F.lit(os.path.splitext(os.path.basename(p))[0])) for p in colvars_files]
    parts += [folder_tables(spark, *f) for f in folders]
    if not parts:
        raise ValueError("no sources")
    out = None
    for k, t in enumerate(parts):
        t = t.withColumn("source_order", F.lit(k)).withColumn("traj_id", F.col("traj_id").cast("string"))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def blocks(df: DataFrame, *, name: str, order: str, step: str | None = None, frames_per_traj: int | None = None, within: Sequence[str] = ("source_order",)) -> DataFrame:
    """``traj_id``: kept where present, else fixed-length blocks, else a new block where the step falls, else one block."""
    if "traj_id" in df.columns:
        return df
    if frames_per_traj:
        cut = fixed_blocks(df, frames_per_traj, order)
    elif step and step in df.columns:
        cut = reset_blocks(df, step, order, within)
    else:
        cut = df.withColumn("block", F.lit(0))
    return cut.withColumn("traj_id", F.format_string(f"{name}:%06d", "block")).drop("block")


def array_columns(df: DataFrame, array: str, names: Sequence[str]) -> DataFrame:
    """One column per entry of an array, checked against the number of names."""
    wrong = F.when(F.size(array) != len(names), F.raise_error(F.lit(f"{array} does not have {len(names)} entries")))
    guarded = df.withColumn(array, F.coalesce(wrong, F.col(array)))
    return guarded.select("*", *(F.get(array, F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)))


def default_names(n: int, kind: str, meta: Sequence[str] | None = None) -> list[str]:
    """Names from the metadata where their number fits, else ``<kind>_<k>``."""
    return list(meta) if meta is not None and len(meta) == n else [f"{kind}_{k}" for k in range(n)]


def dataset(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(frames with defaults, metadata): weight 1/n, state -1, trajectory 0 where absent. The metadata is a JSON file beside the table."""
    df = spark.read.parquet(path)
    meta = [r[0] for r in spark.read.text(f"{path.rstrip('/')}.meta.json", wholetext=True).collect()] if _exists(spark, f"{path.rstrip('/')}.meta.json") else []
    if "weight" not in df.columns:
        df = df.withColumn("weight", F.lit(1.0 / max(df.count(), 1)))
    if "state" not in df.columns:
        df = df.withColumn("state", F.lit(-1))
    if "traj_id" not in df.columns:
        df = df.withColumn("traj_id", F.lit(0).cast("long"))
    return df, json.loads(meta[0]) if meta else {}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def samples(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    return global_stride(spark.read.parquet(path), stride)


def external_features(frames: DataFrame, features: DataFrame, column: str = "x") -> DataFrame:
    """Features joined by ``row_id``; a frame without a row, or a non-finite entry, is an error when read."""
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    joined = frames.join(features.select("row_id", column), "row_id", "left")
    return joined.withColumn(column, F.when(F.col(column).isNull() | bad, F.raise_error(F.lit("missing or non-finite features"))).otherwise(F.col(column)))


def array_file(spark: SparkSession, path: str, key: str = "X") -> DataFrame:
    """``(row_id, x)`` of a NumPy or CSV matrix small enough for one machine; a CSV may begin with ``META={json}``."""
    if path.endswith((".npy", ".npz")):
        loaded = np.load(path, mmap_mode="r")
        m = loaded[key] if path.endswith(".npz") else loaded
    else:
        with open(path) as f:
            skip = f.readline().startswith("META=")
        m = np.loadtxt(path, delimiter=",", skiprows=int(skip), ndmin=2)
    if m.ndim != 2 or not np.isfinite(m).all():
        raise ValueError("features must be a finite two-dimensional matrix")
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(m)], "row_id long, x array<double>")


def images(spark: SparkSession, sources: Sequence[np.ndarray | str]) -> DataFrame:
    """``(path_id, image_id, x)`` of path arrays or text files; a 3-D array holds several paths."""
    rows, p = [], 0
    for s in sources:
        a = (np.load(s, allow_pickle=False) if s.endswith(".npy") else np.loadtxt(s, ndmin=2)) if isinstance(s, str) else np.asarray(s, float)
        for path in a if a.ndim == 3 else [a]:
            rows += [(p, k, [float(v) for v in x]) for k, x in enumerate(path)]
            p += 1
    return spark.createDataFrame(rows, "path_id long, image_id int, x array<double>")


def square_matrix(path: str) -> np.ndarray:
    """A square matrix from .npy or CSV; a header and an index column are recognised."""
    if path.endswith(".npy"):
        m = np.load(path)
    else:
        with open(path) as f:
            lines = [line.strip().split(",") for line in f if line.strip()]
        number = lambda v: _float(v) is not None
        if not all(map(number, lines[0][1:])) or (len(lines) == len(lines[0]) + 1) or (len(lines[1]) == len(lines) and lines[0][0] == ""):
            lines = lines[1:]
        m = np.array([[_float(v) for v in row[len(row) - len(lines) :]] for row in lines], float)
    if m.ndim != 2 or m.shape[0] != m.shape[1]:
        raise ValueError(f"{path}: not a square matrix")
    return m


def _float(v: str) -> float | None:
    try:
        return float(v) if v.strip() else float("nan")
    except ValueError:
        return None


def first_matrix(folder: str, names: Sequence[str]) -> np.ndarray:
    for n in names:
        if os.path.exists(os.path.join(folder, n)):
            return square_matrix(os.path.join(folder, n))
    raise FileNotFoundError(f"none of {list(names)} in {folder}")


def pair_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(stem_a, stem_b, how)``: equal (folder, stem) first; of the rest those whose tag is unique on both sides.

    Each side holds ``folder stem tag``.
    """
    exact = a.alias("a").join(b.alias("b"), (F.col("a.folder") == F.col("b.folder")) & (F.col("a.stem") == F.col("b.stem"))).select(F.col("a.stem").alias("stem_a"), F.col("b.stem").alias("stem_b"), F.lit("exact").alias("how"))
    rest_a, rest_b = a.join(b, ["folder", "stem"], "left_anti"), b.join(a, ["folder", "stem"], "left_anti")
    only = lambda d: d.groupBy("tag").agg(F.count("*").alias("n"), F.first("stem").alias("stem")).where("n = 1 and tag is not null")
    tagged = only(rest_a).alias("a").join(only(rest_b).alias("b"), F.col("a.tag") == F.col("b.tag")).select(F.col("a.stem").alias("stem_a"), F.col("b.stem").alias("stem_b"), F.lit("tag").alias("how"))
    return exact.unionByName(tagged)


def count_rows(spark: SparkSession, path: str) -> int:
    """Lines that are neither comments nor blank."""
    return spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).count()


def strided_length(n: int, stride: int) -> int:
    return -(-n // stride)


def config(path: str, sections: Sequence[str] = ()) -> dict:
    """A YAML mapping; the first section present, else the whole document."""
    import yaml

    with open(path) as f:
        doc = yaml.safe_load(f) or {}
    if not isinstance(doc, dict):
        raise ValueError("the configuration must be a mapping")
    return next((doc[s] for s in sections if isinstance(doc.get(s), dict)), doc)


__all__ = ["array_columns", "array_file", "blocks", "colvars", "config", "count_rows", "csv_table", "dataset", "default_names", "external_features", "first_matrix", "folder_tables", "images", "pair_files", "require_columns", "samples", "scan", "square_matrix", "strided_length", "trajectory_metadata"]
