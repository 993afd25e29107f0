"""Cutting lineage without tying results to one executor's disk."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where that setting is absent a temporary folder of this machine is made,
    which only a session without other machines may use; any other one gets
    an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    known = getattr(spark.sparkContext, "_lagwell_dir", None)
    if known is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        known = f"file://{tempfile.mkdtemp(prefix='lagwell-')}"
        spark.sparkContext._lagwell_dir = known
    return known


def file_system(spark: SparkSession, name: str):  # noqa: ANN202
    """The path and its file system, on the JVM's side."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def session_dir(spark: SparkSession) -> str:
    """The folder of this session's tables, deleted when the driver ends."""
    known = getattr(spark.sparkContext, "_lagwell_tables", None)
    if known is None:
        known = f"{shared_dir(spark)}/lagwell/{uuid.uuid4().hex}"
        path, files = file_system(spark, known)
        files.mkdirs(path)
        files.deleteOnExit(path)
        spark.sparkContext._lagwell_tables = known
    return known


#: Rows a task of a small intermediate result holds, about.
ROWS_PER_PART = 10_000


def materialize(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later jobs scan compressed columns instead of recomputing, and a lost
    executor loses nothing: the files are in the shared store. With
    ``most_rows``, a bound of its rows, it is written by as many tasks as that
    many rows need, where the plan has more. The files go with the driver, or
    before: see :func:`discard` and :func:`passing`.
    """
    if most_rows is not None:
        df = df.coalesce(max(1, -(-most_rows // ROWS_PER_PART)))
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lagwell_path = path
    del df
    if time.monotonic() - getattr(spark.sparkContext, "_lagwell_forgot", -FORGET_EVERY) >= FORGET_EVERY:
        forget(spark)
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is dealt by its keys, never gathered on the driver.

    For what grows with the input: the size by which Spark chooses a
    broadcast is that of compressed files, and of one element an array, so a
    table of millions of narrow rows passes for a small one.
    """
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that no plan will read again; any other DataFrame is left alone."""
    name = getattr(df, "_lagwell_path", None)
    if name:
        path, files = file_system(df.sparkSession, name)
        files.delete(path, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was materialized inside; results must have been written or collected by then."""
    path, files = file_system(spark, session_dir(spark))
    before = {s.getPath().getName() for s in files.listStatus(path)}
    try:
        yield
    finally:
        for s in files.listStatus(path):
            if s.getPath().getName() not in before:
                files.delete(s.getPath(), True)


#: Seconds between two of its own accord.
FORGET_EVERY = 3.0


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    spark.sparkContext._lagwell_forgot = time.monotonic()
