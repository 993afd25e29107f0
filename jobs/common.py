"""What the jobs share: configuration, session of the command line, log lines, folders of the registered queries."""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lagwell.plans.lineage import shared_dir

log = logging.getLogger("jobs")


def shipped_config(module: str) -> dict:
    """The configuration that lies beside a job."""
    return json.loads(Path(module).with_suffix(".json").read_text())


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON object from any store that Spark reads."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one, for one call of a registered query."""
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def replace_table(df: DataFrame, path: str, by: str) -> tuple[DataFrame, int]:
    """Write the whole table anew, so that no partition of an earlier configuration stays; read back, with its rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(by).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    n = table.count()
    log.info("wrote %d rows to %s", n, path)
    return table, n


def main(run: Callable[..., dict], module: str, about: str, paths: tuple[str, ...]) -> None:
    """Parse the paths, make a session, run the job, stop the session."""
    parser = argparse.ArgumentParser(description=about)
    for p in paths:
        parser.add_argument(f"--{p}", required=True, help="a path that Spark can read or write")
    parser.add_argument("--config", help="a JSON file; the one beside the job if absent")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(Path(module).stem).getOrCreate()
    try:
        config = read_config(spark, given.config) if given.config else shipped_config(module)
        log.info("done: %s", json.dumps(run(spark, *(getattr(given, p) for p in paths), config)))
    finally:
        spark.stop()
