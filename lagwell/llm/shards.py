"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lagwell.plans.lineage import materialize

#: Rows that one local permutation sorts, about, and the bounds of the number of buckets: enough for
#: parallel work on small inputs, few enough that the matrix (buckets x shards) stays a few MB at any size.
#: Beyond 1.6e8 rows a bucket grows instead, to 12 million rows (0.5 GB, sorted with spill) at 1e11.
ROWS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 20_000, 64, 8192
#: Copies of one row that are laid out together; more are spread over tasks first.
COPIES = 4096


def weights(good: int, bad: int, draws: int) -> tuple[int, np.ndarray]:
    """(least value, weights from there) of a hypergeometric law, relative to the mode's.

    Built outward from the mode by the ratios of neighbours, so their errors
    are a few roundings at any size; 12 deviations and 20 values more on either
    side leave out less than a double can tell.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(draws * (good / total) * (bad / total) * max(0.0, (total - draws) / max(1, total - 1)))
    reach = int(12 * spread) + 20
    up = np.arange(mode, min(high, mode + reach), dtype=float)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    above = np.cumprod((good - up) / (up + 1) * ((draws - up) / (bad - draws + up + 1)))
    below = np.cumprod(down / (good - down + 1) * ((bad - draws + down) / (draws - down + 1)))
    return mode - len(below), np.concatenate([below[::-1], [1.0], above])


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """A draw of the number of good items among ``draws`` of good + bad, without replacement, by inversion."""
    if good <= 0 or bad <= 0 or draws <= 0 or draws >= good + bad:
        return min(good, draws)
    least, w = weights(good, bad, draws)
    edges = np.cumsum(w)
    return least + min(int(np.searchsorted(edges, rng.random() * edges[-1], "right")), len(w) - 1)


def communication_matrix(bucket_rows: dict[int, int], n_shards: int, seed: int) -> list[tuple[int, int, int, int]]:
    """``(bucket, shard, from_rank, to_rank)``: how many rows each bucket sends to each shard.

    Row sums are the buckets' counts, column sums differ by at most one, and
    given both the matrix has the law that a uniform shuffle of all rows has.
    """
    rng = random.Random(seed)
    total = sum(bucket_rows.values())
    free = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    out = []
    for bucket, n in sorted(bucket_rows.items()):
        left, open_rows, at = n, sum(free), 0
        for s in range(n_shards):
            x = hypergeometric(rng, free[s], open_rows - free[s], left) if left else 0
            open_rows -= free[s]
            if x:
                out.append((bucket, s, at, at + x))
            free[s] -= x
            left -= x
            at += x
    return out


def hypergeometric_shards(df: DataFrame, n_shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of each row under the law ``rows``.

    Rows fall into hash buckets of about ``rows_per_bucket``; each bucket is
    permuted locally, dealt to shards by its row of the matrix, and within
    each shard permuted again in sub-buckets whose offsets make the slots
    gapless. Only counts per bucket (at most ``MOST_BUCKETS``) reach the
    driver, and the matrix that is broadcast has as many rows. The law is a
    uniform shuffle, so equal texts are not kept together. NULL texts count
    one byte and the checksum of the empty text. Rows equal in id, size and
    checksum are counted first and numbered, so that any number of copies, or
    of rows without id and text, spreads over all buckets; the result does
    not depend on the order or the files of the input. NULL ids are a value
    like any other, other columns are dropped, an empty table gives an empty
    result.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    same = materialize(rows.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("copies")))
    total = same.agg(F.sum("copies")).first()[0] or 0
    n_buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, math.ceil(total / rows_per_bucket)))
    few = same.where(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    runs = same.where(F.col("copies") > COPIES).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))).repartition("id", "run")
    many = runs.withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + (COPIES - 1), F.col("copies") - 1)))).drop("run")
    rows = few.union(many).drop("copies")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32", "copy", F.lit(seed)), F.lit(n_buckets)).cast("int"))
    counts = {r[0]: r[1] for r in rows.groupBy("bucket").count().collect()}
    matrix = spark.createDataFrame(communication_matrix(counts, n_shards, seed), "bucket int, shard int, lo long, hi long")
    local = W.partitionBy("bucket").orderBy(F.xxhash64("id", "text_crc32", "copy", F.lit(seed + 1)), "id", "text_crc32", "size", "copy")
    dealt = rows.withColumn("r", F.row_number().over(local) - 1)
    # every bucket's row of the matrix as one array, looked up by rank: no join multiplies rows
    by_bucket = matrix.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "shard"))).alias("cells"))
    dealt = dealt.join(F.broadcast(by_bucket), "bucket")
    cell = F.element_at(F.filter("cells", lambda c: (c.lo <= F.col("r")) & (F.col("r") < c.hi)), 1)
    dealt = dealt.select("id", "size", "text_crc32", "bucket", "r", cell.shard.alias("shard"))
    n_sub = math.ceil(n_buckets / n_shards)
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("bucket", "r", F.lit(seed + 2)), F.lit(n_sub)).cast("int"))
    second = W.partitionBy("shard", "sub").orderBy(F.xxhash64("bucket", "r", F.lit(seed + 3)), "bucket", "r")
    placed = dealt.withColumn("k", F.row_number().over(second) - 1)
    sizes = dealt.groupBy("shard", "sub").count()
    ahead = W.partitionBy("shard").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    start = sizes.select("shard", "sub", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    slot = placed.join(F.broadcast(start), ["shard", "sub"]).withColumn("slot", (F.col("start") + F.col("k")).cast("long"))
    return slot.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypergeometric_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
