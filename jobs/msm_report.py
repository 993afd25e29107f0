"""Markov state model of a table of time-ordered observations, with errors and a test of its lag.

Reads observations (trajectory, order, label, weight), writes

* ``<output>/frames``: labelled frames in trajectory order, by block of trajectories,
* ``<output>/report``: by lag, for each ordered pair of states the weighted count, the transition probability, its error by
  leaving out one block of trajectories at a time, and what the shortest lag's matrix predicts for this lag.

A rerun replaces both tables as a whole and gives the same result.

    python -m jobs.msm_report --input events.parquet --output out [--config msm_report.json]
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobs.common import log, main, new_folder, replace_table, shipped_config
from lagwell.functions import kinetics as K
from lagwell.operators.counting import count_matrix
from lagwell.operators.frames import clean_weight, number_rows
from lagwell.operators.lag import halo_pairs

#: States at most; a matrix of them is solved on the driver.
MOST_STATES = 500


def observed_frames(rows: DataFrame, config: dict) -> DataFrame:
    """``(row_id, traj_id, state, weight, block)`` in trajectory order.

    Labels that are no state, and missing ones, are -1; missing, NaN or
    negative weights and those of weightless labels are 0. Rows without a
    trajectory stay, in block 0, and pair with nothing.
    """
    label = F.col(config["label"]).cast("string")
    state = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in config["states"])), label).cast("int") - 1, F.lit(-1))
    weight = clean_weight(F.col(config["weight"])) if config.get("weight") else F.lit(1.0)
    none = F.coalesce(label.isin(config.get("weightless", [])), F.lit(False))
    order = [F.col(c).alias(f"_order{k}") for k, c in enumerate(config["order"])]
    light = rows.select(F.col(config["traj"]).alias("traj_id"), *order, state.alias("state"), F.when(none, 0.0).otherwise(weight).alias("weight"))
    numbered = number_rows(light, ["traj_id", *(f"_order{k}" for k in range(len(order)))])
    return numbered.select("row_id", "traj_id", "state", "weight", _block(numbered, config["blocks"]).alias("block"))


def _block(df: DataFrame, blocks: int) -> Column:
    """Whole numbers go by their remainder, other ids by their hash."""
    whole = isinstance(df.schema["traj_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.coalesce(F.pmod(F.col("traj_id") if whole else F.xxhash64("traj_id"), F.lit(blocks)).cast("int"), F.lit(0))


def transition_report(frames: DataFrame, config: dict) -> DataFrame:
    """``(lag, i, j, n_pairs, count, p, p_std, p_ck)`` of every lag and ordered pair of states.

    ``p`` is NULL where state i is never left with weight, ``p_std`` where
    leaving out some block leaves no count, ``p_ck`` where the lag is no
    multiple of the shortest or its matrix has an empty row.
    """
    spark, n, lags, blocks = frames.sparkSession, len(config["states"]), sorted(config["lags"]), config["blocks"]
    if n > MOST_STATES:
        raise ValueError(f"more than {MOST_STATES} states")
    counts = count_matrix(halo_pairs(frames, lags, ["state"]), by=("lag", "block"))
    # the only aggregate over pairs; what follows has lags x blocks x states^2 rows at most
    each = lambda name, values: F.explode(F.array(*(F.lit(v) for v in values))).alias(name)
    grid = spark.range(1).select(each("lag", lags)).select("lag", each("i", range(n))).select("lag", "i", each("j", range(n)))
    rest = grid.select("*", each("block", range(blocks))).join(counts, ["lag", "block", "i", "j"], "left").fillna(0, ["count", "n_pairs"])
    total = rest.groupBy("lag", "i", "j").agg(F.sum("count").alias("count"), F.sum("n_pairs").alias("n_pairs"))
    mass = total.groupBy("lag", "i").agg(F.sum("count").alias("mass"))
    left = rest.groupBy("lag", "block", "i").agg(F.sum("count").alias("gone_mass"))
    without = rest.withColumnRenamed("count", "gone").drop("n_pairs").join(left, ["lag", "block", "i"]).join(total.drop("n_pairs"), ["lag", "i", "j"]).join(mass, ["lag", "i"])
    apart = without.withColumn("p_b", F.when(F.col("mass") - F.col("gone_mass") > 1e-9 * F.col("mass"), (F.col("count") - F.col("gone")) / (F.col("mass") - F.col("gone_mass"))))
    spread = apart.groupBy("lag", "i", "j").agg((F.var_pop("p_b") * (blocks - 1)).alias("v"), F.count("p_b").alias("n_b"))
    errors = spread.select("lag", "i", "j", F.when(F.col("n_b") == blocks, F.sqrt("v")).alias("p_std"))
    p = total.join(mass, ["lag", "i"]).withColumn("p", F.when(F.col("mass") > 0, F.col("count") / F.col("mass"))).drop("mass")
    base = K.dense([r for r in p.where(F.col("lag") == lags[0]).collect() if r["p"] is not None], n, "p")
    sound = bool(np.all(base.sum(1) > 0))
    powers = [(lag, i, j, float(m[i, j])) for lag in lags if sound and lag % lags[0] == 0 for m in [np.linalg.matrix_power(base, lag // lags[0])] for i in range(n) for j in range(n)]
    predicted = spark.createDataFrame(powers, "lag int, i int, j int, p_ck double")
    return p.join(errors, ["lag", "i", "j"]).join(predicted, ["lag", "i", "j"], "left").select("lag", "i", "j", "n_pairs", "count", "p", "p_std", "p_ck")


def run(spark: SparkSession, input_path: str, output_path: str, config: dict) -> dict:
    """Do the job; returns how many rows were written where."""
    rows = spark.read.parquet(input_path)
    log.info("read %s: %d rows", input_path, rows.count())
    out = output_path.rstrip("/")
    frames, n_frames = replace_table(observed_frames(rows, config), f"{out}/frames", "block")
    _, n_report = replace_table(transition_report(frames, config).coalesce(1), f"{out}/report", "lag")
    return {"frames": n_frames, "report": n_report}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over the whole of ``events``, after two runs into one folder."""
    out, config = new_folder(spark, "msm_report"), shipped_config(__file__)
    for _ in range(2):
        run(spark, f"{sf_dir}/events.parquet", out, config)
    found = spark.read.parquet(f"{out}/report")
    return found.select("lag", "i", "j", "n_pairs", F.round("count", 2).alias("count"), *(F.round(c, 6).alias(c) for c in ("p", "p_std", "p_ck")))


SQL = """
with f as (select user_id traj, row_number() over (partition by user_id order by ts, event_id) pos, case when event_type = 'error' then 0 else greatest(coalesce(value, 0), 0) end weight,
  case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 else -1 end state from events),
lags as (select unnest([1, 2, 4, 8]) lag), st as (select unnest([0, 1, 2]) s), bl as (select unnest(range(10)) block),
c as (select lag, a.traj % 10 block, a.state i, b.state j, sum(a.weight) c, count(*) n from f a cross join lags join f b on b.traj = a.traj and b.pos = a.pos + lag
  where a.state >= 0 and b.state >= 0 and a.weight > 0 group by all),
g as (select l.lag, a.s i, b.s j, bl.block, coalesce(c.c, 0) c, coalesce(c.n, 0) n from lags l cross join st a cross join st b cross join bl left join c on c.lag = l.lag and c.i = a.s and c.j = b.s and c.block = bl.block),
r as (select *, sum(c) over (partition by lag, i, j) tot, sum(n) over (partition by lag, i, j) n_tot, sum(c) over (partition by lag, i) mass, sum(c) over (partition by lag, block, i) gone from g),
t as (select lag, i, j, any_value(n_tot) n_pairs, any_value(tot) cnt, any_value(tot / mass) p, sqrt(9 * var_pop((tot - c) / (mass - gone))) p_std from r group by all),
p1 as (select i, j, p from t where lag = 1), p2 as (select a.i, b.j, sum(a.p * b.p) p from p1 a join p1 b on a.j = b.i group by all),
p4 as (select a.i, b.j, sum(a.p * b.p) p from p2 a join p2 b on a.j = b.i group by all), p8 as (select a.i, b.j, sum(a.p * b.p) p from p4 a join p4 b on a.j = b.i group by all),
ck as (select 1 lag, * from p1 union all select 2, * from p2 union all select 4, * from p4 union all select 8, * from p8)
select cast(lag as int) lag, cast(i as int) i, cast(j as int) j, cast(n_pairs as bigint) n_pairs, round(cnt, 2) as count, round(t.p, 6) p, round(p_std, 6) p_std, round(ck.p, 6) p_ck from t join ck using (lag, i, j)
"""

if __name__ == "__main__":
    main(run, __file__, "Markov state model of a table of observations", ("input", "output"))
