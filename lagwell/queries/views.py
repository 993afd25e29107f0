"""Trajectory views of the shared tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def frames_ev(spark: SparkSession, d: str) -> DataFrame:
    """One trajectory per user, one frame per event; errors weigh nothing."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    frame = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    state = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 2).otherwise(-1)
    return e.select(F.col("event_id").alias("row_id"), F.col("user_id").alias("traj_id"), frame.alias("frame"), F.col("value").alias("cv1"), F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("weight"), state.alias("state"))


EV = """ev as (select event_id row_id, user_id traj_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) frame, value cv1,
  case when event_type = 'error' then 0.0e0 else value end weight, case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 else -1 end state from events)"""


def frames_emb(spark: SparkSession, d: str) -> DataFrame:
    """Fifty vectors to a trajectory; q is a closed-form committor of three states, x the first three numbers."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = [F.col("embedding")[k].cast("double") for k in range(3)]
    a = [F.exp(8 * x) for x in v]
    s = a[0] + a[1] + a[2]
    weight = F.when(F.col("vec_id") % 11 == 0, 0.0).otherwise((1 + F.col("vec_id") % 3).cast("double"))
    base = e.select(F.col("vec_id").alias("row_id"), F.floor(F.col("vec_id") / 50).cast("long").alias("traj_id"), (F.col("vec_id") % 50).cast("int").alias("frame"), F.when(F.col("label") < 3, F.col("label")).otherwise(-1).alias("state"), weight.alias("weight"), F.array(*v).alias("x"), *(x.alias(f"x{k}") for k, x in enumerate(v)), *((y / s).alias(f"q{k}") for k, y in enumerate(a)))
    return base.withColumn("q", F.array("q0", "q1", "q2"))


EMB = """emb0 as (select vec_id, label, cast(embedding[1] as double) x0, cast(embedding[2] as double) x1, cast(embedding[3] as double) x2 from embeddings),
emb as (select vec_id row_id, cast(floor(vec_id / 50) as bigint) traj_id, cast(vec_id % 50 as int) frame, case when label < 3 then label else -1 end state,
  case when vec_id % 11 = 0 then 0.0e0 else cast(1 + vec_id % 3 as double) end weight, x0, x1, x2,
  exp(8 * x0) / (exp(8 * x0) + exp(8 * x1) + exp(8 * x2)) q0, exp(8 * x1) / (exp(8 * x0) + exp(8 * x1) + exp(8 * x2)) q1, exp(8 * x2) / (exp(8 * x0) + exp(8 * x1) + exp(8 * x2)) q2 from emb0)"""


def frames_li(spark: SparkSession, d: str) -> DataFrame:
    """One trajectory per supplier, frames by ship date."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag", "l_linestatus")
    r = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")) - 1
    state = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(4) + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    ranked = li.withColumn("frame", r.cast("int"))
    return ranked.select((F.col("l_suppkey") * 1000000 + F.col("frame")).alias("row_id"), F.col("l_suppkey").alias("traj_id"), "frame", F.col("l_quantity").alias("cv1"), F.col("l_discount").alias("cv2"), F.col("l_tax").alias("cv3"), F.col("l_extendedprice").alias("weight"), state.alias("state"))


LI = """li as materialized (select l_suppkey * 1000000 + row_number() over w - 1 row_id, l_suppkey traj_id, cast(row_number() over w - 1 as int) frame, l_quantity cv1, l_discount cv2, l_tax cv3,
  l_extendedprice weight, case l_returnflag when 'A' then 0 when 'N' then 2 else 4 end + case l_linestatus when 'O' then 1 else 0 end state
  from lineitem window w as (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey))"""

#: Scores of the committor view.
SC = (
    EMB
    + """, sc as (select *, greatest(q0, q1, q2) q_max, case when q0 >= q1 and q0 >= q2 then 0 when q1 >= q2 then 1 else 2 end q_argmax,
  -(greatest(q0, 1e-12) * ln(greatest(q0, 1e-12)) + greatest(q1, 1e-12) * ln(greatest(q1, 1e-12)) + greatest(q2, 1e-12) * ln(greatest(q2, 1e-12))) / ln(3.0) entropy,
  (1 - (q0 * q0 + q1 * q1 + q2 * q2) / ((q0 + q1 + q2) * (q0 + q1 + q2))) / (1 - 1.0 / 3) gini, case state when 0 then q0 when 1 then q1 when 2 then q2 end q_own,
  q0 + q1 + q2 - greatest(q0, q1, q2) - least(q0, q1, q2) top2 from emb)"""
)
