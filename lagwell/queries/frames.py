"""Frames: identity, weights, featurisation, labels, windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwell.functions.arrays import argmax, entropy_norm, gini_confidence, own, top_two
from lagwell.operators import frames as P
from lagwell.operators.lag import pair_labels
from lagwell.queries.registry import query, rounded
from lagwell.queries.views import EMB, EV, LI, SC, frames_emb, frames_ev, frames_li
from lagwell.sources.readers import array_columns, external_features


@query("s04_array_columns", "select vec_id, round(cast(embedding[1] as double), 6) a, round(cast(embedding[2] as double), 6) b from (select vec_id, embedding[1:2] embedding from embeddings)")
def s04(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 2).alias("v"))
    return rounded(array_columns(e, "v", ["a", "b"]).drop("v"), ["a", "b"])


@query("s05_external_features", f"with {EMB} select emb.row_id, state, round(cast(e.embedding[4] as double), 6) f from emb join embeddings e on e.vec_id = emb.row_id")
def s05(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda v: v.cast("double")).alias("feat"))
    joined = external_features(frames_emb(spark, d).select("row_id", "state"), e, "feat")
    return joined.select("row_id", "state", F.round(F.col("feat")[3], 6).alias("f"))


@query("s07_strided_samples", f"with {EMB} select row_id, traj_id, frame from emb where row_id % 7 = 0")
@query("p03_global_stride", f"with {EMB} select row_id, traj_id, frame from emb where row_id % 7 = 0")
def p03(spark: SparkSession, d: str) -> DataFrame:
    return P.global_stride(frames_emb(spark, d), 7).select("row_id", "traj_id", "frame")


@query("p01_trajectory_metadata", "select event_id, user_id traj_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) frame_in_traj, 'events' source_file from events")
def p01(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts")
    return P.trajectory_metadata(e, "user_id", ["ts", "event_id"], "events").select("event_id", "traj_id", "frame_in_traj", "source_file")


@query("p02_frame_table", f"with {EV}, k as (select *, row_number() over (partition by traj_id order by frame) - 1 r from ev where frame >= 3) select row_id, traj_id, frame, round(greatest(coalesce(weight, 0), 0), 6) weight from k where r % 2 = 0")
def p02(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.frame_table(frames_ev(spark, d), discard_before=3, stride=2).select("row_id", "traj_id", "frame", "weight"), ["weight"])


@query("p04_burn_in", f"with {EV}, r as (select *, frame - row_number() over (partition by traj_id, state order by frame) g from ev) select row_id, traj_id, state, row_number() over (partition by traj_id, state, g order by frame) > 1 keep from r")
def p04(spark: SparkSession, d: str) -> DataFrame:
    # the runs of one state stand for the runs of one trajectory in a file
    f = frames_ev(spark, d).withColumnsRenamed({"traj_id": "file", "state": "traj_id"})
    return P.burn_in(f, 1, ["file"], order="frame").select("row_id", F.col("file").alias("traj_id"), F.col("traj_id").alias("state"), "keep")


@query("p05_dimensions", "select vec_id, round(cast(embedding[1] as double) + cast(embedding[3] as double), 6) s from embeddings")
def p05(spark: SparkSession, d: str) -> DataFrame:
    chosen = F.transform(F.array(F.lit(0), F.lit(2)), lambda i: F.get("embedding", i).cast("double"))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", chosen.alias("v")).select("vec_id", F.round(F.col("v")[0] + F.col("v")[1], 6).alias("s"))


@query("p06_periodic_features", f"with {LI} select row_id, round(sin(radians(cv1 * 7)), 6) sinphi, round(cos(radians(cv1 * 7)), 6) cosphi, cv2 from li")
def p06(spark: SparkSession, d: str) -> DataFrame:
    f = frames_li(spark, d).withColumn("phi", F.col("cv1") * 7)
    return rounded(f.select("row_id", *P.periodic_features(["phi", "cv2"], ["phi"])), ["sinphi", "cosphi"])


@query("p08_angle", f"with {LI} select row_id, round(case when phi <= -180 * (1 - 1e-9) then phi + 360 else phi end, 6) phi from (select row_id, degrees(atan2(sin(radians(cv1 * 7)), cos(radians(cv1 * 7)))) phi from li)")
def p08(spark: SparkSession, d: str) -> DataFrame:
    f = frames_li(spark, d).withColumn("phi", F.col("cv1") * 7)
    s, c = P.periodic_features(["phi"], ["phi"])
    return f.select("row_id", F.round(P.angle_of(s, c), 6).alias("phi"))


@query("p09_minimum_image", f"with {LI} select row_id, round((cv1 * 11 - 100 + 180) - 360 * floor((cv1 * 11 - 100 + 180) / 360) - 180, 6) delta, round((cv1 * 11 - 90) - 90 * floor((cv1 * 11 - 90) / 90) + 0, 6) wrapped from li")
def p09(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("cv1") * 11
    return frames_li(spark, d).select("row_id", F.round(P.minimum_image(x - 100, 360.0), 6).alias("delta"), F.round(P.wrap(x - 90, 0.0, 90.0), 6).alias("wrapped"))


@query("p10_circle", f"with {LI} select row_id, round(sin(cv1 * 2 * pi() / 90) * 90 / (2 * pi()), 6) s, round(cos(cv1 * 2 * pi() / 90) * 90 / (2 * pi()), 6) c, round(case when back <= -45 * (1 - 1e-9) then back + 90 else back end, 5) back from (select row_id, cv1, atan2(sin(cv1 * 2 * pi() / 90), cos(cv1 * 2 * pi() / 90)) * 90 / (2 * pi()) back from li)")
def p10(spark: SparkSession, d: str) -> DataFrame:
    s, c = P.scaled_circle(F.col("cv1"), 90.0)
    return frames_li(spark, d).select("row_id", F.round(s, 6).alias("s"), F.round(c, 6).alias("c"), F.round(P.from_circle(s, c, 90.0), 5).alias("back"))


def _scaled(method: str):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(P.standardised(frames_li(spark, d).select("row_id", "cv1", "cv3"), ["cv1", "cv3"], method), ["cv1", "cv3"], 5)

    return run


for _m, _c, _s in (("standard", "avg({0})", "stddev_pop({0})"), ("robust", "quantile_cont({0}, 0.5)", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"), ("range", "min({0})", "max({0}) - min({0})")):
    _p = ", ".join(f"{_c.format(x)} c_{x}, case when abs({_s.format(x)}) < 1e-12 then 1 else {_s.format(x)} end s_{x}" for x in ("cv1", "cv3"))
    query(f"p12_{_m}", f"with {LI}, p as (select {_p} from li) select row_id, round((cv1 - c_cv1) / s_cv1, 5) cv1, round((cv3 - c_cv3) / s_cv3, 5) cv3 from li, p")(_scaled(_m))

_BASINS = [(0, (10.0, 0.02), (8.0, 0.03)), (1, (40.0, 0.08), (8.0, 0.03)), (2, (25.0, 0.05), (5.0, 0.02))]


@query(
    "p13_box_basins",
    f"""with {LI}, d as (select row_id, greatest(abs(cv1 - 10) / 8, abs(cv2 - 0.02) / 0.03) a, greatest(abs(cv1 - 40) / 8, abs(cv2 - 0.08) / 0.03) b, greatest(abs(cv1 - 25) / 5, abs(cv2 - 0.05) / 0.02) c from li),
  e as (select *, case when a <= 1 then a else 1e9 end a1, case when b <= 1 then b else 1e9 end b1, case when c <= 1 then c else 1e9 end c1 from d)
select row_id, case when least(a1, b1, c1) > 1 then -1 when a1 <= b1 and a1 <= c1 then 0 when b1 <= c1 then 1 else 2 end state, round(least(a, b, c), 6) dist from e""",
)
def p13(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.basin_labels(frames_li(spark, d).select("row_id", "cv1", "cv2"), ["cv1", "cv2"], _BASINS).select("row_id", "state", "dist"), ["dist"])


@query(
    "p14_distance_basins",
    f"""with {EMB}, d as (select row_id, sqrt((x0 - 0.1) * (x0 - 0.1) + x1 * x1) a, sqrt((x0 + 0.1) * (x0 + 0.1) + (x1 - 0.1) * (x1 - 0.1)) b from emb)
select row_id, case when a > 0.15 and b > 0.12 then -1 when a <= 0.15 and (b > 0.12 or a <= b) then 0 else 1 end state, round(least(a, b), 6) dist from d""",
)
def p14(spark: SparkSession, d: str) -> DataFrame:
    labelled = P.basin_labels(frames_emb(spark, d), ["x0", "x1"], [(0, (0.1, 0.0), 0.15), (1, (-0.1, 0.1), 0.12)], "distance")
    return rounded(labelled.select("row_id", "state", "dist"), ["dist"])


@query("p15_pair_labels", f"with {EMB} select row_id, case state when 0 then 0 when 1 then 1 else -1 end l01, case state when 0 then 0 when 2 then 1 else -1 end l02, case state when 1 then 0 when 2 then 1 else -1 end l12 from emb")
def p15(spark: SparkSession, d: str) -> DataFrame:
    return pair_labels(frames_emb(spark, d), 3).select("row_id", *(F.col("pair_labels")[k].alias(n) for k, n in enumerate(("l01", "l02", "l12"))))


@query("p16_entropy", f"with {SC} select row_id, round(q_max, 6) q_max, q_argmax, round(entropy, 6) entropy, round(1 - entropy, 6) confidence from sc")
def p16(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    return rounded(frames_emb(spark, d).select("row_id", F.array_max(q).alias("q_max"), argmax(q).alias("q_argmax"), entropy_norm(q).alias("entropy"), (1 - entropy_norm(q)).alias("confidence")), ["q_max", "entropy", "confidence"])


@query("p17_gini", f"with {SC} select row_id, round(gini, 6) gini from sc")
def p17(spark: SparkSession, d: str) -> DataFrame:
    return frames_emb(spark, d).select("row_id", F.round(gini_confidence(F.col("q")), 6).alias("gini"))


@query("p18_consistency", f"with {SC} select row_id, state, round(q_own, 6) q_own from sc")
def p18(spark: SparkSession, d: str) -> DataFrame:
    return frames_emb(spark, d).select("row_id", "state", F.round(own(F.col("q"), F.col("state")), 6).alias("q_own"))


@query("p19_top_two", f"with {SC} select row_id, round(q_max, 6) \"first\", round(top2, 6) \"second\" from sc")
def p19_top(spark: SparkSession, d: str) -> DataFrame:
    a, b = top_two(F.col("q"))
    return frames_emb(spark, d).select("row_id", F.round(a, 6).alias("first"), F.round(b, 6).alias("second"))


@query("p24_state_count", f"with {EMB} select max(state) + 1 n_states from emb")
def p24(spark: SparkSession, d: str) -> DataFrame:
    return frames_emb(spark, d).agg((F.max("state") + 1).alias("n_states"))


@query("p25_normalised_weights", f"with {EMB}, s as (select traj_id, sum(weight) s, count(*) n from emb group by 1) select row_id, round(case when s > 0 then weight / s else 1.0 / n end, 8) weight from emb join s using (traj_id)")
def p25(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.normalised_weights(frames_emb(spark, d), within=["traj_id"]).select("row_id", "weight"), ["weight"], 8)


@query("p26_quantised_key", f"with {LI} select row_id, cast(round_even(cv1 / 4, 0) as bigint) a, cast(round_even(cv3 / 0.015625, 0) as bigint) b from li")
def p26(spark: SparkSession, d: str) -> DataFrame:
    f = frames_li(spark, d)
    return f.select("row_id", P.quantised_key(["cv1"], 4.0)[0].alias("a"), P.quantised_key(["cv3"], 0.015625)[0].alias("b"))


@query("p27_compact_labels", f"with {LI}, s as (select row_id, case when state in (0, 3) then -1 else state end state from li), c as (select state, cast(row_number() over (order by state) - 1 as int) code from (select distinct state from s where state >= 0)) select row_id, coalesce(code, -1) state from s left join c using (state)")
def p27(spark: SparkSession, d: str) -> DataFrame:
    f = frames_li(spark, d).select("row_id", F.when(F.col("state").isin(0, 3), -1).otherwise(F.col("state")).alias("state"))
    return P.compact_labels(f).select("row_id", "state")


@query("p28_validation", f"with {EMB} select count(*)::bigint n_rows, round(max(abs(q0 + q1 + q2 - 1)), 8) max_row_error, round(min(least(q0, q1, q2)), 8) min_q, 0::bigint n_bad from emb")
def p28(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.probability_check(frames_emb(spark, d)), ["max_row_error", "min_q"], 8)


@query("p30_frame_index", f"with {EV} select row_id, cast(row_number() over (partition by traj_id order by row_id) - 1 as int) index from ev")
def p30(spark: SparkSession, d: str) -> DataFrame:
    return P.frame_index(frames_ev(spark, d)).select("row_id", "index")


@query("w01_reset_blocks", f"with {EV}, f as (select *, case when cv1 < lag(cv1) over (partition by traj_id order by frame) then 1 else 0 end fell from ev) select row_id, cast(sum(fell) over (partition by traj_id order by frame) as int) block from f")
def w01(spark: SparkSession, d: str) -> DataFrame:
    return P.reset_blocks(frames_ev(spark, d), "cv1", "frame", ["traj_id"]).select("row_id", "block")


@query("w02_fixed_blocks", f"with {EV} select row_id, cast(floor(frame / 16) as int) block from ev")
def w02(spark: SparkSession, d: str) -> DataFrame:
    return P.fixed_blocks(frames_ev(spark, d), 16).select("row_id", "block")


@query("w03_block_names", f"with {EV} select row_id, 'run:' || lpad(cast(cast(floor(frame / 16) as int) as varchar), 6, '0') block_id from ev")
def w03(spark: SparkSession, d: str) -> DataFrame:
    return P.block_names(P.fixed_blocks(frames_ev(spark, d), 16), "run").select("row_id", "block_id")


@query("p21_positive_frames", f"with {EV} select traj_id, count(*)::bigint n_frames, sum(case when weight > 0 then 1 else 0 end)::bigint n_positive from ev group by 1")
def p21(spark: SparkSession, d: str) -> DataFrame:
    return frames_ev(spark, d).groupBy("traj_id").agg(F.count("*").alias("n_frames"), F.sum(F.when(F.col("weight") > 0, 1).otherwise(0)).alias("n_positive"))


@query(
    "p23_ordered_pairs",
    f"with {LI}, ob as (select distinct a.state i, b.state j from li a join li b on b.traj_id = a.traj_id and b.frame = a.frame + 1 where a.state != b.state), bo as (select i, j from ob union select j, i from ob) select i::int i, j::int j, round(0.1e0 + 0.1e0 * c, 6) c from bo, (select unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) c)",
)
def p23(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of states that follow one another in the frames, both ways, with every threshold."""
    from lagwell.operators.flux import ordered_pairs, thresholds
    from lagwell.operators.lag import sequence_pairs

    seen = sequence_pairs(frames_li(spark, d), [1], ["state"]).where("state != state_tau").select("state", "state_tau").distinct().orderBy("state", "state_tau").collect()
    chosen = ordered_pairs(6, [(r[0], r[1]) for r in seen])
    return rounded(spark.createDataFrame([(i, j, c) for i, j in chosen for c in thresholds()], "i int, j int, c double"), ["c"])


@query("p20_reactive_weights", f"with {EMB} select row_id, 0 i, 1 j, round(q0 * q1, 8) r from emb union all select row_id, 0, 2, round(q0 * q2, 8) from emb union all select row_id, 1, 2, round(q1 * q2, 8) from emb")
def p20(spark: SparkSession, d: str) -> DataFrame:
    from lagwell.operators.model import reactive_weights

    return rounded(reactive_weights(frames_emb(spark, d), 3), ["r"], 8)


@query("o05_split", None)
def o05(spark: SparkSession, d: str) -> DataFrame:
    """Validation rows by hash order, a fifth of all, at least one on each side."""
    f = frames_emb(spark, d).select("row_id")
    n = f.count()
    k = min(max(1, math.ceil(0.2 * n)), n - 1)
    chosen = f.withColumn("h", F.xxhash64("row_id", F.lit(0))).orderBy("h", "row_id").limit(k).select("row_id", F.lit(True).alias("v"))
    return f.join(chosen, "row_id", "left").select("row_id", F.coalesce("v", F.lit(False)).alias("validation"))


@query("a24_segment_weights", f"with {EV}, s as (select row_id, traj_id, frame, floor(frame / 3) seg, cv1 from ev), g as (select traj_id, seg, min(frame) a, min(frame) + 5 b, avg(cv1) w from s group by 1, 2) select s.row_id, round(sum(g.w) / count(*), 6) weight from s join g on g.traj_id = s.traj_id and s.frame between g.a and g.b group by 1")
def a24(spark: SparkSession, d: str) -> DataFrame:
    """Frame weight: covered segment weight over coverage, from events at segment starts and ends and a running sum."""
    f = frames_ev(spark, d)
    seg = f.groupBy("traj_id", F.floor(F.col("frame") / 3).alias("seg")).agg(F.min("frame").alias("a"), (F.min("frame") + 5).alias("b"), F.avg("cv1").alias("w"))
    marks = seg.select("traj_id", F.inline(F.array(F.struct(F.col("a").alias("frame"), F.col("w").alias("dw"), F.lit(1).alias("dn")), F.struct((F.col("b") + 1).alias("frame"), (-F.col("w")).alias("dw"), F.lit(-1).alias("dn")))))
    steps = marks.groupBy("traj_id", "frame").agg(F.sum("dw").alias("dw"), F.sum("dn").alias("dn"))
    every = f.select("traj_id", "frame", "row_id").join(steps, ["traj_id", "frame"], "left")
    run = W.partitionBy("traj_id").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    return every.select("row_id", F.round(F.sum(F.coalesce("dw", F.lit(0.0))).over(run) / F.sum(F.coalesce("dn", F.lit(0))).over(run), 6).alias("weight"))
