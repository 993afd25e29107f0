"""Diagnostics, fields, clusters, cores, relabelling, paths and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwell.functions.committor import Loss, Net
from lagwell.operators import candidates as G
from lagwell.operators import cluster as C
from lagwell.operators import counting as N
from lagwell.operators import diagnose as D
from lagwell.operators import exchange as E
from lagwell.operators import expansion as X
from lagwell.operators import fields as B
from lagwell.operators import lag as L
from lagwell.operators import model as M
from lagwell.operators import paths as Q
from lagwell.operators import relabel as R
from lagwell.operators.cores import CoreSettings, label_cores
from lagwell.operators.frames import number_rows
from lagwell.operators.graph import connected_components
from lagwell.queries.registry import query, rounded
from lagwell.queries.views import EMB, EV, LI, SC, frames_emb, frames_ev, frames_li

_LAGS = [1, 2, 5]
_LSC = f"{SC}, lp as (select a.row_id, b.entropy h, b.q_max m from sc a cross join (select unnest([1, 2, 5]) lag) l join sc b on b.traj_id = a.traj_id and b.frame = a.frame + l.lag), lm as (select row_id, avg(h) lag_entropy, avg(m) lag_q_max, count(*) n_lags from lp group by 1), ls as (select sc.*, lag_entropy, lag_q_max, n_lags from sc left join lm using (row_id))"
_CLS = (
    _LSC
    + """, cl as (select *, case
  when coalesce(q_own < 0.5 and q_argmax != state and q_max >= 0.6, false) then 'mislabeled'
  when entropy >= 0.6 and top2 >= 0.2 and q_max - top2 <= 0.2 and entropy - coalesce(lag_entropy, entropy) >= 0.15 and coalesce(lag_q_max, q_max) >= 0.8 then 'transition'
  when entropy >= 0.6 and coalesce(lag_entropy, entropy) >= 0.6 and q_max < 0.6 and not (top2 >= 0.2 and q_max - top2 <= 0.2) then 'missed'
  when entropy >= 0.6 or coalesce(q_own < 0.5, false) then 'unresolved' else 'stable' end class from ls)"""
)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return D.scores(frames_emb(spark, d))


def _classed(spark: SparkSession, d: str) -> DataFrame:
    return D.lagged_scores(_scored(spark, d), _LAGS).withColumn("class", D.uncertainty_class())


@query("a28_lagged_entropy", f"with {_LSC} select row_id, round(lag_entropy, 6) lag_entropy, round(lag_q_max, 6) lag_q_max, n_lags::bigint n_lags from ls")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.lagged_scores(_scored(spark, d), _LAGS).select("row_id", "lag_entropy", "lag_q_max", "n_lags"), ["lag_entropy", "lag_q_max"])


@query("p19_uncertainty_class", f"with {_CLS} select row_id, class from cl")
def p19(spark: SparkSession, d: str) -> DataFrame:
    return _classed(spark, d).select("row_id", "class")


_KINDS = ("mislabeled", "missed", "stable", "transition", "unresolved")
_SHARES = ", ".join(f"avg(case when class = '{k}' then 1.0 else 0.0 end) share_{k}" for k in _KINDS)


@query(
    "a19_state_statistics",
    f"with {_CLS}, s as (select state, count(*)::bigint n_frames, avg(q_own) mean_q_own, quantile_cont(q_own, 0.5) median_q_own, avg(case when q_own < 0.5 then 1.0 else 0.0 end) low_share, avg(entropy) mean_entropy, quantile_cont(entropy, 0.5) median_entropy, avg(lag_entropy) mean_lag_entropy, {_SHARES} from cl where state >= 0 group by 1) "
    "select state, n_frames, round(mean_q_own, 6) mean_q_own, round(median_q_own, 6) median_q_own, round(low_share, 6) low_share, round(mean_entropy, 6) mean_entropy, round(median_entropy, 6) median_entropy, round(mean_lag_entropy, 6) mean_lag_entropy, "
    + ", ".join(f"round(share_{k}, 6) share_{k}" for k in _KINDS)
    + ", case "
    + " ".join(f"when share_{k} = greatest({', '.join('share_' + x for x in _KINDS)}) then '{k}'" for k in _KINDS)
    + " end primary_class from s",
)
def a19(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.state_statistics(_classed(spark, d)), ["mean_q_own", "median_q_own", "low_share", "mean_entropy", "median_entropy", "mean_lag_entropy", *(f"share_{k}" for k in _KINDS)])


@query(
    "a20_relabel_hints",
    f"""with {_CLS}, w as (select state, q_argmax, count(*) n from cl where state >= 0 and q_own < 0.5 and q_argmax != state group by 1, 2),
t as (select state, q_argmax, n, row_number() over (partition by state order by n desc, q_argmax) r from w),
s as (select state, count(*)::bigint n_frames, avg(case when q_own < 0.5 then 1.0 else 0.0 end) low_share, avg(entropy) mean_entropy from cl where state >= 0 group by 1)
select s.state, n_frames, round(low_share, 6) low_share, round(mean_entropy, 6) mean_entropy, t.q_argmax alternative, coalesce(t.n, 0)::bigint n_alternative,
  case when low_share >= 0.5 and coalesce(t.n, 0) >= 0.5 * low_share * n_frames then 'merge' when low_share >= 0.5 then 'split' when mean_entropy >= 0.6 then 'shrink' else 'keep' end hint
from s left join t on t.state = s.state and t.r = 1""",
)
def a20(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.relabel_hints(_classed(spark, d)), ["low_share", "mean_entropy"])


@query("a21_boundary_summary", f"with {SC} select state, count(*)::bigint n_frames, round(avg(case when q_argmax = state then 1.0 else 0.0 end), 6) accuracy, round(avg(q_own), 6) mean_q_own, round(avg(entropy), 6) mean_entropy from sc where state >= 0 group by 1")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.boundary_summary(_scored(spark, d)), ["accuracy", "mean_q_own", "mean_entropy"])


@query(
    "a22_label_kinetics",
    f"""with {EMB}, m as (select state, sum(weight * q0) / sum(weight) m0, sum(weight * q1) / sum(weight) m1, sum(weight * q2) / sum(weight) m2 from emb where state >= 0 and weight > 0 group by 1),
p as (select a.state, l.lag, a.weight w, b.state s2, (a.q0 - m0) * (b.q0 - m0) + (a.q1 - m1) * (b.q1 - m1) + (a.q2 - m2) * (b.q2 - m2) ab, (a.q0 - m0) ** 2 + (a.q1 - m1) ** 2 + (a.q2 - m2) ** 2 aa
  from emb a join m on m.state = a.state cross join (select unnest([1, 2, 5]) lag) l join emb b on b.traj_id = a.traj_id and b.frame = a.frame + l.lag where a.state >= 0 and a.weight > 0)
select state, lag, count(*)::bigint n_pairs, round(sum(case when s2 = state then w else 0 end) / sum(w), 6) retention, round(sum(w * ab) / sum(w * aa), 6) autocorrelation from p group by 1, 2""",
)
def a22(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.label_kinetics(frames_emb(spark, d), _LAGS), ["retention", "autocorrelation"])


@query(
    "a23_component_exchange",
    f"""with {EV}, e as (select *, frame % 3 comp from ev), p as (select a.state, l.lag, a.comp i, b.comp j, sum(a.weight) w from e a cross join (select unnest([1, 2]) lag) l join e b on b.traj_id = a.traj_id and b.frame = a.frame + l.lag
  where a.state >= 0 and a.state = b.state and a.weight > 0 group by 1, 2, 3, 4), q as (select *, w / sum(w) over (partition by state, lag, i) p from p) select state, lag, round(coalesce(max(case when i != j then p end), 0), 6) max_exchange from q group by 1, 2""",
)
def a23(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.component_exchange(frames_ev(spark, d).withColumn("component", F.col("frame") % 3), [1, 2]), ["max_exchange"])


@query("a27_label_populations", f"with {LI} select state, count(*)::bigint n_frames from li group by 1")
def a27(spark: SparkSession, d: str) -> DataFrame:
    return N.populations(frames_li(spark, d))


@query(
    "a28_entropy_candidates",
    f"""with {SC}, c as (select * from sc where entropy >= 0.6), h as (select c.row_id, count(*) n, sum(case when b.entropy >= 0.6 then 1 else 0 end) hi, sum(case when b.entropy <= 0.3 then 1 else 0 end) lo from c cross join (select unnest([1, 2, 5]) lag) l
  join sc b on b.traj_id = c.traj_id and b.frame = c.frame + l.lag group by 1), x as (select c.*, coalesce(n, 0) n, coalesce(hi, 0) hi, coalesce(lo, 0) lo from c left join h using (row_id))
select row_id, n::bigint n_valid, hi::bigint n_high, lo::bigint n_low, case when n = 0 then 'review' when hi >= 0.5 * n then 'missing' when lo >= 0.5 * n then 'transition' else 'unresolved' end kind,
  round(entropy * case when n > 0 then hi / n else 0 end * (1 - q_max) * weight, 6) score from x""",
)
def a28c(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.entropy_candidates(_scored(spark, d), _LAGS).select("row_id", "n_valid", "n_high", "n_low", "kind", "score"), ["score"])


_CONS = f"{SC}, s as (select state, count(*)::bigint n_frames, avg(case when q_own < 0.5 or entropy >= 0.6 then 1.0 else 0.0 end) problem_share, avg(case when q_own >= 0.5 and entropy < 0.6 then 1.0 else 0.0 end) stable_share from sc where state >= 0 group by 1)"


@query("a29_consistent_states", f"with {_CONS} select state, n_frames, round(problem_share, 6) problem_share, round(stable_share, 6) stable_share, problem_share < 0.9 and stable_share >= 0.5 kept from s")
def a29(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.consistent_states(_scored(spark, d)), ["problem_share", "stable_share"])


@query("a29_state_removal", f"with {_CONS} select row_id, case when problem_share < 0.9 and stable_share >= 0.5 or sc.state < 0 then sc.state else -1 end state from sc left join s using (state)")
def a29r(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    return D.remove_states(scored, D.consistent_states(scored)).select("row_id", "state")


@query("p29_core_predicate", f"with {SC} select row_id, coalesce(q_own >= 0.4 and q_argmax = state, false) core from sc")
def p29(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("row_id", D.core_predicate(0.4).alias("core"))


@query("r03_review_category", f"with {SC} select row_id, case when case when entropy >= 0.9 then -1 else state end != state then 8 when q_max < 0.5 then 3 when top2 >= 0.3 then 2 when entropy >= 0.6 then 1 else 0 end category from sc")
def r03(spark: SparkSession, d: str) -> DataFrame:
    f = _scored(spark, d).withColumn("new_state", F.when(F.col("entropy") >= 0.9, -1).otherwise(F.col("state")))
    flags = {"a": F.col("entropy") >= 0.6, "b": F.col("top2") >= 0.3, "c": F.col("q_max") < 0.5}
    return f.withColumns(flags).select("row_id", D.review_category(["a", "b", "c"]).alias("category"))


# ---- fields ------------------------------------------------------------------------------


def _bin(c: str, lo: float, hi: float, n: int) -> str:
    return f"case when {c} >= {lo} and {c} < {hi} then least(floor(({c} - {lo}) / (({hi} - {lo}) / {n})), {n - 1}) when {c} = {hi} then {n - 1} end::int"


_AX = [("x0", -0.3, 0.3, 6), ("x1", -0.3, 0.3, 6), ("x2", -0.3, 0.3, 4)]
_BINS = f"{EMB}, bn as (select *, {_bin(*_AX[0])} b0, {_bin(*_AX[1])} b1, {_bin(*_AX[2])} b2 from emb)"


@query("a13_weighted_mean_field", f"with {_BINS} select b0, b1, round(sum(weight), 6) mass, round(case when sum(weight) > 0 then sum(weight * q0) / sum(weight) end, 6) mean from bn where b0 is not null and b1 is not null group by 1, 2")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.weighted_mean_field(frames_emb(spark, d), _AX[:2], F.col("q0")), ["mass", "mean"])


@query("r05_marginal_fields", f"with {_BINS} select b0, b1, b2, round(sum(weight), 6) mass, round(case when sum(weight) > 0 then sum(weight * q0) / sum(weight) end, 6) mean from bn where b0 is not null and b1 is not null and b2 is not null group by grouping sets ((b0, b1, b2), (b0, b1), (b0, b2), (b1, b2))")
def r05(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.marginal_fields(frames_emb(spark, d), _AX, F.col("q0")), ["mass", "mean"])


_F2 = f"{_BINS}, f as (select b0, b1, sum(weight) mass, case when sum(weight) > 0 then sum(weight * q0) / sum(weight) end mean from bn where b0 is not null and b1 is not null group by 1, 2)"


@query("a14_collapsed_field", f"with {_F2} select b0, round(sum(mean * mass) / sum(mass), 6) mean, round(sum(mass), 6) mass from f where mass > 0 group by 1")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.collapse(B.weighted_mean_field(frames_emb(spark, d), _AX[:2], F.col("q0")).where("mass > 0"), "b1"), ["mean", "mass"])


@query("a14_averaged_field", f"with {_F2} select b0, round(avg(mean), 6) mean from f group by 1")
def a14p(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.plain_average(B.weighted_mean_field(frames_emb(spark, d), _AX[:2], F.col("q0")), "b1"), ["mean"])


_WIN = f"{_BINS}, f as (select b0, b1, sum(weight * q0) / sum(weight) m0, sum(weight * q1) / sum(weight) m1, sum(weight * q2) / sum(weight) m2 from bn where b0 is not null and b1 is not null group by 1, 2 having sum(weight) > 0)"


@query("a14_destination_field", f"with {_WIN} select b0, b1, case when m0 >= m1 and m0 >= m2 then 0 when m1 >= m2 then 1 else 2 end k, round(greatest(m0, m1, m2), 6) mean from f")
def a14d(spark: SparkSession, d: str) -> DataFrame:
    f = frames_emb(spark, d).select("x0", "x1", "weight", F.posexplode("q").alias("k", "v"))
    binned = f.select("k", B.bin_index(F.col("x0"), *_AX[0][1:]).alias("b0"), B.bin_index(F.col("x1"), *_AX[1][1:]).alias("b1"), "v", "weight").where("b0 is not null and b1 is not null")
    mean = binned.groupBy("b0", "b1", "k").agg(F.sum("weight").alias("mass"), (F.sum(F.col("v") * F.col("weight"))).alias("wv")).where("mass > 0").select("b0", "b1", "k", (F.col("wv") / F.col("mass")).alias("mean"))
    return rounded(B.winner(mean, "k"), ["mean"])


@query("r07_winning_channel", f"with {_BINS}, f as (select b0, b1, sum(weight * q0 * q1) / sum(weight) m0, sum(weight * q0 * q2) / sum(weight) m1, sum(weight * q1 * q2) / sum(weight) m2 from bn where b0 is not null and b1 is not null group by 1, 2 having sum(weight) > 0) select b0, b1, case when m0 >= m1 and m0 >= m2 then '0-1' when m1 >= m2 then '0-2' else '1-2' end pair, round(greatest(m0, m1, m2), 8) mean from f")
def r07(spark: SparkSession, d: str) -> DataFrame:
    f = M.reactive_weights(frames_emb(spark, d), 3).join(frames_emb(spark, d).select("row_id", "x0", "x1", "weight"), "row_id")
    pair = F.concat_ws("-", "i", "j")
    parts = f.select(pair.alias("pair"), B.bin_index(F.col("x0"), *_AX[0][1:]).alias("b0"), B.bin_index(F.col("x1"), *_AX[1][1:]).alias("b1"), "r", "weight").where("b0 is not null and b1 is not null")
    mean = parts.groupBy("b0", "b1", "pair").agg(F.sum("weight").alias("m"), F.sum(F.col("weight") * F.col("r")).alias("wr")).where("m > 0").select("b0", "b1", "pair", (F.col("wr") / F.col("m")).alias("mean"))
    return rounded(B.winner(mean, "pair"), ["mean"], 8)


@query("a15_histogram", f"with {EMB}, b as (select {_bin('q0 * q1', 0.0, 0.25, 60)} bin, weight from emb) select bin, round(sum(weight), 6) mass from b where bin is not null group by 1")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.histogram(frames_emb(spark, d), F.col("q0") * F.col("q1"), 0.0, 0.25, 60), ["mass"])


@query("r06_axis_limits", f"with {EMB} select round(min(x0), 6) min_x0, round(max(x0), 6) max_x0, round(min(x1), 6) min_x1, round(max(x1), 6) max_x1 from emb")
def r06(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.axis_limits(frames_emb(spark, d), ["x0", "x1"]), ["min_x0", "max_x0", "min_x1", "max_x1"])


_LIMITS = f"{EMB}, lim as (select min(x0) l0, (max(x0) - min(x0)) / 6 s0, min(x1) l1, (max(x1) - min(x1)) / 4 s1 from emb), gr as (select a::int b0, l0 + (a + 0.5e0) * s0 x0, b::int b1, l1 + (b + 0.5e0) * s1 x1 from lim, (select unnest([0, 1, 2, 3, 4, 5]) a), (select unnest([0, 1, 2, 3]) b))"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """Six by four bins over the limits of the frames."""
    limits = B.axis_limits(frames_emb(spark, d), ["x0", "x1"]).first()
    return B.grid(spark, [(limits["min_x0"], limits["max_x0"], 6), (limits["min_x1"], limits["max_x1"], 4)])


@query("a16_center_grid", f"with {_LIMITS} select b0, round(x0, 6) x0, b1, round(x1, 6) x1 from gr")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_grid(spark, d), ["x0", "x1"])


def _net_sql(net: Net, source: str, keys: list[str], inputs: list[str]) -> str:
    """The network's probabilities over a table, from its weights."""
    (w, b), (v, c) = net.layers
    x = [f"cast(cast({i} as float) as double)" for i in inputs]
    z = ", ".join(" + ".join([f"({float(b[k])!r}::double)", *(f"{x[i]} * ({float(w[i, k])!r}::double)" for i in range(len(x)))]) + f" z{k}" for k in range(len(b)))
    h = ", ".join(f"case when z{k} > 0 then z{k} else exp(z{k}) - 1 end h{k}" for k in range(len(b)))
    o = ", ".join("exp(" + " + ".join([f"({float(c[j])!r}::double)", *(f"h{k} * ({float(v[k, j])!r}::double)" for k in range(len(b)))]) + f") e{j}" for j in range(len(c)))
    total = " + ".join(f"e{j}" for j in range(len(c)))
    key = ", ".join(keys)
    return f"zz as (select {key}, {z} from {source}), hh as (select {key}, {h} from zz), oo as (select {key}, {o} from hh) select {key}, " + ", ".join(f"round(e{j} / ({total}), 6) q{j}" for j in range(len(c))) + " from oo"


@query("a16_model_on_grid", f"with {_LIMITS}, " + _net_sql(Net((2, 8, 3)), "gr", ["b0", "b1"], ["x0", "x1"]))
def a16m(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d).select("b0", "b1", F.array("x0", "x1").alias("x"))
    return M.infer(g, Net((2, 8, 3))).select("b0", "b1", *(F.round(F.col("q")[k], 6).alias(f"q{k}") for k in range(3)))


_G = [float(v) for v in np.exp(-0.5 * np.arange(-4, 5) ** 2) / np.exp(-0.5 * np.arange(-4, 5) ** 2).sum()]
_H1 = f"{EMB}, h as (select {_bin('x0', -0.3, 0.3, 24)} b0, sum(weight) mass from emb group by 1), hh as (select * from h where b0 is not null)"
_GV = "g as (select unnest([-4, -3, -2, -1, 0, 1, 2, 3, 4]) o, unnest([" + ", ".join(f"{v!r}::double" for v in _G) + "]) w)"


@query("a17_smoothed_density", f"with {_H1}, {_GV}, s as (select b0 + o b0, mass * w m from hh, g) select b0::int b0, round(sum(m), 6) mass from s where b0 between 0 and 23 group by 1")
def a17(spark: SparkSession, d: str) -> DataFrame:
    h = B.histogram(frames_emb(spark, d), F.col("x0"), -0.3, 0.3, 24).withColumnRenamed("bin", "b0")
    return rounded(B.smoothed_mass(h, "b0", 24, 1.0, False).select("b0", "mass"), ["mass"])


@query("a17_free_energy", f"with {_H1} select b0, round(mass, 6) mass, round(ln(max(mass) over () / mass), 6) free_energy from hh where mass > 0")
def a17f(spark: SparkSession, d: str) -> DataFrame:
    h = B.histogram(frames_emb(spark, d), F.col("x0"), -0.3, 0.3, 24).withColumnRenamed("bin", "b0")
    return rounded(B.free_energy(h), ["mass", "free_energy"])


@query("a18_grid_projection", f"with {_BINS} select b0, b2, round(sum(weight), 6) density, round(sum(weight * q0 * q1) / sum(weight), 8) product from bn where b0 is not null and b1 is not null and b2 is not null group by 1, 2 having sum(weight) > 0")
def a18(spark: SparkSession, d: str) -> DataFrame:
    f = B.weighted_mean_field(frames_emb(spark, d), _AX, F.col("q0") * F.col("q1")).where("mass > 0")
    return rounded(rounded(B.collapse(f, "b1").select("b0", "b2", F.col("mass").alias("density"), F.col("mean").alias("product")), ["density"]), ["product"], 8)


# ---- cells, clusters, cores --------------------------------------------------------------

_CENTERS = [[0.1, 0.0, 0.0], [-0.1, 0.05, 0.1], [0.0, -0.1, -0.05], [0.05, 0.1, 0.02]]


def _d2(c: list[float]) -> str:
    return " + ".join(f"(x{k} - ({v})) * (x{k} - ({v}))" for k, v in enumerate(c))


_CELL = f"{EMB}, ce as (select *, {', '.join(f'{_d2(c)} d{k}' for k, c in enumerate(_CENTERS))} from emb), cell as (select *, least(d0, d1, d2, d3) dist2, case when d0 = least(d0, d1, d2, d3) then 0 when d1 = least(d0, d1, d2, d3) then 1 when d2 = least(d0, d1, d2, d3) then 2 else 3 end cell from ce)"


@query("j08_nearest_center", f"with {_CELL} select row_id, cell, round(dist2, 8) dist2 from cell")
def j08(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.nearest_centers(frames_emb(spark, d), _CENTERS).select("row_id", "cell", "dist2"), ["dist2"], 8)


@query("j08_periodic_center", "with " + EMB + ", ".join([""]) + ", pc as (select row_id, " + ", ".join("(" + " + ".join(f"power((x{k} - ({v}) + 0.1) - 0.2 * floor((x{k} - ({v}) + 0.1) / 0.2) - 0.1, 2)" for k, v in enumerate(c)) + f") d{i}" for i, c in enumerate(_CENTERS)) + " from emb) select row_id, round(least(d0, d1, d2, d3), 7) dist2 from pc")
def j08p(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.nearest_centers(frames_emb(spark, d), _CENTERS, periods=[0.2, 0.2, 0.2]).select("row_id", "dist2"), ["dist2"], 7)


@query("a12_cell_probabilities", f"with {_CELL}, m as (select c cell, coalesce(sum(weight), 0) + 0.5 m from (select unnest([0, 1, 2, 3]) c) left join cell on cell = c group by 1) select cell::int cell, round(m / sum(m) over (), 8) p from m")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.cell_probabilities(C.nearest_centers(frames_emb(spark, d), _CENTERS).select("cell", "weight"), 4, 0.5), ["p"], 8)


@query("a12_kl_divergence", f"with {_CELL}, p as (select c cell, coalesce(sum(weight), 0) + 0.5 m, count(row_id) + 0.5 n from (select unnest([0, 1, 2, 3]) c) left join cell on cell = c group by 1), q as (select m / sum(m) over () a, n / sum(n) over () b from p) select round(sum(a * ln(a / greatest(b, 1e-12))), 8) kld from q where a > 0")
def a12k(spark: SparkSession, d: str) -> DataFrame:
    cells = C.nearest_centers(frames_emb(spark, d), _CENTERS).select("cell", "weight")
    return rounded(N.kl_divergence(N.cell_probabilities(cells, 4, 0.5), N.cell_probabilities(cells.withColumn("weight", F.lit(1.0)), 4, 0.5)), ["kld"], 8)


@query("w04_densest_count", f"with {_CELL}, r as (select *, row_number() over (partition by cell order by q0 desc, row_id) r, count(*) over (partition by cell) n from cell) select row_id, cell from r where r <= ceil(n * 0.1)")
def w04(spark: SparkSession, d: str) -> DataFrame:
    f = C.nearest_centers(frames_emb(spark, d), _CENTERS).withColumn("density", F.col("q0"))
    return C.densest_fraction(f, 0.1, by="cell").select("row_id", "cell")


@query("w04_densest_weight", f"with {_CELL}, r as (select *, row_number() over z r, sum(weight) over (partition by cell order by q0 desc, row_id rows unbounded preceding) / sum(weight) over (partition by cell) s from cell window z as (partition by cell order by q0 desc, row_id)) select row_id, cell from r where s <= 0.25 or r = 1")
def w04w(spark: SparkSession, d: str) -> DataFrame:
    f = C.nearest_centers(frames_emb(spark, d), _CENTERS).withColumn("density", F.col("q0"))
    return C.densest_fraction(f, 0.25, "weight", "cell").select("row_id", "cell")


@query("w05_weighted_core", f"with {_CELL}, r as (select *, row_number() over (partition by cell order by q0 desc, row_id) r, coalesce(sum(weight) over (partition by cell order by q0 desc, row_id rows between unbounded preceding and 1 preceding), 0) b, sum(weight) over (partition by cell) t from cell) select row_id, cell, b < t * 0.25 or r <= 2 core from r")
def w05(spark: SparkSession, d: str) -> DataFrame:
    f = C.nearest_centers(frames_emb(spark, d), _CENTERS).withColumn("density", F.col("q0"))
    return C.weighted_core(f, 0.25, "cell", least=2).select("row_id", "cell", "core")


@query("c03_distance_quantile", f"with {_CELL}, q as (select cell, quantile_cont(sqrt(dist2), 0.8) c from cell group by 1) select row_id, case when sqrt(dist2) <= c then cell.cell else -1 end cell from cell join q on q.cell = cell.cell")
def c03(spark: SparkSession, d: str) -> DataFrame:
    return C.beyond_quantile(C.nearest_centers(frames_emb(spark, d), _CENTERS), 0.8).select("row_id", "cell")


@query("o07_center_frames", f"with {_CELL}, r as (select cell, row_id, dist2, row_number() over (partition by cell order by dist2, row_id) r from cell) select cell, row_id, round(sqrt(dist2), 8) dist from r where r = 1")
def o07(spark: SparkSession, d: str) -> DataFrame:
    f = C.nearest_centers(frames_emb(spark, d), _CENTERS).withColumn("dist", F.sqrt("dist2"))
    return rounded(C.center_frames(f, "cell"), ["dist"], 8)


@query("w11_population_order", f"with {LI}, n as (select state, count(*) c from li group by 1) select state old, cast(row_number() over (order by c desc, state) - 1 as int) new, c::bigint n_frames from n")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return C.renumber_by_population(frames_li(spark, d))


@query("c01_kmeans", None)
def c01(spark: SparkSession, d: str) -> DataFrame:
    centers, cells = C.kmeans(frames_emb(spark, d).select("row_id", "x", "weight"), 8, rounds=10)
    return cells.groupBy("cell").agg(F.count("*").alias("n"), F.sum("dist2").alias("cost"))


def _references(spark: SparkSession, d: str) -> tuple[np.ndarray, np.ndarray]:
    """The sample that density is estimated against."""
    rows = C.weighted_sample(frames_emb(spark, d), 400).select("x", "weight").collect()
    return np.array([r["x"] for r in rows]), np.array([r["weight"] for r in rows])


@query("o02_weighted_sample", None)
def o02(spark: SparkSession, d: str) -> DataFrame:
    return C.weighted_sample(frames_emb(spark, d), 20, by=("state",)).select("row_id", "state", "weight")


_KNN = f"{EMB}, pr as (select a.row_id, b.row_id id, sqrt(power(a.x0 - b.x0, 2) + power(a.x1 - b.x1, 2) + power(a.x2 - b.x2, 2)) d from emb a join emb b on b.row_id != a.row_id), kn as (select *, row_number() over (partition by row_id order by d, id) r from pr)"


@query("j09_nearest_neighbours", f"with {_KNN} select row_id, cast(r as int) rank, id, round(d, 7) dist from kn where r <= 5")
def j09(spark: SparkSession, d: str) -> DataFrame:
    found = C.knn_all(frames_emb(spark, d), 5).select("row_id", F.posexplode(F.arrays_zip("ids", "dists")).alias("rank", "n"))
    return rounded(found.select("row_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.ids").alias("id"), F.col("n.dists").alias("dist")), ["dist"], 7)


@query("c05_neighbour_density", None)
def c05(spark: SparkSession, d: str) -> DataFrame:
    x, w = _references(spark, d)
    return C.knn_density(frames_emb(spark, d).select("row_id", "x"), x, w, 25).select("row_id", "density")


@query(
    "c06_components",
    f"""with recursive {_KNN}, cut as (select 0.8 * quantile_cont(d, 0.9) c from kn where r = 5 and d > 0), ed as (select row_id a, id b from kn, cut where r <= 5 and d <= c), both_ as (select a, b from ed union select b, a from ed),
  reach(id, root) as (select a, a from both_ union select both_.b, reach.root from reach join both_ on both_.a = reach.id) select id, min(root) component from reach group by 1""",
)
def c06(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(C.neighbour_edges(C.knn_all(frames_emb(spark, d), 5), scale=0.8))


_CORES = CoreSettings(k=5, references=1_000_000, fraction=0.4, graph_k=3, edge_scale=0.8)
_Z = ", ".join(f"(x{i} - avg(case when weight > 0 then x{i} end) over ()) / stddev_pop(case when weight > 0 then x{i} end) over () z{i}" for i in range(3))
_ZD = "sqrt(" + " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(3)) + ")"
_CORE_SQL = f"""with recursive {EMB}, z as (select row_id, state macro, weight, {_Z} from emb), own as (select * from z where weight > 0 and macro >= 0),
  share as (select row_id, weight / sum(weight) over (partition by macro) w from own),
  nb as (select a.row_id, b.row_id id, {_ZD} d, row_number() over (partition by a.row_id order by {_ZD}, b.row_id) r from own a join own b using (macro)),
  dn as (select nb.row_id, sum(w) / power(max(d), 3) density, max(d) kth from nb join share on share.row_id = nb.id where r <= 5 group by 1),
  rk as (select own.*, density, kth, row_number() over (partition by macro order by density desc, own.row_id) r, count(*) over (partition by macro) n from own join dn using (row_id)),
  core as (select * from rk where r <= ceil(n * 0.4)), cut as (select macro, 0.8 * quantile_cont(kth, 0.9) c from core where kth > 0 group by 1),
  cn as (select a.row_id a, b.row_id b, a.macro, {_ZD} d, row_number() over (partition by a.row_id order by {_ZD}, b.row_id) r from core a join core b on a.macro = b.macro and a.row_id != b.row_id),
  ed as (select a, b from cn join cut using (macro) where r <= 3 and d <= c), both_ as (select a, b from ed union select b, a from ed),
  reach(row_id, root) as (select row_id, row_id from core union select both_.b, reach.root from reach join both_ on both_.a = reach.row_id),
  pocket as (select row_id, min(root) pocket from reach group by 1),
  home as (select macro, row_id, pocket, dense_rank() over (order by macro) - 1 state from core join pocket using (row_id) where r = 1),
  lab as (select pocket.row_id, home.state from pocket join core using (row_id) join home on home.macro = core.macro and home.pocket = pocket.pocket),
  ctr as (select home.state, z.* from home join z on z.row_id = home.row_id), dist as (select a.row_id, min({_ZD}) dist from z a cross join ctr b group by 1),
  fe as (select row_id, density, -ln(density) - min(-ln(density)) over () free_energy from dn)"""


@query("c07_core_frames", f"{_CORE_SQL} select z.row_id, cast(coalesce(lab.state, -1) as int) state, round(ln(density), 6) ln_density, round(free_energy, 6) free_energy, round(dist.dist, 6) dist from z join dist using (row_id) left join fe using (row_id) left join lab using (row_id)")
def c07(spark: SparkSession, d: str) -> DataFrame:
    labelled = label_cores(frames_emb(spark, d).withColumnRenamed("state", "macro"), _CORES)[0]
    return rounded(labelled.select("row_id", "state", F.ln(F.when(F.col("density") > 0, F.col("density"))).alias("ln_density"), "free_energy", "dist"), ["ln_density", "free_energy", "dist"])


@query("c07_core_centers", f"{_CORE_SQL} select cast(state as int) state, cast(ctr.macro as bigint) macro, ctr.row_id center_row, round(free_energy, 6) free_energy, (select round(ln(min(density)), 6) from lab join dn using (row_id) where lab.state = ctr.state) ln_threshold, (select round(max(dist), 6) from lab join dist using (row_id) where lab.state = ctr.state) dist_threshold, (select count(*) from lab where lab.state = ctr.state) n_frames from ctr join fe using (row_id)")
def c07c(spark: SparkSession, d: str) -> DataFrame:
    centers = label_cores(frames_emb(spark, d).withColumnRenamed("state", "macro"), _CORES)[1]
    return rounded(centers.select("state", "macro", "center_row", "free_energy", F.ln("density_threshold").alias("ln_threshold"), "dist_threshold", "n_frames"), ["free_energy", "ln_threshold", "dist_threshold"])


@query("c06_trajectory_components", f"with {EV} select traj_id id, min(traj_id) over () component from (select distinct traj_id from ev) where true")
def c06t(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories chained in order of id form one component."""
    t = number_rows(frames_ev(spark, d).select("traj_id").distinct(), ["traj_id"])
    later = t.select((F.col("row_id") - 1).alias("row_id"), F.col("traj_id").alias("b"))
    return connected_components(t.join(later, "row_id").select(F.col("traj_id").alias("a"), "b"))


# ---- relabelling -------------------------------------------------------------------------


@query("c11_iterative_merge", None)
def c11(spark: SparkSession, d: str) -> DataFrame:
    merged, _ = R.merge_duplicates(frames_li(spark, d), R.Settings(lags=(1, 2), merge_cutoff=0.2))
    return merged.groupBy("state").agg(F.count("*").alias("n_frames"))


@query("c09_kinetic_groups", None)
def c09(spark: SparkSession, d: str) -> DataFrame:
    scored = D.scores(frames_emb(spark, d).where("state >= 0"))
    return R.kinetic_groups(scored, [1], own_cut=0.2).groupBy("state", "group").agg(F.count("*").alias("n"))


@query("c10_candidate_groups", None)
def c10(spark: SparkSession, d: str) -> DataFrame:
    scored = D.scores(frames_emb(spark, d))
    groups, _ = G.candidate_groups(scored, scored.where("entropy >= 0.5"), R.Settings(lags=(1, 2), least_frames=5, least_pairs=1))
    return groups.groupBy("group").agg(F.count("*").alias("n_frames"))


_ND = "sqrt(power(a.x0 - b.x0, 2) + power(a.x1 - b.x1, 2) + power(a.x2 - b.x2, 2))"


def _neighbour_density(k: int) -> str:
    return f"""nn as (select a.row_id, b.row_id id, b.weight w, {_ND} d, row_number() over (partition by a.row_id order by {_ND}, b.row_id) r from emb a join emb b on a.row_id != b.row_id),
  de as (select emb.row_id, any_value(weight) weight, (any_value(weight) + sum(w)) / power(greatest(max(d), 1e-12), 3) density from emb join nn on nn.row_id = emb.row_id where r <= {k} group by 1)"""


@query("c05_exact_density", f"with {EMB}, {_neighbour_density(20)} select row_id, round(ln(density), 6) ln_density from de")
def c05e(spark: SparkSession, d: str) -> DataFrame:
    """The density against every row, by exact neighbours."""
    dense = G.neighbour_density(frames_emb(spark, d).select("row_id", "x", "weight"), 20)
    return rounded(dense.select("row_id", F.ln("density").alias("ln_density")), ["ln_density"])


@query(
    "c10_neighbour_components",
    f"""with recursive {EMB}, {_neighbour_density(3)}, ord as (select *, coalesce(sum(weight) over (order by density desc, row_id rows between unbounded preceding and 1 preceding), 0) b, sum(weight) over () t, row_number() over (order by density desc, row_id) r from de),
  co as (select emb.* from emb join ord on ord.row_id = emb.row_id where b < 0.5 * t or r <= 4), kn as (select a.row_id a, b.row_id b, row_number() over (partition by a.row_id order by {_ND}, b.row_id) r from co a join co b on a.row_id != b.row_id),
  ed as (select x.a, x.b from kn x join kn y on x.a = y.b and x.b = y.a where x.r <= 3 and y.r <= 3), reach(row_id, root) as (select row_id, row_id from co union select ed.b, reach.root from reach join ed on ed.a = reach.row_id),
  comp as (select row_id, min(root) component from reach group by 1), big as (select component, count(*) n, cast(row_number() over (order by count(*) desc, component) - 1 as int) g from comp group by 1 having count(*) >= 4)
  select row_id, g as group from comp join big using (component)""",
)
def c10n(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbour_components(frames_emb(spark, d), k=3, fraction=0.5, least=4)


@query("c13_reshape", None)
def c13(spark: SparkSession, d: str) -> DataFrame:
    scored = D.scores(frames_emb(spark, d))
    groups = R.kinetic_groups(scored, [1], own_cut=0.2)
    return R.reshape(scored, groups, 3, least_frames=5).groupBy("state").agg(F.count("*").alias("n"))


for _score in ("entropy", "gini"):
    query(f"c14_relabel_{_score}", None)(lambda spark, d, s=_score: R.propose(frames_emb(spark, d), R.Settings(score=s, high_entropy=0.95))[0].select("row_id", "old_state", "state"))


# ---- paths -------------------------------------------------------------------------------


def _images(spark: SparkSession, d: str) -> DataFrame:
    """The fifty frames of each vector trajectory are a path of fifty images."""
    return frames_emb(spark, d).select(F.col("traj_id").alias("path_id"), F.col("frame").alias("image_id"), F.array("x0", "x1").alias("x"), (F.col("traj_id") + 1.0).alias("weight"))


_IM = f"{EMB}, im as (select traj_id path_id, frame image_id, x0, x1, traj_id + 1.0 weight from emb)"


@query("s09_coarse_images", f"with {_IM}, k as (select *, row_number() over (partition by path_id order by image_id) - 1 r, count(*) over (partition by path_id) n from im) select path_id, cast(row_number() over (partition by path_id order by r) - 1 as int) image_id, round(x0, 6) x0 from k where r % 4 = 0 or r = n - 1")
def s09(spark: SparkSession, d: str) -> DataFrame:
    return Q.coarsen(_images(spark, d), 4).select("path_id", "image_id", F.round(F.col("x")[0], 6).alias("x0"))


@query("w06_smoothed_paths", f"with {_IM}, s as (select *, (coalesce(lag(x0) over w, x0) + x0 + coalesce(lead(x0) over w, x0)) / 3 m, lag(x0) over w is null or lead(x0) over w is null fixed from im window w as (partition by path_id order by image_id)) select path_id, image_id, round(case when fixed then x0 else m end, 8) x0 from s")
def w06(spark: SparkSession, d: str) -> DataFrame:
    return Q.smooth(_images(spark, d)).select("path_id", "image_id", F.round(F.col("x")[0], 8).alias("x0"))


_ARC = f"{_IM}, st as (select *, coalesce(sqrt(power(x0 - lag(x0) over w, 2) + power(x1 - lag(x1) over w, 2)), 0) step from im window w as (partition by path_id order by image_id)), ar as (select *, sum(case when step > 1e-14 then step else 0 end) over (partition by path_id order by image_id) arc from st)"


@query("w07_arc_lengths", f"with {_ARC} select path_id, image_id, round(arc, 8) arc from ar")
def w07(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.arcs(_images(spark, d)).select("path_id", "image_id", "arc"), ["arc"], 8)


@query(
    "w07_reparameterised",
    f"""with {_ARC}, sg as (select *, lead(arc) over w a2, lead(x0) over w y0, max(arc) over (partition by path_id) len from ar window w as (partition by path_id order by image_id)),
tg as (select s.*, k, k * len / 5 att from sg s, (select unnest([0, 1, 2, 3, 4, 5]) k)) select path_id, k::int image_id, round(case when a2 is null then x0 else x0 + (y0 - x0) * (att - arc) / (a2 - arc) end, 7) x0 from tg where (arc <= att and att < a2 and k < 5) or (a2 is null and k = 5)""",
)
def w07r(spark: SparkSession, d: str) -> DataFrame:
    return Q.reparameterise(_images(spark, d), 6).select("path_id", "image_id", F.round(F.col("x")[0], 7).alias("x0"))


@query("w09_unwrapped", f"with {_IM}, s as (select *, coalesce(x0 - lag(x0) over w, x0) dx, row_number() over w r from im window w as (partition by path_id order by image_id)), u as (select *, case when r = 1 then dx else (dx + 0.1) - 0.2 * floor((dx + 0.1) / 0.2) - 0.1 end m from s) select path_id, image_id, round(sum(m) over (partition by path_id order by image_id), 7) x0 from u")
def w09(spark: SparkSession, d: str) -> DataFrame:
    return Q.unwrap(_images(spark, d), [0.2, 0.0]).select("path_id", "image_id", F.round(F.col("x")[0], 7).alias("x0"))


@query("r02_periodic_segments", f"with {_IM}, s as (select *, case when abs(x0 - lag(x0) over w) > 0.15 then 1 else 0 end j from im window w as (partition by path_id order by image_id)), g as (select *, sum(j) over (partition by path_id order by image_id) segment from s), n as (select *, count(*) over (partition by path_id, segment) n from g), m as (select *, max(n) over (partition by path_id) mx from n) select path_id, image_id, segment::int segment from m where n >= 2 or mx < 2")
def r02(spark: SparkSession, d: str) -> DataFrame:
    return Q.periodic_segments(_images(spark, d), [0.3, 0.0]).select("path_id", "image_id", "segment")


@query("w10_segments", f"with {_IM}, s as (select *, case when x0 > 0 then 1 end shared from im), c as (select *, case when row_number() over w > 1 and shared is not distinct from lag(shared) over w then 0 else 1 end c from s window w as (partition by path_id order by image_id)), g as (select *, sum(c) over (partition by path_id order by image_id) - 1 segment from c) select path_id, segment::int segment, any_value(shared) shared, min(image_id) first_image, max(image_id) last_image, count(*)::bigint n_images from g group by 1, 2")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return E.decompose(_images(spark, d).withColumn("shared", F.when(F.col("x")[0] > 0, 1)))


@query("a25_center_path", f"with {_IM} select cast(path_id % 2 as int) cluster, image_id, round(sum(x0 * weight) / sum(weight), 8) x0 from im group by 1, 2")
def a25(spark: SparkSession, d: str) -> DataFrame:
    f = _images(spark, d).withColumn("cluster", (F.col("path_id") % 2).cast("int"))
    return Q.center_path(f).select("cluster", "image_id", F.round(F.col("x")[0], 8).alias("x0"))


@query("a25_periodic_mean", f"with {LI} select traj_id, round(atan2(sum(weight * sin(radians(cv1 * 7))), sum(weight * cos(radians(cv1 * 7)))) * 180 / pi(), 5) mean from li group by 1")
def a25p(spark: SparkSession, d: str) -> DataFrame:
    return frames_li(spark, d).groupBy("traj_id").agg(F.round(Q.periodic_mean(F.col("cv1") * 7, F.col("weight"), 360.0), 5).alias("mean"))


_RM = f"{_IM}, rm as (select a.path_id path_a, b.path_id path_b, sqrt(sum(power(a.x0 - b.x0, 2) + power(a.x1 - b.x1, 2)) / (2 * count(*))) rmsd from im a join im b on a.image_id = b.image_id and a.path_id < b.path_id group by 1, 2)"


@query("a26_path_rmsd", f"with {_RM} select path_a, path_b, round(rmsd, 8) rmsd from rm")
def a26(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.path_rmsd(_images(spark, d)), ["rmsd"], 8)


@query("a25_medoid", f"with {_RM}, l as (select path_a p, path_b o, rmsd from rm union all select path_b, path_a, rmsd from rm), c as (select p path_id, sum(rmsd * (o + 1)) cost from l group by 1) select path_id, round(cost, 6) cost from c order by cost, path_id limit 1")
def a25m(spark: SparkSession, d: str) -> DataFrame:
    im = _images(spark, d)
    return rounded(Q.medoids(Q.path_rmsd(im), im.select("path_id", "weight").distinct()), ["cost"])


@query("c22_path_clusters", None)
def c22(spark: SparkSession, d: str) -> DataFrame:
    im = _images(spark, d)
    weights = {r[0]: r[1] for r in im.select("path_id", "weight").distinct().collect()}
    clusters, _ = Q.cluster_paths(im, weights, 0.175)
    return spark.createDataFrame([(p, k) for k, c in enumerate(clusters) for p in c], "path_id long, cluster int")


@query("o01_channel_points", f"with {EMB} select row_id, round(q0 * q1, 8) channel from emb where q0 * q1 >= 0.1 and weight > 0")
def o01(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.channel_points(frames_emb(spark, d), 0, 1, 0.1).select("row_id", "channel"), ["channel"], 8)


@query("o04_thinned_points", f"with {EMB} select row_id, round(q0 * q1, 8) r from emb order by q0 * q1 desc, row_id limit 50")
def o04(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the fifty points of largest q0 q1."""
    f = frames_emb(spark, d).withColumn("r", F.col("q0") * F.col("q1"))
    return rounded(f.orderBy(F.desc("r"), "row_id").limit(50).select("row_id", "r"), ["r"], 8)


@query("o06_field_centers", None)
def o06(spark: SparkSession, d: str) -> DataFrame:
    """Grid bins above a channel threshold, clustered, the best bin of each cluster."""
    f = B.weighted_mean_field(frames_emb(spark, d), _AX[:2], F.col("q0") * F.col("q1")).where("mean > 0.05 and mass > 0")
    points = f.select((F.col("b0") * 100 + F.col("b1")).cast("long").alias("row_id"), F.array(F.col("b0").cast("double"), F.col("b1").cast("double")).alias("x"), F.col("mass").alias("weight"), "mean")
    _, cells = C.kmeans(points, 3, rounds=20)
    best = F.row_number().over(W.partitionBy("cell").orderBy(F.desc("mean"), "row_id"))
    return cells.withColumn("r", best).where("r = 1").select("cell", "row_id", "mean")


def _two_paths() -> dict[int, np.ndarray]:
    t = np.linspace(0, 1, 6)[:, None]
    a, b = np.array([-0.2, -0.2, 0.0]), np.array([0.2, 0.2, 0.0])
    return {0: a + t * (b - a), 1: a + t * (b - a) + np.sin(np.pi * t) * np.array([0.1, -0.1, 0.05])}


def _exchange(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    paths = _two_paths()
    cells = E.path_cells(frames_emb(spark, d), paths)
    nodes = spark.createDataFrame([(p, k, x.tolist()) for p, m in paths.items() for k, x in enumerate(m)], "path_id int, image_id int, x array<double>")
    return E.exchange_counts(cells, {0: 6, 1: 6}), nodes


def _nearest_image(p: int) -> str:
    """The first of the images of a path that are nearest, as a CASE over their squared distances."""
    d2 = [" + ".join(f"power(x{k} - ({float(v)!r}::double), 2)" for k, v in enumerate(image)) for image in _two_paths()[p]]
    return "case " + " ".join(f"when {d} <= least({', '.join(d2)}) then {k}" for k, d in enumerate(d2)) + " end"


_XC = (
    f"{EMB}, ce as (select row_id, traj_id, weight, {_nearest_image(0)} i0, {_nearest_image(1)} i1 from emb), tw as (select a.weight, a.i0, a.i1, b.i0 t0, b.i1 t1 from ce a join ce b on b.row_id = a.row_id + 1 and b.traj_id = a.traj_id), "
    "on1 as (select 0 path_a, i0 image_a, 1 path_b, t1 image_b, weight w from tw union all select 1, i1, 0, t0, weight from tw), "
    "inn as (select * from on1 where image_a between 1 and 4 and image_b between 1 and 4), "
    "xc as (select path_a, image_a, path_b, image_b, sum(w) count from (select * from inn union all select path_b, image_b, path_a, image_a, w from inn) group by 1, 2, 3, 4)"
)
_NODES = "nd as (" + " union all ".join(f"select {p} p, {k} im, " + ", ".join(f"({float(v)!r}::double) n{c}" for c, v in enumerate(image)) for p, m in _two_paths().items() for k, image in enumerate(m)) + ")"


@query("j12_exchange_counts", f"with {_XC} select path_a, image_a::int image_a, path_b, image_b::int image_b, round(count, 6) count from xc")
def j12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_exchange(spark, d)[0], ["count"])


@query(
    "o08_exchange_edges",
    f"""with {_XC}, {_NODES}, ou as (select path_a p, image_a im, sum(count) o from xc group by 1, 2), ed as (select xc.*, count / least(a.o, b.o) probability, sqrt(power(na.n0 - nb.n0, 2) + power(na.n1 - nb.n1, 2) + power(na.n2 - nb.n2, 2)) distance
  from xc join ou a on a.p = path_a and a.im = image_a join ou b on b.p = path_b and b.im = image_b join nd na on na.p = path_a and na.im = image_a join nd nb on nb.p = path_b and nb.im = image_b where path_a < path_b)
select path_a, image_a::int image_a, path_b, image_b::int image_b, round(count, 6) count, round(probability, 8) probability, round(distance, 8) distance, count >= 1 and distance <= 0.3 accepted from ed""",
)
def o08(spark: SparkSession, d: str) -> DataFrame:
    counts, nodes = _exchange(spark, d)
    return rounded(rounded(E.edge_table(counts, nodes, min_count=1.0, max_distance=0.3), ["count"]), ["probability", "distance"], 8)


def _accepted(spark: SparkSession, d: str, least: float) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    counts, nodes = _exchange(spark, d)
    return [((r["path_a"], r["image_a"]), (r["path_b"], r["image_b"])) for r in E.edge_table(counts, nodes, min_probability=least).where("accepted").collect()]


def _edge_sql(least: float) -> str:
    """Accepted edges of the two paths as numbers of nodes, both ways; node 6 p + k is image k of path p."""
    return f"""{_XC}, ou as (select path_a p, image_a im, sum(count) o from xc group by 1, 2), ae as (select 6 * path_a + image_a a, 6 * path_b + image_b b from xc join ou s on s.p = path_a and s.im = image_a join ou t on t.p = path_b and t.im = image_b
  where count > 0 and count / least(s.o, t.o) >= {least}), nodes as (select unnest(range(12))::int n)"""


@query(
    "c24_shared_segments",
    f"""with recursive {_edge_sql(0.345)}, reach(n, root) as (select n, n from nodes union select ae.b, reach.root from reach join ae on ae.a = reach.n), co as (select n, min(root) root from reach group by 1),
  la as (select n, root, dense_rank() over (order by root) - 1 node, count(distinct n // 6) over (partition by root) > 1 shared from co) select cast(n // 6 as int) path_id, cast(n % 6 as int) image_id, cast(node as int) node, shared from la""",
)
def c24(spark: SparkSession, d: str) -> DataFrame:
    labels = E.shared_nodes(_accepted(spark, d, 0.345), [(p, k) for p in (0, 1) for k in range(6)])
    shared = E.shared_segments(labels)
    return spark.createDataFrame([(p, k, v, v in shared) for (p, k), v in labels.items()], "path_id int, image_id int, node int, shared boolean")


_MOVES = ", ".join(f"sum(count * (nb.n{k} - na.n{k})) / (2 * sum(count)) m{k}" for k in range(3))
_MOVED = ", ".join(f"round(case when nd.im between 1 and 4 then n{k} + 0.5e0 * coalesce(m{k}, 0) else n{k} end, 8) x{k}" for k in range(3))


@query(
    "c25_relaxed_images",
    f"with {_XC}, {_NODES}, mv as (select path_a p, image_a im, {_MOVES} from xc join nd na on na.p = path_a and na.im = image_a join nd nb on nb.p = path_b and nb.im = image_b group by 1, 2) select nd.p path_id, nd.im image_id, {_MOVED} from nd left join mv on mv.p = nd.p and mv.im = nd.im",
)
def c25(spark: SparkSession, d: str) -> DataFrame:
    counts, nodes = _exchange(spark, d)
    return E.relax(nodes, counts).select("path_id", "image_id", *(F.round(F.col("x")[k], 8).alias(f"x{k}") for k in range(3)))


@query("c26_path_expansion", None)
def c26(spark: SparkSession, d: str) -> DataFrame:
    done = X.expand(frames_emb(spark, d), _two_paths(), X.Expansion(rounds=2, relaxation=0.5, smoothing=1, window=3))
    return spark.createDataFrame([(p, k, x.tolist()) for p, m in done[-1].moved.items() for k, x in enumerate(m)], "path_id int, image_id int, x array<double>")


@query(
    "c27_routes",
    f"""with recursive {_edge_sql(0.345)}, adj as (select a, b from ae union select n, n + 1 from nodes where n % 6 < 5 union select n + 1, n from nodes where n % 6 < 5),
  walk(here, way) as (select n, [n] from nodes where n % 6 = 0 union all select adj.b, list_append(way, adj.b) from walk join adj on adj.a = walk.here where not list_contains(way, adj.b) and not (here % 6 = 5 and len(way) > 1))
  select array_to_string(way, '-') route, cast(len(way) as int) n_nodes from walk where here % 6 = 5 and len(way) > 1""",
)
def c27(spark: SparkSession, d: str) -> DataFrame:
    """Simple routes from a path's first image to a path's last along the paths and the accepted exchange between them."""
    routes = E.reactive_routes({0: 6, 1: 6}, _accepted(spark, d, 0.345))
    return spark.createDataFrame([("-".join(str(6 * p + k) for p, k in r), len(r)) for r in routes], "route string, n_nodes int")


# ---- models ------------------------------------------------------------------------------


def _training(spark: SparkSession, d: str) -> DataFrame:
    pairs = L.positive_pairs(L.positional_pairs(frames_emb(spark, d), 2, ["x", "state", "weight"]))
    return pairs.select("row_id", "x", "x_tau", F.col("state").alias("label"), F.col("state_tau").alias("label_tau"), "weight")


@query("c18_training", None)
def c18(spark: SparkSession, d: str) -> DataFrame:
    _, history = M.train(_training(spark, d), Net((3, 8, 3)), Loss(flux=0.0), epochs=3)
    return spark.createDataFrame([(h["epoch"], h["train"], h["validation"]) for h in history], "epoch int, train double, validation double")


@query("c19_inference", f"with {EMB}, " + _net_sql(Net((3, 8, 3)), "emb", ["row_id"], ["x0", "x1", "x2"]))
def c19(spark: SparkSession, d: str) -> DataFrame:
    return M.infer(frames_emb(spark, d).select("row_id", "x"), Net((3, 8, 3))).select("row_id", *(F.round(F.col("q")[k], 6).alias(f"q{k}") for k in range(3)))


@query("c17_boundary_loss", f"with {SC} select round(sum(weight * -ln(greatest(q_own, 1e-12))) / sum(weight), 8) boundary from sc where state >= 0")
def c17b(spark: SparkSession, d: str) -> DataFrame:
    """Cross entropy over labelled frames only."""
    return rounded(M.boundary_loss(frames_emb(spark, d)), ["boundary"], 8)


@query("c17_boundary_distance", f"with {EMB} select round(sum(weight * (power(q0 - case state when 0 then 1 else 0 end, 2) + power(q1 - case state when 1 then 1 else 0 end, 2) + power(q2 - case state when 2 then 1 else 0 end, 2))) / sum(weight), 8) boundary from emb where state >= 0")
def c17m(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.boundary_loss(frames_emb(spark, d), mode="mse"), ["boundary"], 8)


@query("c20_pairwise_training", None)
def c20(spark: SparkSession, d: str) -> DataFrame:
    f = L.pair_labels(frames_emb(spark, d), 3)
    pairs = L.positional_pairs(f, 2, ["x", "pair_labels"]).select("row_id", "x", "x_tau", F.col("pair_labels").alias("label"), F.col("pair_labels_tau").alias("label_tau"), "weight")
    _, history = M.train(pairs, Net((3, 8, 3), head="sigmoid"), Loss(flux=0.0, pairwise=True), epochs=3)
    return spark.createDataFrame([(h["epoch"], h["train"], h["validation"]) for h in history], "epoch int, train double, validation double")


@query("c17_dirichlet_loss", f"with {EMB} select round(sum(a.weight * (power(b.q0 - a.q0, 2) + power(b.q1 - a.q1, 2) + power(b.q2 - a.q2, 2))) / sum(a.weight), 8) dirichlet from emb a join emb b on b.row_id = a.row_id + 2 and b.traj_id = a.traj_id")
def c17(spark: SparkSession, d: str) -> DataFrame:
    from lagwell.functions.arrays import square_distance

    p = L.positional_pairs(frames_emb(spark, d), 2, ["q"])
    return rounded(p.agg((F.sum(F.col("weight") * square_distance(F.col("q"), F.col("q_tau"))) / F.sum("weight")).alias("dirichlet")), ["dirichlet"], 8)


@query("c21_shooting", None)
def c21(spark: SparkSession, d: str) -> DataFrame:
    starts = Q.channel_points(frames_emb(spark, d), 0, 1, 0.1, most=10).select(F.col("row_id").alias("path_id"), "x")
    return Q.shoot(starts, Net((3, 8, 3)), 0, max_steps=20)


@query("w08_stitched_paths", None)
def w08(spark: SparkSession, d: str) -> DataFrame:
    starts = Q.channel_points(frames_emb(spark, d), 0, 1, 0.1, most=10).select(F.col("row_id").alias("path_id"), "x")
    net = Net((3, 8, 3))
    legs = Q.shoot(starts, net, 0, max_steps=20).withColumn("leg", F.lit(0)).unionByName(Q.shoot(starts, net, 1, max_steps=20).withColumn("leg", F.lit(1)))
    return Q.stitch(legs.select("path_id", "leg", "image_id", "x"), 10)


@query("k03_assignments", f"with {SC} select row_id, traj_id, frame, weight, state, q_argmax, round(q0, 6) q_0, round(q1, 6) q_1, round(q2, 6) q_2 from sc")
def k03(spark: SparkSession, d: str) -> DataFrame:
    from lagwell.sinks.writers import assignments

    return rounded(assignments(frames_emb(spark, d), 3), ["q_0", "q_1", "q_2"])
