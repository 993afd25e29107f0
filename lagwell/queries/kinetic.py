"""Lag joins, counts, fluxes, rates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwell.functions import kinetics as K
from lagwell.operators import counting as N
from lagwell.operators import flux as X
from lagwell.operators import lag as L
from lagwell.plans.stages import rate_matrices
from lagwell.queries.registry import query, rounded
from lagwell.queries.views import EMB, EV, LI, frames_emb, frames_ev, frames_li
from lagwell.sinks.writers import msm_summary

_POS = f"{EMB}, pr as (select a.row_id, a.traj_id, a.state, b.state state_tau, a.weight, b.weight weight_tau, a.q0, a.q1, a.q2, b.q0 t0, b.q1 t1, b.q2 t2 from emb a join emb b on b.row_id = a.row_id + 2 and b.traj_id = a.traj_id)"
_SEQ = f"{EV}, sq as (select *, 2 lag, lead(state, 2) over w state_tau, lead(row_id, 2) over w there from ev window w as (partition by traj_id order by frame)), pr as (select * from sq where there is not null)"


def _positional(spark: SparkSession, d: str) -> DataFrame:
    return L.positional_pairs(frames_emb(spark, d), 2, ["state", "weight", "q"])


@query("j01_positional_pairs", f"with {_POS} select row_id, state, state_tau from pr")
def j01(spark: SparkSession, d: str) -> DataFrame:
    return _positional(spark, d).select("row_id", "state", "state_tau")


@query("j02_keyed_pairs", f"with {LI} " + " union all ".join(f"select a.row_id, {lag} lag, b.state state_tau from li a join li b on b.traj_id = a.traj_id and b.frame = a.frame + {lag}" for lag in (1, 2, 5)))
def j02(spark: SparkSession, d: str) -> DataFrame:
    return L.keyed_pairs(frames_li(spark, d), [1, 2, 5], ["state"]).select("row_id", "lag", "state_tau")


@query(
    "j03_sequence_pairs",
    f"with {LI}, s as (select *, lead(state, 1) over w s1, lead(state, 2) over w s2, lead(state, 5) over w s5 from li window w as (partition by traj_id order by frame)) "
    "select row_id, 1 lag, s1 state_tau from s where s1 is not null union all select row_id, 2, s2 from s where s2 is not null union all select row_id, 5, s5 from s where s5 is not null",
)
def j03(spark: SparkSession, d: str) -> DataFrame:
    return L.sequence_pairs(frames_li(spark, d), [1, 2, 5], ["state"]).select("row_id", "lag", "state_tau")


for _r, _c in (("none", "true"), ("any", "state >= 0 or state_tau >= 0"), ("both", "state >= 0 and state_tau >= 0")):
    query(f"j04_labelled_{_r}", f"with {_POS} select row_id, state, state_tau from pr where {_c}")(lambda spark, d, r=_r: L.labelled_filter(_positional(spark, d), r).select("row_id", "state", "state_tau"))


@query("j05_pairwise_labelled", f"with {_POS} select row_id, state, state_tau from pr where state >= 0 and state_tau >= 0")
def j05(spark: SparkSession, d: str) -> DataFrame:
    """Pair-wise training pairs: some pair of states is labelled at both ends."""
    f = L.pair_labels(frames_emb(spark, d), 3)
    pairs = L.positional_pairs(f, 2, ["state", "pair_labels"])
    return pairs.where(F.exists("pair_labels", lambda v: v >= 0) & F.exists("pair_labels_tau", lambda v: v >= 0)).select("row_id", "state", "state_tau")


@query("j06_segment_pairs", f"with {EV}, b as (select *, cast(floor(frame / 16) as int) block from ev) select a.row_id, b.row_id row_id_tau from b a join b on b.traj_id = a.traj_id and b.block = a.block and b.frame = a.frame + 2")
def j06(spark: SparkSession, d: str) -> DataFrame:
    f = frames_ev(spark, d).withColumn("traj_id", F.struct("traj_id", F.floor(F.col("frame") / 16)))
    return L.sequence_pairs(f.withColumn("id", F.col("row_id")), [2], ["id"]).select("row_id", F.col("id_tau").alias("row_id_tau"))


@query("p21_positive_pairs", f"with {_POS} select row_id, weight, weight_tau from pr where weight > 0 and weight_tau > 0")
def p21(spark: SparkSession, d: str) -> DataFrame:
    return L.positive_pairs(_positional(spark, d)).select("row_id", "weight", "weight_tau")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return N.count_matrix(L.sequence_pairs(frames_ev(spark, d), [2], ["state"]))


_C = f"{_SEQ}, c as (select lag, state i, state_tau j, sum(weight) count, count(*) n_pairs from pr where state >= 0 and state_tau >= 0 and weight > 0 group by 1, 2, 3)"


@query("a01_count_matrix", f"with {_C} select lag, i, j, round(count, 4) count, n_pairs::bigint n_pairs from c")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_counts(spark, d), ["count"], 4)


@query(
    "a01_multi_lag_counts",
    f"with {LI} select l.lag, a.state i, b.state j, round(sum(a.weight), 2) count, count(*)::bigint n_pairs from li a cross join (select unnest([1, 2, 5, 10]) lag) l join li b on b.traj_id = a.traj_id and b.frame = a.frame + l.lag where a.weight > 0 group by 1, 2, 3",
)
def a01_multi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.count_matrix(L.sequence_pairs(frames_li(spark, d), [1, 2, 5, 10], ["state"])), ["count"], 2)


_GRID = "grid as (select a.i::int i, b.j::int j from (select unnest([0, 1, 2]) i) a, (select unnest([0, 1, 2]) j) b)"
_T = f"{_C}, {_GRID}, f as (select 2 lag, i, j, coalesce(count, 0) count from grid left join c using (i, j)), m as (select *, sum(count) over (partition by i) mass from f), t as (select lag, i, j, case when mass > 0 then (count + 1e-8) / (mass + 3e-8) when i = j then 1 else 0 end p, mass, count from m)"


@query("msm_transition_matrix", f"with {_T} select lag, i, j, round(count, 4) count, round(p, 8) p from t")
@query("a02_transition_matrix", f"with {_T} select lag, i, j, round(count, 4) count, round(p, 8) p from t")
def a02(spark: SparkSession, d: str) -> DataFrame:
    t = N.transition_matrix(_counts(spark, d), 3)
    return rounded(rounded(t, ["count"], 4), ["p"], 8).drop("mass")


@query("a02_reversible", f"with {_C}, s as (select lag, i, j, sum(count) / 2 count from (select lag, i, j, count from c union all select lag, j, i, count from c) group by 1, 2, 3), {_GRID}, f as (select 2 lag, i, j, coalesce(count, 0) count from grid left join s using (i, j)) select lag, i, j, round((count + 1e-8) / (sum(count) over (partition by i) + 3e-8), 8) p from f")
def a02_rev(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.transition_matrix(_counts(spark, d), 3, reversible=True).select("lag", "i", "j", "p"), ["p"], 8)


@query("a03_segment_transition", f"with {_SEQ}, c as (select state i, state_tau j, sum(weight) count from pr where state >= 0 and state_tau >= 0 and weight > 0 group by 1, 2), {_GRID}, f as (select i, j, coalesce(count, 0) count from grid left join c using (i, j)), m as (select *, sum(count) over (partition by i) mass from f) select i, j, round(case when mass > 0 then count / mass when i = j then 1 else 0 end, 8) p from m")
def a03(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.transition_matrix(_counts(spark, d), 3, pseudocount=0.0).select("i", "j", "p"), ["p"], 8)


@query("a04_local_transition", f"with {EV}, e as (select *, frame % 4 micro from ev), p as (select a.state, a.micro i, b.micro j, a.weight from e a join e b on b.traj_id = a.traj_id and b.frame = a.frame + 3 where a.state >= 0 and a.state = b.state and a.weight > 0) select state, i, j, round(sum(weight), 4) count, count(*)::bigint n_pairs from p group by 1, 2, 3")
def a04(spark: SparkSession, d: str) -> DataFrame:
    f = frames_ev(spark, d).withColumn("micro", F.col("frame") % 4)
    pairs = L.keyed_pairs(f, [3], ["state", "micro"]).where("state >= 0 and state = state_tau")
    kept = N.count_matrix(pairs.withColumnsRenamed({"state": "label", "state_tau": "label_tau"}), by=("label",), origin="micro", target="micro_tau")
    return rounded(kept.withColumnRenamed("label", "state"), ["count"], 4)


@query("a05_macro_transition", f"with {_T}, pi as (select i, sum(count) / sum(sum(count)) over () w from t group by 1), x as (select t.i, t.j, p, w, case when t.i < 2 then 0 else 1 end a, case when t.j < 2 then 0 else 1 end b from t join pi on pi.i = t.i) select a::int i, b::int j, round(sum(w * p) / (select sum(w) from pi where case when pi.i < 2 then 0 else 1 end = x.a), 8) p from x group by a, b")
def a05(spark: SparkSession, d: str) -> DataFrame:
    """Driver algebra on the 3 x 3 matrices."""
    rows = N.transition_matrix(_counts(spark, d), 3).collect()
    t, c = K.dense(rows, 3, "p"), K.dense(rows, 3, "count")
    chi = np.array([[1.0, 0], [1, 0], [0, 1]])
    return rounded(X.matrix_frame(spark, K.macro_transition(t, c.sum(1) / c.sum(), chi), "p").drop("unbounded"), ["p"], 8)


@query("l05_residence_escape", f"with {_T} select lag, i, round(p, 8) p, round(case when p <= 0 then 0 when p < 1 then -2 / ln(p) end, 6) residence, round(case when p <= 0 then 2.0 when p < 1 then 2 / (1 - p) end, 6) \"escape\", p >= 1 unbounded from t where i = j")
def l05(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(N.residence_escape(N.transition_matrix(_counts(spark, d), 3)), ["residence", "escape"]), ["p"], 8)


@query("k06_msm_summary", f"with {_T} select lag, round(min(p), 6) min_self, round(avg(p), 6) mean_self, round(min(-2 / ln(p)), 6) min_residence, round(max(2 / (1 - p)), 6) max_escape from t where i = j group by lag")
def k06(spark: SparkSession, d: str) -> DataFrame:
    t = N.transition_matrix(_counts(spark, d), 3)
    return rounded(msm_summary(t, N.residence_escape(t)), ["min_self", "mean_self", "min_residence", "max_escape"])


@query("u03_active_states", f"with {EV} select distinct state from ev where state >= 0 and weight > 0")
def u03(spark: SparkSession, d: str) -> DataFrame:
    return N.active_states(frames_ev(spark, d))


@query("u04_restricted_counts", f"with {_C} select lag, i, j, round(count, 4) count, n_pairs::bigint n_pairs from c where i in (0, 2) and j in (0, 2)")
def u04(spark: SparkSession, d: str) -> DataFrame:
    active = N.active_states(frames_ev(spark, d)).where("state in (0, 2)")
    return rounded(N.restrict(_counts(spark, d), active), ["count"], 4).select("lag", "i", "j", "count", "n_pairs")


@query("u01_concatenation", f"with {EV}, {LI} select 'ev' src, count(*)::bigint n, sum(frame)::bigint s from ev union all select 'li', count(*)::bigint, sum(frame)::bigint from li")
def u01(spark: SparkSession, d: str) -> DataFrame:
    both = frames_ev(spark, d).withColumn("src", F.lit("ev")).unionByName(frames_li(spark, d).withColumn("src", F.lit("li")), allowMissingColumns=True)
    return both.groupBy("src").agg(F.count("*").alias("n"), F.sum("frame").alias("s"))


@query("u02_missing_columns", f"with {EV}, {LI} select count(*)::bigint n, count(cv2)::bigint with_cv2, count(cv1)::bigint with_cv1 from (select cv1, null::double cv2 from ev union all select cv1, cv2 from li)")
def u02(spark: SparkSession, d: str) -> DataFrame:
    both = frames_ev(spark, d).unionByName(frames_li(spark, d), allowMissingColumns=True)
    return both.agg(F.count("*").alias("n"), F.count("cv2").alias("with_cv2"), F.count("cv1").alias("with_cv1"))


@query("j10_macro_lookup", f"with {LI} select row_id, case state when 0 then 0 when 2 then 1 when 3 then 1 else -1 end macro from li")
def j10(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame([(0, 0), (2, 1), (3, 1)], "state int, macro int")
    return frames_li(spark, d).join(F.broadcast(table), "state", "left").select("row_id", F.coalesce("macro", F.lit(-1)).alias("macro"))


@query("l06_coarse_counts", f"with {LI}, p as (select a.state s, b.state t, a.weight w from li a join li b on b.traj_id = a.traj_id and b.frame = a.frame + 2) select 2 lag, case when s < 2 then 0 else 1 end i, case when t < 2 then 0 else 1 end j, round(sum(w), 2) count from p group by 1, 2, 3")
def l06_coarse(spark: SparkSession, d: str) -> DataFrame:
    micro = N.count_matrix(L.sequence_pairs(frames_li(spark, d), [2], ["state"]))
    mapping = spark.createDataFrame([(s, 0 if s < 2 else 1) for s in range(6)], "label int, to int")
    return rounded(N.coarsen(micro, mapping), ["count"], 2)


_CK = (
    f"with {LI}, "
    + "c as ("
    + " union all ".join(f"select {lag} lag, a.state i, b.state j, sum(a.weight) c from li a join li b on b.traj_id = a.traj_id and b.frame = a.frame + {lag} where a.weight > 0 group by 2, 3" for lag in (2, 4, 6, 8))
    + "), g as (select l.lag, a.i, b.j from (select unnest([2, 4, 6, 8]) lag) l, (select unnest([0, 1, 2, 3, 4, 5]) i) a, (select unnest([0, 1, 2, 3, 4, 5]) j) b), f as (select g.*, coalesce(c, 0) c, sum(coalesce(c, 0)) over (partition by lag, g.i) m from g left join c using (lag, i, j)), "
    "t as (select lag, i, j, case when m > 0 then (c + 1e-8) / (m + 6e-8) when i = j then 1 else 0 end p from f), p1 as (select i, j, p from t where lag = 2)"
)
for _k in (2, 3, 4):
    _CK += f", p{_k} as (select a.i, b.j, sum(a.p * b.p) p from p{_k - 1} a join p1 b on b.i = a.j group by 1, 2)"
_CK += " " + " union all ".join(f"select {k} k, round(sqrt(avg(power(t.p - p{k}.p, 2))), 8) rmsd from t join p{k} using (i, j) where lag = {2 * k}" for k in (1, 2, 3, 4))


@query("l06_chapman_kolmogorov", _CK)
def l06(spark: SparkSession, d: str) -> DataFrame:
    lags = [2, 4, 6, 8]
    rows = N.count_matrix(L.sequence_pairs(frames_li(spark, d), lags, ["state"])).collect()
    n = 1 + max(max(r["i"], r["j"]) for r in rows)
    t = {lag: K.transition(K.dense([r for r in rows if r["lag"] == lag], n, "count")) for lag in lags}
    return rounded(spark.createDataFrame(K.chapman_kolmogorov({lag // 2: t[lag] for lag in lags}, t[2]), "k int, rmsd double"), ["rmsd"], 8)


_TREES = " union all ".join(f"select {a} i, p{b}{a} * p{c}{a} + p{b}{a} * p{c}{b} + p{b}{c} * p{c}{a} w from mx" for a, b, c in ((0, 1, 2), (1, 0, 2), (2, 0, 1)))
_MATRIX = ", ".join(f"max(case when i = {i} and j = {j} then p end) p{i}{j}" for i in range(3) for j in range(3))


@query("l01_stationary", f"with {_T}, mx as (select {_MATRIX} from t), w as ({_TREES}) select i, round(w / sum(w) over (), 7) pi from w")
def l01(spark: SparkSession, d: str) -> DataFrame:
    rows = _counts(spark, d).collect()
    pi = K.stationary(K.transition(K.dense(rows, 3, "count")))
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(pi)], "i int, pi double"), ["pi"], 7)


@query("l02_implied_timescales", None)
def l02(spark: SparkSession, d: str) -> DataFrame:
    rows = N.count_matrix(L.sequence_pairs(frames_li(spark, d), [1, 2, 5], ["state"])).collect()
    n = 1 + max(max(r["i"], r["j"]) for r in rows)
    out = [(lag, k, float(v)) for lag in (1, 2, 5) for k, v in enumerate(K.implied_timescales(K.transition(K.dense([r for r in rows if r["lag"] == lag], n, "count")), lag))]
    return spark.createDataFrame(out, "lag int, k int, timescale double")


@query("l03_spectral_gaps", None)
def l03(spark: SparkSession, d: str) -> DataFrame:
    rows = N.count_matrix(L.sequence_pairs(frames_li(spark, d), [1, 2, 5], ["state"])).collect()
    n = 1 + max(max(r["i"], r["j"]) for r in rows)
    out = [(lag, g["k"], g["eigenvalue"], g["gap"], g["m"]) for lag in (1, 2, 5) for g in K.spectral_gaps(K.transition(K.dense([r for r in rows if r["lag"] == lag], n, "count")))]
    gaps = spark.createDataFrame(out, "lag int, k int, eigenvalue double, gap double, m int")
    best = gaps.groupBy("lag").agg(F.max_by("m", "gap").alias("m"), F.max("gap").alias("gap"))
    return best.groupBy("m").agg(F.count("*").alias("votes"), F.max("gap").alias("gap"))


@query("l04_memberships", None)
def l04(spark: SparkSession, d: str) -> DataFrame:
    rows = N.count_matrix(L.sequence_pairs(frames_li(spark, d), [2], ["state"])).collect()
    n = 1 + max(max(r["i"], r["j"]) for r in rows)
    t = K.transition(K.dense(rows, n, "count"))
    hard, soft = K.spectral_memberships(t, 2), K.simplex_memberships(t, 2)
    return spark.createDataFrame([(i, k, float(hard[i, k]), float(soft[i, k])) for i in range(n) for k in range(2)], "micro int, macro int, hard double, soft double")


_PW = f"{_POS}, pw as (select * from pr where weight > 0 and weight_tau > 0)"
_THR = "thr as (select 0.1e0 + 0.1e0 * k c from (select unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) k))"


def _sig(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def _flux_rows(surface: str = "qi_decrease") -> str:
    parts = []
    for i in range(3):
        for j in range(3):
            if i != j:
                chi = f"{_sig(f'(q{i} - c) / 0.02')} * {_sig(f'(c - t{i}) / 0.02')}" if surface == "qi_decrease" else f"{_sig(f'(c - q{j}) / 0.02')} * {_sig(f'(t{j} - c) / 0.02')}"
                parts.append(f"select {i} i, {j} j, c, row_id, weight w, {chi} * (t{j} * q{i} - q{j} * t{i}) x, t{j} * q{i} - q{j} * t{i} cur from pw, thr")
    return " union all ".join(parts)


_AT = [0.1 + 0.1 * k for k in range(9)]


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return L.positive_pairs(_positional(spark, d))


for _s in ("qi_decrease", "qj_increase"):
    query(
        f"a06_flux_{_s}",
        f"with {_PW}, {_THR}, f as ({_flux_rows(_s)}), g as (select i, j, c, sum(w) sw, sum(w * x) sx, sum(w * w) w2, sum(w * w * x) w2x, sum(w * w * x * x) w2xx, sum(w * cur) wc, sum(w * abs(cur)) wac from f group by 1, 2, 3) "
        "select i, j, round(c, 6) c, round(sx / sw / 2, 8) flux, round(sqrt(greatest(w2xx - 2 * (sx / sw) * w2x + (sx / sw) * (sx / sw) * w2, 0)) / sw / 2, 7) flux_std, round(wc / sw, 8) mean_current, round(wac / sw, 8) mean_abs_current from g",
    )(lambda spark, d, s=_s: rounded(rounded(rounded(X.flux_profiles(_weighted(spark, d), X.ordered_pairs(3), _AT, tau=2.0, surface=s), ["flux", "mean_current", "mean_abs_current"], 8), ["flux_std"], 7), ["c"]))


@query("a06_pair_flux", f"with {_PW}, {_THR}, f as ({_flux_rows()}), g as (select i, j, c, sum(w * x) / sum(w) v from f group by 1, 2, 3) select i, j, round(avg(v), 8) flux, round(var_pop(v), 9) flux_variance from g group by 1, 2")
def a06_pair(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(X.pair_flux(X.flux_profiles(_weighted(spark, d), X.ordered_pairs(3), _AT)), ["flux"], 8), ["flux_variance"], 9)


@query("j11_pairs_thresholds", f"with {_PW}, {_THR} select count(*)::bigint n from pw, thr, (select unnest([0, 1, 2, 3, 4, 5]) p)")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return X._terms(_weighted(spark, d), X.ordered_pairs(3), _AT, 0.02, "qi_decrease").agg(F.count("*").alias("n"))


@query("a07_populations", f"with {EMB} select state, count(*)::bigint n_frames, round(sum(weight) / sum(sum(weight)) over (), 8) pi from emb where state >= 0 group by 1")
def a07(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.populations(frames_emb(spark, d), weight="weight"), ["pi"], 8)


@query("a07_soft_populations", f"with {EMB} select 0 state, round(sum(weight * q0) / sum(weight), 8) pi from emb union all select 1, round(sum(weight * q1) / sum(weight), 8) from emb union all select 2, round(sum(weight * q2) / sum(weight), 8) from emb")
def a07_soft(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.soft_populations(frames_emb(spark, d)), ["pi"], 8)


for _n, _w in (("a08_exit_hits", "state >= 0 and state_tau != state"), ("a08_labelled_exits", "state >= 0 and state_tau != state and state_tau >= 0")):
    _rows = " union all ".join(f"select state i, {j} j, weight w, t{j} x from pw where {_w}" for j in range(3))
    query(
        _n,
        f"with {_PW}, f as ({_rows}), g as (select i, j, count(*) n, sum(w) m, sum(w * x) / sum(w) h, sum(w * w) w2, sum(w * w * x) w2x, sum(w * w * x * x) w2xx from f group by 1, 2) select i, j, n::bigint n_exits, round(m, 6) mass, round(h, 8) t_hit, round(sqrt(greatest(w2xx - 2 * h * w2x + h * h * w2, 0)) / m, 7) t_hit_std from g",
    )(lambda spark, d, only=_n.endswith("exits"): rounded(rounded(rounded(X.exit_hits(_weighted(spark, d), labelled_exits_only=only), ["mass"]), ["t_hit"], 8), ["t_hit_std"], 7))

_BLOCK = f"{_PW}, n as (select count(*) n from pw), b as (select pw.*, row_number() over (order by row_id) - 1 r, n // 10 s, n % 10 l from pw, n), pwb as (select *, case when r < l * (s + 1) then r // (s + 1) else l + (r - l * (s + 1)) // s end block from b)"


@query("a10_blocks", f"with {_BLOCK} select row_id, block::int block from pwb")
def a10_blocks(spark: SparkSession, d: str) -> DataFrame:
    return X.blocks(_weighted(spark, d), 10).select("row_id", "block")


_BROWS = _flux_rows().replace("row_id, weight w", "block, weight w").replace("from pw,", "from pwb,")


@query(
    "a10_jackknife",
    f"with {_BLOCK}, {_THR}, f as ({_BROWS}), p as (select block, i, j, c, sum(w) sw, sum(w * x) sx from f group by 1, 2, 3, 4), q as (select *, sum(sw) over z - sw lw, sum(sx) over z - sx lx from p window z as (partition by i, j, c)), v as (select block, i, j, avg(lx / lw) v from q group by 1, 2, 3) "
    "select i, j, round(avg(v), 8) flux, round(stddev_samp(v) * (count(*) - 1) / sqrt(count(*)), 8) flux_jackknife, count(*)::bigint n_blocks from v group by 1, 2",
)
def a10_jack(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.jackknife_flux(_weighted(spark, d), X.ordered_pairs(3), _AT), ["flux", "flux_jackknife"], 8)


@query("a10_slice_sem", f"with {_BLOCK}, {_THR}, f as ({_BROWS}), p as (select block, i, j, c, sum(w * x) / sum(w) v from f group by 1, 2, 3, 4), v as (select block, i, j, avg(v) v from p group by 1, 2, 3) select i, j, round(avg(v), 8) flux, round(stddev_samp(v) / sqrt(count(*)), 8) flux_sem from v group by 1, 2")
def a10_slice(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.slice_sem_flux(_weighted(spark, d), X.ordered_pairs(3), _AT), ["flux", "flux_sem"], 8)


@query("a11_nan_statistics", f"with {EV} select traj_id, round(avg(case when state >= 0 then cv1 end), 6) mean, round(stddev_samp(case when state >= 0 then cv1 end), 6) std, round(stddev_samp(case when state >= 0 then cv1 end) / sqrt(count(case when state >= 0 then cv1 end)), 6) sem from ev group by 1")
def a11(spark: SparkSession, d: str) -> DataFrame:
    """NaN where unlabelled; NaN is turned to NULL, which aggregates leave out."""
    v = F.when(F.col("state") >= 0, F.col("cv1")).otherwise(float("nan"))
    x = F.when(~F.isnan(v), v)
    return rounded(frames_ev(spark, d).groupBy("traj_id").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("sem")), ["mean", "std", "sem"])


def _rates(spark: SparkSession, d: str) -> dict:
    return rate_matrices(frames_emb(spark, d), 3, 2)


@query("x04_rate_constants", None)
def x04(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in _rates(spark, d)["table"]], "i int, j int, k double, k_direct double, mfpt double, p_jump double, std double")


_K = f"{_PW}, {_THR}, f as ({_flux_rows()}), g as (select i, j, c, sum(w * x) / sum(w) / 2 v from f group by 1, 2, 3), fl as (select i, j, avg(v) v from g group by 1, 2), pi as (select state, sum(weight) / sum(sum(weight)) over () pi from emb where state >= 0 and weight > 0 group by 1), k as (select i, j, greatest(v / pi, 0) k from fl join pi on state = i)"


@query("l07_generator", f"with {_K} select i, j, round(k, 8) rate from k union all select i, i, round(-sum(k), 8) from k group by i")
def l07(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.matrix_frame(spark, _rates(spark, d)["K"], "rate").drop("unbounded"), ["rate"], 8)


@query("l08_jump_probabilities", f"with {_PW}, {_THR}, f as ({_flux_rows()}), g as (select i, j, c, sum(w * x) / sum(w) v from f group by 1, 2, 3), fl as (select i, j, greatest(avg(v), 0) v from g group by 1, 2) select i, j, round(case when sum(v) over (partition by i) > 0 then v / sum(v) over (partition by i) else 0 end, 8) p from fl")
def l08(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.matrix_frame(spark, _rates(spark, d)["P_jump"], "p").where("i != j").drop("unbounded"), ["p"], 8)


_KM = ", ".join(f"max(case when i = {i} and j = {j} then k end) k{i}{j}" for i in range(3) for j in range(3) if i != j)
#: The passage time from i to j, by way of the third state or not: Cramer's rule on the two states left.
_MFPT = " union all ".join(
    f"select {i} i, {j} j, (k{o}{i} + k{o}{j} + k{i}{o}) / ((k{i}{j} + k{i}{o}) * (k{o}{i} + k{o}{j}) - k{i}{o} * k{o}{i}) mfpt from m"
    for i in range(3) for j in range(3) for o in range(3) if len({i, j, o}) == 3
)


@query("l09_mean_first_passage", f"with {_K}, m as (select {_KM} from k), x as ({_MFPT}) select i, j, round(mfpt, 4) mfpt from x union all select i, i, 0.0 from (select unnest([0, 1, 2]) i)")
def l09(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.matrix_frame(spark, _rates(spark, d)["MFPT"], "mfpt").drop("unbounded"), ["mfpt"], 4)


_CUT = {"enabled": True, "min_probability": 0.4}


@query("l10_edge_filter", f"with {_K}, p as (select *, k / sum(k) over (partition by i) p from k) select i, j, round(case when p < 0.4 then 0 else k end, 8) rate from p union all select i, i, 0.0 from (select unnest([0, 1, 2]) i)")
def l10(spark: SparkSession, d: str) -> DataFrame:
    """Every edge below the cut goes, whatever it connected."""
    r = rate_matrices(frames_emb(spark, d), 3, 2, edge_filter={**_CUT, "keep_reachable": False})
    return rounded(X.matrix_frame(spark, r["k_direct"], "rate").drop("unbounded"), ["rate"], 8)


@query("l10_reachable_filter", None)
def l10_reach(spark: SparkSession, d: str) -> DataFrame:
    r = rate_matrices(frames_emb(spark, d), 3, 2, edge_filter=_CUT)
    return X.matrix_frame(spark, r["k_direct"], "rate")


@query("l11_propagated_errors", None)
def l11(spark: SparkSession, d: str) -> DataFrame:
    return X.matrix_frame(spark, _rates(spark, d)["errors"]["MFPT"], "std")


@query("l12_scf_fit", None)
def l12(spark: SparkSession, d: str) -> DataFrame:
    r = _rates(spark, d)
    hits = K.dense(X.exit_hits(_weighted(spark, d)).collect(), 3, "t_hit")
    k, _ = K.fit_scf(r["k_direct"], K.branch_matrix(hits), r["pi"])
    return X.matrix_frame(spark, k, "rate")


@query("l13_state_probabilities", f"with {EMB} select row_id, round(q0, 7) p0, round(q1, 7) p1, round(q2, 7) p2 from emb")
def l13(spark: SparkSession, d: str) -> DataFrame:
    from lagwell.operators.model import reconstruct

    f = frames_emb(spark, d)
    pair = F.array(*(F.col(f"q{j}") / (F.col(f"q{i}") + F.col(f"q{j}")) for i in range(3) for j in range(i + 1, 3)))
    return reconstruct(f.select("row_id", "state", pair.alias("Q")), 3, out="p").select("row_id", *(F.round(F.col("p")[k], 7).alias(f"p{k}") for k in range(3)))


@query("l14_rate_merge", None)
def l14(spark: SparkSession, d: str) -> DataFrame:
    from lagwell.operators.relabel import merge_by_rates

    r = _rates(spark, d)
    merged, _ = merge_by_rates(frames_emb(spark, d), r["P_jump"], r["MFPT"], 0.5, 1e9)
    return merged.groupBy("state").agg(F.count("*").alias("n_frames"))


@query("o03_ranked_transitions", f"with {_T}, b as (select least(i, j) a, greatest(i, j) b, i, j, p from t where i != j), r as (select *, row_number() over (partition by a, b order by p desc, i) k from b) select i, j, round(p, 8) value from r where k = 1 and p > 0.05")
def o03(spark: SparkSession, d: str) -> DataFrame:
    from lagwell.operators.paths import ranked_transitions

    t = N.transition_matrix(_counts(spark, d), 3).select("i", "j", F.col("p").alias("value"))
    return rounded(ranked_transitions(t, 0.05), ["value"], 8)


@query("a23_mixing_scores", f"with {_T} select x.lag, x.i, x.j, round(least(x.p, y.p), 8) score from t x join t y on y.i = x.j and y.j = x.i where x.i < x.j")
def a23_mix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.mixing_scores(N.transition_matrix(_counts(spark, d), 3)), ["score"], 8)
