"""Label diagnostics: confidence, lagged entropy, uncertainty classes, state statistics, relabel hints."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwell.functions.arrays import argmax, dot, entropy_norm, gini_confidence, own, top_two
from lagwell.operators.lag import keyed_pairs


@dataclass(frozen=True)
class Cuts:
    """Limits of the uncertainty classes."""

    entropy: float = 0.6
    consistency: float = 0.5
    lagged_entropy: float = 0.6
    q_max: float = 0.6
    second: float = 0.2
    margin: float = 0.2
    entropy_drop: float = 0.15
    lagged_q_max: float = 0.8


def scores(df: DataFrame) -> DataFrame:
    """Add ``q_max q_argmax entropy confidence gini q_own top2 margin`` from ``q`` and ``state``."""
    q = F.col("q")
    first, second = top_two(q)
    return df.select("*", F.array_max(q).alias("q_max"), argmax(q).alias("q_argmax"), entropy_norm(q).alias("entropy"), (1 - entropy_norm(q)).alias("confidence"), gini_confidence(q).alias("gini"), own(q, F.col("state")).alias("q_own"), second.alias("top2"), (first - second).alias("margin"))


def lagged_scores(scored: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Add ``lag_entropy``, ``lag_q_max`` and ``n_lags``: means over the lags at which the partner frame exists."""
    pairs = keyed_pairs(scored.select("row_id", "traj_id", "frame", "entropy", "q_max"), lags, ["entropy", "q_max"])
    mean = pairs.groupBy("row_id").agg(F.avg("entropy_tau").alias("lag_entropy"), F.avg("q_max_tau").alias("lag_q_max"), F.count("*").alias("n_lags"))
    return scored.join(mean, "row_id", "left")


def uncertainty_class(cuts: Cuts = Cuts()) -> Column:  # noqa: B008
    """stable < unresolved < missed < transition < mislabeled; the last that applies."""
    h, lag_h = F.col("entropy"), F.coalesce(F.col("lag_entropy"), F.col("entropy"))
    two = (F.col("top2") >= cuts.second) & (F.col("margin") <= cuts.margin)
    mislabeled = (F.col("q_own") < cuts.consistency) & (F.col("q_argmax") != F.col("state")) & (F.col("q_max") >= cuts.q_max)
    transition = (h >= cuts.entropy) & two & (h - lag_h >= cuts.entropy_drop) & (F.coalesce("lag_q_max", "q_max") >= cuts.lagged_q_max)
    missed = (h >= cuts.entropy) & (lag_h >= cuts.lagged_entropy) & (F.col("q_max") < cuts.q_max) & ~two
    unresolved = (h >= cuts.entropy) | (F.col("q_own") < cuts.consistency)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(mislabeled), "mislabeled").when(yes(transition), "transition").when(yes(missed), "missed").when(yes(unresolved), "unresolved").otherwise("stable")


def state_statistics(classed: DataFrame, low: float = 0.5) -> DataFrame:
    """Per labelled state: own-q and entropy means and medians, share of low consistency, class shares, commonest class (first name on ties)."""
    kinds = ("mislabeled", "missed", "stable", "transition", "unresolved")
    share = [F.avg(F.when(F.col("class") == k, 1.0).otherwise(0.0)).alias(f"share_{k}") for k in kinds]
    s = classed.where("state >= 0").groupBy("state").agg(F.count("*").alias("n_frames"), F.avg("q_own").alias("mean_q_own"), F.percentile("q_own", 0.5).alias("median_q_own"), F.avg(F.when(F.col("q_own") < low, 1.0).otherwise(0.0)).alias("low_share"), F.avg("entropy").alias("mean_entropy"), F.percentile("entropy", 0.5).alias("median_entropy"), F.avg("lag_entropy").alias("mean_lag_entropy"), *share)
    best = F.array_min(F.array(*(F.struct((-F.col(f"share_{k}")).alias("s"), F.lit(k).alias("k")) for k in kinds)))
    return s.withColumn("primary_class", best.k)


def relabel_hints(classed: DataFrame, low: float = 0.5) -> DataFrame:
    """Per state: the commonest argmax among its frames of low consistency, and a suggestion."""
    weak = classed.where((F.col("state") >= 0) & (F.col("q_own") < low) & (F.col("q_argmax") != F.col("state"))).groupBy("state", "q_argmax").count()
    top = weak.groupBy("state").agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("q_argmax"))).alias("t"))
    n = classed.where("state >= 0").groupBy("state").agg(F.count("*").alias("n_frames"), F.avg(F.when(F.col("q_own") < low, 1.0).otherwise(0.0)).alias("low_share"), F.avg("entropy").alias("mean_entropy"))
    out = n.join(top, "state", "left").select("state", "n_frames", "low_share", "mean_entropy", F.col("t.q_argmax").alias("alternative"), F.coalesce(-F.col("t.n"), F.lit(0)).alias("n_alternative"))
    hint = F.when((F.col("low_share") >= 0.5) & (F.col("n_alternative") >= 0.5 * F.col("low_share") * F.col("n_frames")), "merge").when(F.col("low_share") >= 0.5, "split").when(F.col("mean_entropy") >= 0.6, "shrink").otherwise("keep")
    return out.withColumn("hint", hint)


def label_kinetics(df: DataFrame, lags: Sequence[int], least_pairs: int = 1) -> DataFrame:
    """Retention and q autocorrelation of each label and lag, over pairs that start in the label.

    Autocorrelation: weighted mean of (q - m).(q_tau - m) over that of
    |q - m|^2, m the label's weighted mean q.
    """
    long = df.where("state >= 0 and weight > 0").select("state", "weight", F.posexplode("q").alias("k", "v")).groupBy("state", "k").agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("m"))
    means = long.groupBy("state").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s.m).alias("m"))
    pairs = keyed_pairs(df.select("row_id", "traj_id", "frame", "state", "weight", "q"), lags, ["state", "q"]).where("state >= 0 and weight > 0").join(F.broadcast(means), "state")
    a, b = (F.zip_with(c, "m", lambda x, y: x - y) for c in ("q", "q_tau"))
    w = F.col("weight")
    s = pairs.groupBy("state", "lag").agg(F.count("*").alias("n_pairs"), (F.sum(F.when(F.col("state") == F.col("state_tau"), w).otherwise(0.0)) / F.sum(w)).alias("retention"), F.sum(w * dot(a, b)).alias("ab"), F.sum(w * dot(a, a)).alias("aa"))
    enough = F.col("n_pairs") >= least_pairs
    return s.select("state", "lag", "n_pairs", F.when(enough, F.col("retention")).alias("retention"), F.when(enough & (F.col("aa") > 0), F.col("ab") / F.col("aa")).alias("autocorrelation"))


def component_exchange(df: DataFrame, lags: Sequence[int], component: str = "component") -> DataFrame:
    """Per label and lag: the largest off-diagonal transition between the label's components."""
    pairs = keyed_pairs(df.select("row_id", "traj_id", "frame", "state", "weight", component), lags, ["state", component]).where("state >= 0 and state = state_tau and weight > 0")
    c = pairs.groupBy("state", "lag", F.col(component).alias("i"), F.col(f"{component}_tau").alias("j")).agg(F.sum("weight").alias("w"))
    p = c.withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("state", "lag", "i")))
    return p.groupBy("state", "lag").agg(F.coalesce(F.max(F.when(F.col("i") != F.col("j"), F.col("p"))), F.lit(0.0)).alias("max_exchange"))


def entropy_candidates(scored: DataFrame, lags: Sequence[int], high: float = 0.6, low: float = 0.3, fraction: float = 0.5) -> DataFrame:
    """Candidates (entropy >= high) by their entropy later on: missing, transition, unresolved, or review without a partner."""
    cand = scored.where(F.col("entropy") >= high).select("row_id", "traj_id", "frame", "weight", "entropy", "q_max")
    later = scored.select("traj_id", F.col("frame").alias("_at"), F.col("entropy").alias("h"))
    starts = cand.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("_at", F.col("frame") + F.col("lag"))
    hits = starts.join(later, ["traj_id", "_at"]).groupBy("row_id").agg(F.count("*").alias("n_valid"), F.count_if(F.col("h") >= high).alias("n_high"), F.count_if(F.col("h") <= low).alias("n_low"), F.avg("h").alias("mean_lag_entropy"))
    out = cand.join(hits, "row_id", "left").fillna(0, ["n_valid", "n_high", "n_low"])
    kind = F.when(F.col("n_valid") == 0, "review").when(F.col("n_high") >= fraction * F.col("n_valid"), "missing").when(F.col("n_low") >= fraction * F.col("n_valid"), "transition").otherwise("unresolved")
    score = F.col("entropy") * F.when(F.col("n_valid") > 0, F.col("n_high") / F.col("n_valid")).otherwise(0.0) * (1 - F.col("q_max")) * F.col("weight")
    return out.withColumn("kind", kind).withColumn("score", score)


def consistent_states(scored: DataFrame, low: float = 0.5, high_entropy: float = 0.6, problem_cut: float = 0.9, stable_cut: float = 0.5) -> DataFrame:
    """Per state: problem and stable shares, and whether it stays (problem < cut and stable >= cut)."""
    problem = (F.col("q_own") < low) | (F.col("entropy") >= high_entropy)
    stable = (F.col("q_own") >= low) & (F.col("entropy") < high_entropy)
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    s = scored.where("state >= 0").groupBy("state").agg(F.count("*").alias("n_frames"), one(problem).alias("problem_share"), one(stable).alias("stable_share"))
    return s.withColumn("kept", (F.col("problem_share") < problem_cut) & (F.col("stable_share") >= stable_cut))


def remove_states(df: DataFrame, judged: DataFrame) -> DataFrame:
    """Frames of removed states become -1."""
    return df.join(F.broadcast(judged.where("not kept").select("state", F.lit(True).alias("_gone"))), "state", "left").withColumn("state", F.when(F.col("_gone"), -1).otherwise(F.col("state"))).drop("_gone")


def boundary_summary(scored: DataFrame) -> DataFrame:
    """Per labelled state: argmax accuracy, mean own q, mean entropy."""
    return scored.where("state >= 0").groupBy("state").agg(F.count("*").alias("n_frames"), F.avg(F.when(F.col("q_argmax") == F.col("state"), 1.0).otherwise(0.0)).alias("accuracy"), F.avg("q_own").alias("mean_q_own"), F.avg("entropy").alias("mean_entropy"))


def core_predicate(own_cut: float = 0.8, require_argmax: bool = True, own_low: bool = False) -> Column:
    """High-confidence members of a basin: own q at the cut or above (or, ``own_low``, at most the cut)."""
    q = F.col("q_own")
    good = q <= own_cut if own_low else q >= own_cut
    return F.coalesce(good & (F.col("q_argmax") == F.col("state")) if require_argmax and not own_low else good, F.lit(False))


#: Codes of the review categories, in the order in which later ones win.
REVIEW = ("stable", "high entropy", "transition", "missing", "unresolved", "shell", "new core", "removed", "changed")


def review_category(flags: Sequence[str], old: str = "state", new: str = "new_state") -> Column:
    """0..8: the last flag that is set decides, and any changed label is 8."""
    out = F.lit(0)
    for code, flag in enumerate(flags, 1):
        out = F.when(F.col(flag), code).otherwise(out)
    return F.when(F.col(old) != F.col(new), len(REVIEW) - 1).otherwise(out)
