"""Committor training and inference over DataFrames."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.functions.arrays import total
from lagwell.functions.committor import AdamW, Loss, Net, Train, boundary_weight, flux_spread, flux_sums, partial_gradient
from lagwell.functions.kinetics import pairwise_design
from lagwell.plans.lineage import materialize


def infer(df: DataFrame, net: Net, x: str = "x", out: str = "q") -> DataFrame:
    """Add the network's outputs, one Arrow batch at a time in float32 inputs and double maths."""
    schema = df.withColumn(out, F.array(F.lit(0.0))).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            q = net(np.array(batch[x].tolist(), np.float32)) if len(batch) else np.zeros((0, 1))
            yield batch.assign(**{out: list(q)})

    return df.mapInPandas(run, schema)


def labelled_ends(rows: DataFrame) -> float:
    """The weight of labelled ends as a multiple of the weight of the rows ``(label, label_tau, weight)``."""
    end = lambda c: F.when(F.col(c) >= 0, F.col("weight")).otherwise(0.0)
    got = rows.agg(F.sum(end("label") + end("label_tau")).alias("ends"), F.sum("weight").alias("mass")).first()
    return (got["ends"] or 0.0) / got["mass"] if got["mass"] else 0.0


def boundary_loss(rows: DataFrame, q: str = "q", label: str = "state", weight: str = "weight", mode: str = "cross_entropy") -> DataFrame:
    """One row, ``boundary``: the weighted mean over labelled rows of cross entropy or squared distance to the label; NULL without any."""
    own = F.greatest(F.get(q, F.col(label).cast("int")), F.lit(1e-12))
    gap = F.aggregate(q, F.lit(0.0), lambda s, v: s + v * v) - 2 * F.get(q, F.col(label).cast("int")) + 1
    value = -F.ln(own) if mode == "cross_entropy" else gap
    held = rows.where(F.col(label) >= 0)
    return held.agg((F.sum(F.col(weight) * value) / F.sum(weight)).alias("boundary"))


def _arrays(b: pd.DataFrame) -> tuple[np.ndarray, ...]:
    return *(np.array(b[c].tolist()) for c in ("x", "x_tau", "label", "label_tau")), b.weight.to_numpy()


def _summed(rows: DataFrame, of: Callable[[pd.DataFrame], list[np.ndarray]]) -> list[np.ndarray] | None:
    """The sums over all batches of a list of arrays; each task adds its own first, so one row a task reaches the driver. None of no rows."""
    names = ["row_id", "x", "x_tau", "label", "label_tau", "weight"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: list[np.ndarray] | None = None
        for b in batches:
            if len(b):
                found = of(b)
                total = found if total is None else [u + v for u, v in zip(total, found, strict=True)]
        if total is not None:
            yield pd.DataFrame({"flat": [np.concatenate([np.ravel(t) for t in total])], "shapes": [[",".join(map(str, np.shape(t))) for t in total]]})

    got = rows.select(*names).mapInPandas(run, "flat array<double>, shapes array<string>").collect()
    if not got:
        return None
    flat, out, at = np.sum([r["flat"] for r in got], axis=0), [], 0
    for shape in got[0]["shapes"]:
        size = [int(v) for v in shape.split(",") if v]
        n = int(np.prod(size)) if size else 1
        out.append(flat[at : at + n].reshape(size))
        at += n
    return out


def gradient(rows: DataFrame, net: Net, loss: Loss, ends: float, salt: tuple[int, ...] | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], dict[str, float], list[tuple[list, float]]]:
    """(gradient of each pair of parameters, parts of the loss, moments and rows of each end) over all ``rows``, whatever their partitioning.

    With ``salt`` the network is in training: a pass for the moments of each
    normalised layer from below, one for the sums that its gradient needs
    from above, and one for the gradient. Both ends have moments of their own.
    """
    training = salt is not None and (net.batch_norm or net.dropout > 0)
    state = tuple(Train([], (*salt, end)) for end in (0, 1)) if training else None
    n = 0.0

    def ids(b: pd.DataFrame) -> np.ndarray | None:
        return b.row_id.to_numpy() if training else None

    for _ in net.norms if training else ():

        def moments(b: pd.DataFrame) -> list[np.ndarray]:
            x, x_tau, *_ = _arrays(b)
            z = [net.linear(v, end, ids(b)) for v, end in zip((x, x_tau), state, strict=True)]
            return [np.array([len(b)]), *(s for v in z for s in (v.sum(0), (v * v).sum(0)))]

        got = _summed(rows, moments) or [np.ones(1), *(np.zeros_like(net.running[len(state[0].moments)][0]) for _ in range(4))]
        n = float(got[0][0])
        for end, one, two in ((state[0], got[1], got[2]), (state[1], got[3], got[4])):
            end.moments.append((one / n, np.maximum(two / n - (one / n) ** 2, 0.0)))
    spread, slope = 0.0, None
    if loss.flux and loss.pairs:

        def crossings(b: pd.DataFrame) -> list[np.ndarray]:
            x, x_tau, _, _, w = _arrays(b)
            one, two = state or (None, None)
            return [flux_sums(net(x, one, ids(b)), net(x_tau, two, ids(b)), w, loss), np.array([w.sum()])]

        got = _summed(rows, crossings) or [np.zeros((len(loss.pairs), len(loss.thresholds))), np.zeros(1)]
        spread, slope = flux_spread(got[0], float(got[1][0]) or 1.0)

    def partial(b: pd.DataFrame) -> list[np.ndarray]:
        g, parts, mass = partial_gradient(net, *_arrays(b), loss, ends, slope, state, ids(b))
        return [*(a for pair in g for a in pair), np.array([parts.get(k, 0.0) for k in ("dirichlet", "boundary", "simplex")]), np.array([mass])]

    for layer in range(len(net.norms) - 1, -1, -1) if training else ():
        got = _summed(rows, partial) or [np.zeros_like(net.norms[layer][0])] * 4
        state[0].sums[layer], state[1].sums[layer] = (got[0], got[1], n), (got[2], got[3], n)
    got = _summed(rows, partial) or [*(np.zeros_like(p) for wb in net.layers for p in wb), np.zeros(3), np.zeros(1)]
    mass = float(got[-1][0]) or 1.0
    grads = [(got[2 * k] / mass, got[2 * k + 1] / mass) for k in range(len(net.layers))]
    if training:
        grads += [(sum(end.sums[k][1] for end in state) / mass, sum(end.sums[k][0] for end in state) / mass) for k in range(len(net.norms))]
    parts = dict(zip(("dirichlet", "boundary", "simplex"), (got[-2] / mass).tolist(), strict=True)) | {"flux": spread}
    return grads, parts, [(end.moments, n) for end in state] if training and net.batch_norm else []


def _advance(net: Net, optimiser: AdamW, grads: list, agreed: list[tuple[list, float]]) -> None:
    for moments, n in agreed:
        net.follow(moments, n)
    optimiser.step(net, grads)


def train(pairs: DataFrame, net: Net, loss: Loss, *, epochs: int = 50, rate: float = 1e-2, patience: int = 30, validation: float = 0.2, seed: int = 0, schedule: str = "fixed", final_boundary: float | None = None, decay_epochs: float = 100.0, batches: int = 1, last: str | None = None) -> tuple[Net, list[dict]]:
    """(best network, history) by AdamW: each partition sends one partial gradient, added on the driver.

    ``pairs`` holds ``row_id x x_tau label label_tau weight``; a hash of the
    row id decides which rows validate and, with several ``batches`` an epoch,
    which batch a row is in (another hash each epoch). The boundary part is
    the mean over labelled ends; the flux part is summed over all rows of a
    batch before its gradient is taken, so neither depends on the
    partitioning. Early stop after ``patience`` epochs without a better
    validation loss. A network with normalised or thinned layers is trained
    by passes that agree on each layer's moments, and then on what its
    gradient needs, over all rows of a step before the gradient itself is
    taken; what is thinned follows from the row ids. ``last`` names a file that gets the network after every
    epoch.
    """
    from dataclasses import replace

    held = materialize(pairs.withColumn("_val", F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(1000)) < int(1000 * validation)))
    optimiser, history = AdamW(rate), []
    best, best_value, waited = copy.deepcopy(net), np.inf, 0
    learn, tested = held.where("not _val"), held.where("_val")
    ends = {kind: 2.0 if loss.pairwise else labelled_ends(rows) for kind, rows in (("learn", learn), ("tested", tested))}
    value = lambda p, part: sum(getattr(part, k) * v for k, v in p.items())
    for epoch in range(epochs):
        now = replace(loss, boundary=boundary_weight(epoch + 1, loss.boundary, loss.boundary if final_boundary is None else final_boundary, schedule, 1, decay_epochs))
        grads, parts, agreed = gradient(learn, net, now, ends["learn"], (seed, epoch, 0))
        check = gradient(tested, net, now, ends["tested"])[1] if validation else parts
        history.append({"epoch": epoch, "train": value(parts, now), "validation": value(check, now), **parts})
        if history[-1]["validation"] < best_value:
            best, best_value, waited = copy.deepcopy(net), history[-1]["validation"], 0
        else:
            waited += 1
            if waited > patience:
                break
        if batches == 1:
            _advance(net, optimiser, grads, agreed)
        for k in range(batches if batches > 1 else 0):
            part = learn.where(F.pmod(F.xxhash64("row_id", F.lit(seed), F.lit(epoch + 1)), F.lit(batches)) == k)
            step, _, seen = gradient(part, net, now, ends["learn"] if loss.pairwise else labelled_ends(part), (seed, epoch, k + 1))
            _advance(net, optimiser, step, seen)
        if last:
            net.save(last, {"epoch": epoch})
    net.__dict__.update(best.__dict__)
    return net, history


def reconstruct(df: DataFrame, n_states: int, pair_q: str = "Q", out: str = "q", anchor: int = 0, eps: float = 1e-4) -> DataFrame:
    """State probabilities from pair-wise committors: softmax of logit(Q) times the design's pseudo-inverse, anchor 0; all in the JVM."""
    _, pinv = pairwise_design(n_states, anchor)
    clipped = F.transform(pair_q, lambda v: F.least(F.greatest(v, F.lit(eps)), F.lit(1 - eps)))
    logit = F.transform(clipped, lambda v: F.ln(v / (1 - v)))
    rows = [total(F.zip_with("_logit", F.array(*map(F.lit, map(float, row))), lambda a, b: a * b)) for row in pinv]
    rows.insert(anchor, F.lit(0.0))
    scored = df.withColumn("_logit", logit).withColumn("_s", F.array(*rows))
    e = F.transform("_s", lambda s: F.exp(s - F.array_max("_s")))
    return scored.withColumn("_e", e).withColumn(out, F.transform("_e", lambda v: v / total(F.col("_e")))).drop("_logit", "_s", "_e")


def reactive_weights(df: DataFrame, n_states: int) -> DataFrame:
    """``(row_id, i, j, r)`` with r = q_i q_j, i < j."""
    options = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.get("q", F.lit(i)) * F.get("q", F.lit(j))).alias("r")) for i in range(n_states) for j in range(i + 1, n_states)))
    return df.select("row_id", F.inline(options))
