"""Normalised and thinned layers: gradients by finite differences of a plain whole-batch network, independence of partitions, what is kept."""

from __future__ import annotations

import numpy as np
import pytest

from lagwell.functions.committor import ACTIVATIONS, NORM_EPS, Loss, Net, flux_spread, flux_sums, losses, row_uniforms
from lagwell.operators import model as M
from lagwell.plans import workflow as W


def pairs(n=50, seed=4):
    rng = np.random.default_rng(seed)
    return [(int(i * 7 + 3), rng.normal(size=2).tolist(), rng.normal(size=2).tolist(), int(rng.integers(-1, 3)), int(rng.integers(-1, 3)), float(rng.uniform(0.5, 2))) for i in range(n)]


KIND = "row_id long, x array<double>, x_tau array<double>, label int, label_tau int, weight double"


def plain(net, rows, loss, ends, salt):
    """The loss of the whole batch, each end normalised by its own moments, by the definition."""
    ids = np.array([r[0] for r in rows])
    act = ACTIVATIONS[net.activation][0]

    def forward(x, end):
        h = np.array(x)
        thin = net.masks(ids, (*salt, end)) if net.dropout else None
        for k, (w, b) in enumerate(net.layers):
            h = h @ w + b
            if k < len(net.layers) - 1:
                if net.batch_norm:
                    h = net.norms[k][0] * (h - h.mean(0)) / np.sqrt(h.var(0) + NORM_EPS) + net.norms[k][1]
                h = act(h) * (thin[k] if thin else 1.0)
        e = np.exp(h - h.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    q, q_tau = forward([r[1] for r in rows], 0), forward([r[2] for r in rows], 1)
    w = np.array([r[5] for r in rows])
    parts, *_ = losses(q, q_tau, np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), w, loss, ends)
    total = sum(getattr(loss, k) * v for k, v in parts.items()) / w.sum()
    return total + loss.flux * flux_spread(flux_sums(q, q_tau, w, loss), w.sum())[0]


@pytest.mark.parametrize(("batch_norm", "dropout"), [(True, 0.0), (False, 0.4), (True, 0.3)])
def test_gradients_are_finite_differences(spark, batch_norm, dropout):
    rows, loss, salt = pairs(), Loss(flux=0.5, pairs=((0, 1), (2, 0)), thresholds=(0.3, 0.6)), (5, 1, 0)
    rng = np.random.default_rng(9)
    net = Net((2, 5, 4, 3), activation="tanh", batch_norm=batch_norm, dropout=dropout)
    if batch_norm:
        net.norms = [(rng.uniform(0.5, 1.5, n), rng.normal(0, 0.3, n)) for n in (5, 4)]
    df = spark.createDataFrame(rows, KIND)
    ends = M.labelled_ends(df)
    runs = [M.gradient(df.repartition(k), net, loss, ends, salt) for k in (1, 6)]
    for grads, parts, agreed in runs:
        assert sum(getattr(loss, k) * v for k, v in parts.items()) == pytest.approx(plain(net, rows, loss, ends, salt), rel=1e-9)
        flat = [g for pair in grads for g in pair]
        assert len(flat) == len(net.parameters()) and len(agreed) == (2 if batch_norm else 0)
        for p, g in zip(net.parameters(), flat, strict=True):
            for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(4)]:
                was, h = p[at], 1e-5
                p[at] = was + h
                up = plain(net, rows, loss, ends, salt)
                p[at] = was - h
                down = plain(net, rows, loss, ends, salt)
                p[at] = was
                assert g[at] == pytest.approx((up - down) / (2 * h), rel=2e-4, abs=2e-7)
    assert all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for u, v in zip(runs[0][0], runs[1][0], strict=True) for a, b in zip(u, v, strict=True))


def test_training_with_normalised_and_thinned_layers(spark, tmp_path):
    rng, rows = np.random.default_rng(2), []
    for i in range(160):
        side = i % 2
        x = rng.normal([3.0 * (2 * side - 1), 40.0], [1.0, 5.0])  # a scale that plain layers find hard
        rows.append((i, x.tolist(), (x + rng.normal(0, 0.3, 2)).tolist(), side, side, 1.0))
    df = spark.createDataFrame(rows, KIND)
    fitted = []
    for n in (1, 4):
        net, history = M.train(df.repartition(n), Net((2, 6, 2), batch_norm=True, dropout=0.1), Loss(flux=0.0), epochs=25, rate=0.05, last=str(tmp_path / f"last{n}.npz"))
        fitted.append((net, [h["train"] for h in history], [h["validation"] for h in history]))
    assert np.allclose(fitted[0][1], fitted[1][1], rtol=1e-7) and np.allclose(fitted[0][2], fitted[1][2], rtol=1e-7)
    net = fitted[0][0]
    q = net(np.array([r[1] for r in rows]))
    assert (q.argmax(1) == np.array([r[3] for r in rows])).mean() > 0.97 and fitted[0][2][-1] < 0.5 * fitted[0][2][0]
    assert abs(net.running[0][0]).max() > 0.1  # the running moments followed the steps
    back, _ = Net.load(str(tmp_path / "last1.npz"))
    table = W.read_net(W.net_table(spark, net))
    assert back.batch_norm and back.dropout == 0.1 and np.allclose(table(np.ones((3, 2))), net(np.ones((3, 2)))) and table.dropout == 0.1
    x = np.array([[0.4, 38.0]])
    _, g = net.value_and_input_gradient(x, 1)
    for k in range(2):
        h = np.eye(2)[k] * 1e-5
        assert g[0, k] == pytest.approx((net(x + h)[0, 1] - net(x - h)[0, 1]) / 2e-5, rel=1e-4, abs=1e-9)


def test_masks_follow_the_rows():
    net = Net((2, 400, 2), dropout=0.25)
    ids = np.arange(300)
    (mask,) = net.masks(ids, (1, 2))
    assert set(np.unique(mask)) == {0.0, 1 / 0.75} and abs((mask > 0).mean() - 0.75) < 0.01
    order = np.random.default_rng(0).permutation(300)
    assert np.array_equal(net.masks(ids[order], (1, 2))[0], mask[order]) and not np.array_equal(net.masks(ids, (1, 3))[0], mask)
    u = row_uniforms(ids, 50, 3)
    assert 0 < u.min() < u.max() < 1 and abs(u.mean() - 0.5) < 0.02
    with pytest.raises(ValueError, match="dropout"):
        Net((2, 2), dropout=1.0)


def test_gradient_of_no_rows(spark):
    net = Net((2, 4, 3), batch_norm=True)
    grads, parts, _ = M.gradient(spark.createDataFrame([], KIND), net, Loss(flux=0.0), 0.0, (0, 0, 0))
    assert all((g == 0).all() for pair in grads for g in pair) and parts == {"dirichlet": 0.0, "boundary": 0.0, "simplex": 0.0, "flux": 0.0}
