"""Training by epochs against a loop over the same minibatches."""

import hashlib
import random

import numpy as np
import pytest

from wavemill.operators import training as tr


def data(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    y = (x @ [1.5, -1.0, 0.5, 0.0, 0.0] + rng.normal(0, 0.7, n) > 0.8).astype(int)
    return [(int(i), [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, x array<double>, binary_label int").repartition(5)


def average_precision(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    total, seen, hits, at = 0.0, 0, 0, 0
    while at < len(y):
        end = at + int(np.sum(s[at:] == s[at]))
        p = int(y[at:end].sum())
        seen, hits = end, hits + p
        total += p * hits / seen
        at = end
    return total / y.sum()


def brute(train, validation, settings):
    """(weights, best weights, best epoch, last epoch) by a plain loop."""
    batch = [int(hashlib.md5(f"{settings.seed}/{i}".encode()).hexdigest()[:8], 16) % settings.steps for i, _, _ in train]
    x, y = np.array([r[1] for r in train]), np.array([r[2] for r in train], float)
    vx, vy = np.array([r[1] for r in validation]), np.array([r[2] for r in validation])
    w, m, v, t = np.zeros(6), np.zeros(6), np.zeros(6), 0
    best, best_value, best_epoch, wait = None, None, 0, 0
    for epoch in range(settings.epochs):
        order = list(range(settings.steps))
        random.Random(f"{settings.seed}/{epoch}").shuffle(order)
        for b in order:
            own = np.array(batch) == b
            weight = np.where(y[own] > 0, settings.positive_weight, 1.0)
            off = weight * (1 / (1 + np.exp(-(x[own] @ w[:5] + w[5]))) - y[own])
            g = np.append(off @ x[own], off.sum()) / weight.sum()
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w[:5] *= 1 - settings.rate * settings.decay
            w = w - settings.rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        value = average_precision(vy, 1 / (1 + np.exp(-(vx @ w[:5] + w[5]))))
        if best is None or value > best_value + settings.min_delta:
            best, best_value, best_epoch, wait = w.copy(), value, epoch + 1, 0
        else:
            wait += 1
        if wait >= settings.patience:
            break
    return w, best, best_epoch, epoch + 1


def test_epochs_equal_a_loop(spark, tmp_path):
    train, validation = data(), data(200, 2)
    settings = tr.Settings(epochs=12, steps=3, rate=0.3, patience=2, min_delta=1e-3, positive_weight=2.0)
    path = f"file://{tmp_path}/states"
    state = tr.train(frame(spark, train), frame(spark, validation), "id", "x", settings, path)
    w, best, best_epoch, last = brute(train, validation, settings)
    assert (state.best_epoch, state.epoch) == (best_epoch, last) and state.stopped and last < 12
    assert np.allclose(state.weights, w, atol=1e-8) and np.allclose(state.best, best, atol=1e-8)
    assert [h[0] for h in state.history] == list(range(1, last + 1)) and state.history[-1][1] < state.history[0][1]
    # A training that stopped early is over; its state is what was stored.
    again = tr.train(frame(spark, train), frame(spark, validation), "id", "x", settings, path)
    assert again == tr.stored_state(spark, path) == state


def test_training_goes_on(spark, tmp_path):
    train, validation = data(), data(200, 2)
    path = f"file://{tmp_path}/states"
    half = tr.Settings(epochs=2, steps=2, patience=99)
    whole = tr.Settings(epochs=4, steps=2, patience=99)
    tr.train(frame(spark, train), frame(spark, validation), "id", "x", half, path)
    # A folder without its mark was being written when the driver went.
    (tmp_path / "states/epoch=3").mkdir()
    resumed = tr.train(frame(spark, train), frame(spark, validation), "id", "x", whole, path)
    at_once = tr.train(frame(spark, train), frame(spark, validation), "id", "x", whole)
    assert resumed.epoch == 4 and np.allclose(resumed.weights, at_once.weights, atol=1e-9) and resumed.best_epoch == at_once.best_epoch


def test_one_class_and_no_rows(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(20)] + [(99, [1.0, 1.0], None)]
    state = tr.train(frame(spark, rows), frame(spark, rows), "id", "x", tr.Settings(epochs=3, steps=2, patience=2))
    assert state.best_value is None and state.stopped and state.best_epoch == 1
    none = tr.train(frame(spark, []), frame(spark, []), "id", "x", tr.Settings(epochs=1, steps=2))
    assert none.weights == [0.0] and none.epoch == 1


def test_patience():
    state = tr.State([0.0], [0.0], [0.0])
    for value in (0.5, 0.6, 0.60005, None):
        tr.after_epoch(state, 1.0, value, tr.Settings(patience=2))
    assert (state.best_epoch, state.best_value, state.stopped, state.epoch) == (2, 0.6, True, 4)
    assert pytest.approx(0.6) == state.best_value
