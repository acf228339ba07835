"""Fitting rules: gradients against finite differences, passes against NumPy over the same rows."""

from __future__ import annotations

import numpy as np
import pytest

from windrow.operators import fuzzy, training
from windrow.operators.fuzzy import Rule
from windrow.operators.training import Parameters

FEATURES = ["u", "v"]


def some_rules(rng, n, classes):
    return [Rule(tuple(rng.uniform(0.2, 0.5, 2)), tuple(rng.uniform(1, 2.5, 2)), tuple(rng.uniform(0, 1, 2)), tuple(map(tuple, rng.normal(size=(3, classes))))) for _ in range(n)]


def some_rows(rng, n, classes):
    x = rng.random((n, 2))
    y = (x[:, 0] * classes).astype(int) if classes > 1 else (x.sum(axis=1) > 1).astype(int)
    return x, np.where(rng.random(n) < 0.1, rng.integers(0, max(classes, 2), n), y)


def table(spark, x, y):
    return spark.createDataFrame([(k, float(a), float(b), int(c)) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id long, u double, v double, label int")


@pytest.mark.parametrize("classes, loss", [(3, training.cross_entropy), (1, training.binary_entropy)])
def test_gradients_are_finite_differences(classes, loss):
    rng = np.random.default_rng(1)
    p = Parameters.of(some_rules(rng, 4, classes))
    x, y = some_rows(rng, 60, classes)
    x[0] = p.c[0]  # a row at a rule's centre
    weights = np.array([1.0, 0.7, 2.0])
    value, _, by = training.gradient(p, x, y, weights, loss)
    raw = p.raw()
    assert np.allclose(p.of_raw(raw).flat(), p.flat(), rtol=1e-9)
    got = p.by_raw(by.flat())
    for k in range(len(raw)):
        step = np.zeros(len(raw))
        step[k] = 1e-6
        up, down = (loss(training.outputs(p.of_raw(raw + s), x)[0], y, weights)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - got[k]) < 2e-5 * max(1, abs(got[k])), k
    assert value > 0


def test_outputs_are_those_of_the_expressions(spark):
    rng = np.random.default_rng(2)
    rules = some_rules(rng, 3, 3)
    x, y = some_rows(rng, 50, 3)
    df = fuzzy.predict(table(spark, x, y), FEATURES, rules, floor=1e-12).orderBy("id")
    want = np.array([[r["y0"], r["y1"], r["y2"]] for r in df.collect()])
    assert np.allclose(training.outputs(Parameters.of(rules), x)[0], want, rtol=1e-12)


def adam_by_hand(p, batches, weights, loss, rate, decay):
    """Parameters after one step a batch, by NumPy over whole batches."""
    raw = p.raw()
    m = v = np.zeros(len(raw))
    for t, (x, y) in enumerate(batches, 1):
        _, count, by = training.gradient(p, x, y, weights, loss)
        g = p.by_raw(by.flat() / count) + decay * raw
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        raw = raw - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        p = p.of_raw(raw)
    return p


@pytest.mark.parametrize("classes", [3, 1])
def test_gradient_passes_equal_numpy(spark, classes):
    rng = np.random.default_rng(3)
    rules = some_rules(rng, 3, classes)
    x, y = some_rows(rng, 200, classes)
    rows = table(spark, x, y)
    fitted = training.by_gradients(rows, rows, FEATURES, "label", rules, classes, key="id", rate=0.02, passes=2, steps=4, seed=9)
    batch = {r["id"]: r["_batch"] for r in training.in_batches(rows, "id", 4, 9).collect()}
    place = np.array([batch[k] for k in range(200)])
    order = np.random.default_rng(9)
    batches = [(x[place == k], y[place == k]) for _ in range(2) for k in order.permutation(4)]
    counts = np.bincount(y, minlength=2)
    weights = np.array([1, counts[0] / counts[1]]) if classes == 1 else 200 / (classes * np.maximum(np.bincount(y, minlength=classes), 1))
    want = adam_by_hand(Parameters.of(rules), batches, weights, training.binary_entropy if classes == 1 else training.cross_entropy, 0.02, 1e-4)
    assert fitted.best == 2 and fitted.held_loss[1] < fitted.held_loss[0]
    assert np.allclose(Parameters.of(fitted.rules).flat(), want.flat(), rtol=1e-8)
    again = training.by_gradients(rows, rows, FEATURES, "label", rules, classes, key="id", rate=0.02, passes=2, steps=4, seed=9)
    assert np.allclose(Parameters.of(again.rules).flat(), want.flat(), rtol=1e-8)


def test_hybrid_improves_on_least_squares_and_stops(spark):
    rng = np.random.default_rng(4)
    x, y = some_rows(rng, 400, 3)
    rows, held = table(spark, x[:300], y[:300]), table(spark, x[300:], y[300:])
    rules = fuzzy.rules_at([[0.1, 0.5], [0.8, 0.5]], 3)
    once = fuzzy.fit_consequents(rows, FEATURES, rules, "label", 3)
    fitted = training.hybrid(rows, held, FEATURES, "label", rules, 3, rate=0.05, passes=8, patience=3)
    weights = training.class_weights(rows, "label", 3)
    first = training.cross_entropy(training.outputs(Parameters.of(once), x[300:])[0], y[300:], weights)
    assert min(fitted.held_loss) < first[0] / first[1] and fitted.held_loss[fitted.best - 1] == min(fitted.held_loss)
    stopped = training.hybrid(rows, held, FEATURES, "label", rules, 3, rate=0.0, passes=30, patience=2)
    assert len(stopped.held_loss) == 3 and stopped.best == 1  # nothing gets better without a rate
    by_steps = training.hybrid(rows, held, FEATURES, "label", rules, 3, rate=0.05, passes=2, steps=3, key="id")
    assert len(by_steps.train_loss) == 2


def test_no_rows(spark):
    rows = table(spark, np.zeros((0, 2)), np.zeros(0, int))
    fitted = training.hybrid(rows, rows, FEATURES, "label", fuzzy.rules_at([[0.2, 0.2]], 2), 2, passes=2)
    assert fitted.rules[0].c == (0.2, 0.2) and fitted.held_loss[0] == 0.0
