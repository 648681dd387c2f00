"""Attacks, hardened models, the packed ensemble, and rows that cannot be trained on."""

import numpy as np
import pytest

from ledgerloom.operators import robust, training

ROWS = "bank bigint, x array<double>, y int"


def weak_inputs(seed=0, n=600):
    """One strong input and twenty weak ones that a small shift turns round."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    side = (2 * y - 1)[:, None]
    return np.hstack([1.5 * side + rng.normal(0, 0.6, (n, 1)), 0.25 * side + rng.normal(0, 0.5, (n, 20))]), y


def frame(spark, x, y, banks=3):
    return spark.createDataFrame([(i % banks, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], ROWS)


@pytest.mark.parametrize("model", [training.Logistic(5), training.Perceptron((5, 4, 3), 2)], ids=["logistic", "perceptron"])
def test_slopes_equal_differences_and_steps_stay_inside(model):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(8, 5)), rng.integers(0, 2, 8).astype(float)
    w = model.start() + rng.normal(0, 0.4, len(model.start()))
    loss = lambda v: -(y * np.log(model.score(w, v)) + (1 - y) * np.log(1 - model.score(w, v)))
    step = 1e-6
    numeric = np.stack([(loss(x + step * e) - loss(x - step * e)) / (2 * step) for e in np.eye(5)], axis=1)
    np.testing.assert_allclose(model.slope(w, x, y), numeric, atol=1e-4)
    one, many = training.descend_up(model, w, x, y, 0.2), training.descend_up(model, w, x, y, 0.2, 10)
    assert np.abs(one - x).max() <= 0.2 + 1e-9 and np.abs(many - x).max() <= 0.2 + 1e-9
    assert loss(many).sum() >= loss(x).sum() and loss(one).sum() >= loss(x).sum()


def test_the_robust_gradient_is_that_of_the_worst_shift():
    model, rng = training.RobustLogistic(6, 0.3), np.random.default_rng(5)
    x, y, s = rng.normal(size=(12, 6)), rng.integers(0, 2, 12).astype(float), rng.random(12)
    w = rng.normal(size=7)

    def loss(v):
        worst = x - 0.3 * np.sign(v[:-1]) * (2 * y - 1)[:, None]
        p = training.Logistic(6).score(v, worst)
        return -(s * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    numeric = [(loss(w + e) - loss(w - e)) / 2e-6 for e in np.eye(7) * 1e-6]
    np.testing.assert_allclose(model.gradient(w, x, y, s), numeric, atol=1e-4)


@pytest.mark.parametrize("hard", [training.RobustLogistic(21, 0.4), training.Hardened(training.Logistic(21), 0.4, 5, 0.7)], ids=["closed form", "projected steps"])
def test_hardened_models_are_evaded_less(spark, hard):
    x, y = weak_inputs()
    rows = frame(spark, x, y)
    rate = {}
    for name, model in (("plain", training.Logistic(21)), ("hard", hard)):
        w = training.federated(rows, model, 12, 2, 0.5)
        found = training.evasion_rate(rows, w, 0.4, model=training.Logistic(21), steps=10).collect()
        rate[name] = sum(r.evaded for r in found) / sum(r.caught for r in found)
        assert sum(r.caught for r in found) > 0.8 * y.sum()
        single = training.evasion_rate(rows, w, 0.4, model=training.Logistic(21)).collect()
        assert sum(r.evaded for r in single) == sum(r.evaded for r in found)  # one step does it on a linear model
    assert rate["hard"] < 0.75 * rate["plain"]


def packed_rows(seed=3, n=240):
    rng = np.random.default_rng(seed)
    x = np.hstack([rng.normal(size=(n, 4)), rng.integers(0, 3, (n, 1)), rng.integers(0, 2, (n, 1)), rng.random((n, 1)) < 0.4]).astype(float)
    return x, ((x[:, 0] + (x[:, 4] == 2) + rng.normal(0, 0.5, n)) > 0.8).astype(int)


def test_each_block_of_the_packed_gradient_is_that_of_its_model():
    model = training.Packed(4, (3, 2), (5, 3), 2, 4, 1)
    x, y = packed_rows()
    rng = np.random.default_rng(2)
    w, s = model.start() + rng.normal(0, 0.3, len(model.start())), rng.random(len(y)) + 0.5
    late = x[:, -1] == 1
    found = model.gradient(w, x, y.astype(float), s)
    views = [x[:, :4], x[:, :4], x[:, [4, 5, 0, 1, 2, 3]]]
    for (k, a, b), single, view in zip(model.blocks(), model.models(), [*views, model.base_scores(w, x)], strict=True):
        own = late if k == 3 else ~late
        np.testing.assert_allclose(found[a:b], single.gradient(w[a:b], view[own], y[own].astype(float), s[own]))
    assert model.blocks()[-1][2] == len(w) == len(found)


def test_packed_rounds_equal_a_loop_with_clipped_blocks(spark):
    model, budgets = training.Packed(4, (3, 2), (5, 3), 2, 4, 1), [0.05, 0.2, 0.1, 0.02]
    x, y = packed_rows()
    bank = np.arange(len(y)) % 3
    w = model.start()
    for _ in range(2):
        local = []
        for b in range(3):
            own, v = bank == b, w.copy()
            weight = np.where(y[own] == 1, (y[own] == 0).sum() / max(1, y[own].sum()), 1.0)
            for _ in range(2):
                v = v - 0.4 * (model.gradient(v, x[own], y[own].astype(float), weight) / own.sum() + 1e-4 * v)
            change = v - w
            for (_, i, j), most in zip(model.blocks(), budgets, strict=True):
                change[i:j] *= min(1, most / np.linalg.norm(change[i:j]))
            local.append(own.sum() * (w + change))
        w = np.sum(local, axis=0) / len(y)
    np.testing.assert_allclose(training.federated(frame(spark, x, y), model, 2, 2, 0.4, budgets=budgets), w)
    noisy = training.private_update(model, np.zeros(len(w)), budgets, 2.0, np.random.default_rng(1))
    assert abs(noisy.std() / (2.0 * robust.noise_sensitivity(budgets)) - 1) < 0.25


def test_rows_that_cannot_be_trained_on_train_nothing(spark):
    x, y = weak_inputs(1, 60)
    good = [(i % 2, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    bad = [(None, x[0].tolist(), 1), (0, None, 1), (0, [1.0], 1), (1, [None] * 21, 0), (1, [float("nan")] * 21, 0), (1, x[0].tolist(), None), (0, [], 1)]
    model = training.Logistic(21)
    want = training.federated(spark.createDataFrame(good, ROWS), model, 2)
    np.testing.assert_allclose(training.federated(spark.createDataFrame(good + bad, ROWS), model, 2), want)
    assert training.federated(spark.createDataFrame(bad[:2], ROWS), model, 2).tolist() == [0.0] * 22


def test_a_cohort_of_one_is_kept(spark):
    rows = spark.createDataFrame([(1, 7, [1.0, 2.0]), (2, 1, [0.0, 0.0]), (2, 2, [0.1, 0.0]), (2, 3, [9.0, 9.0])], "round int, member int, v array<double>")
    assert {(r["round"], r.member) for r in robust.multi_krum(rows, 1, ["round"]).where("selected").collect()} >= {(1, 7)}
    assert {(r["round"], r["dim"]): r.value for r in robust.multi_krum_mean(rows, 1, ["round"]).where("round = 1").collect()} == {(1, 0): 1.0, (1, 1): 2.0}
    assert [r.rejected for r in robust.outlier_gate(rows, 1, by=["round"]).where("round = 1").collect()] == [False]
    assert robust.multi_krum(rows.drop("round").where("member = 7"), 1).where("selected").count() == 1
