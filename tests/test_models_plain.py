"""Fitted models and recurrences against plain versions that try every path."""

import math
from itertools import product

import numpy as np
import pytest

from tidemark.operators import models, regime


def student(x, past, mu0, var0):
    """Log density of x after a run's values, from a normal with unknown mean and variance, in one step from the prior."""
    n = len(past)
    kappa, alpha = 1.0 + n, 1.0 + n / 2
    mean = sum(past) / n if n else 0.0
    mu = (mu0 + n * mean) / kappa
    beta = var0 + 0.5 * sum((p - mean) ** 2 for p in past) + n * (mean - mu0) ** 2 / (2 * kappa)
    scale2, nu = beta * (kappa + 1) / (alpha * kappa), 2 * alpha
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * scale2) - (nu + 1) / 2 * math.log1p((x - mu) ** 2 / (nu * scale2))


def test_change_points_equal_all_segmentations(spark):
    xs, hazard = [0.1, -0.2, 0.15, 3.0, 3.2, 2.9, 0.0, 0.1], 0.2
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "symbol string, open_time long, x double")
    got = {r.open_time: r for r in regime.change_points(df, "x", hazard, 1e-300).collect()}
    mu0, var0 = float(np.median(xs)), float(np.var(xs))
    for t in range(len(xs)):
        weight = {}
        for cuts in product((False, True), repeat=t + 1):  # whether a run ends after each value
            log, run = 0.0, []
            for x, cut in zip(xs, cuts, strict=False):
                log += student(x, run, mu0, var0) + math.log(hazard if cut else 1 - hazard)
                run = [] if cut else [*run, x]
            weight[len(run)] = weight.get(len(run), 0.0) + math.exp(log)
        total = sum(weight.values())
        assert got[t].p_change == pytest.approx(weight[0] / total)
        assert got[t].run_length == max(weight, key=lambda k: weight[k])


def test_filtered_states_equal_all_paths():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 2))
    m = regime.GaussianHMM(2)
    m.mean, m.var, m.start = rng.normal(size=(2, 2)), np.array([[1.0, 0.5], [0.3, 2.0]]), np.array([0.6, 0.4])
    m.move = np.array([[0.8, 0.2], [0.3, 0.7]])
    density = lambda v, k: math.prod(math.exp(-((v[j] - m.mean[k, j]) ** 2) / (2 * m.var[k, j])) / math.sqrt(2 * math.pi * m.var[k, j]) for j in range(2))
    got = m.filter(x)
    for t in range(6):
        weight = [0.0, 0.0]
        for path in product((0, 1), repeat=t + 1):
            p = m.start[path[0]] * math.prod(m.move[a, b] for a, b in zip(path, path[1:], strict=False)) * math.prod(density(v, k) for v, k in zip(x, path, strict=False))
            weight[path[-1]] += p
        assert got[t].tolist() == pytest.approx([w / sum(weight) for w in weight])


def test_em_does_not_lose_likelihood():
    rng = np.random.default_rng(5)
    states = (np.arange(300) // 60) % 2
    x = rng.normal(size=(300, 1)) * np.where(states, 3.0, 0.5)[:, None] + states[:, None] * 2
    def likelihood(m):  # noqa: E306
        p, total = m.start, 0.0
        for t, v in enumerate(x):
            e = np.exp(m._log_emission(v[None])[0])
            a = (p if t == 0 else p @ m.move) * e
            total, p = total + math.log(a.sum()), a / a.sum()
        return total
    few, many = (likelihood(regime.GaussianHMM(2, k, stickiness=0.0).fit(x)) for k in (1, 20))
    assert many > few
    agree = (regime.GaussianHMM(2).fit(x).filter(x).argmax(1) == states).mean()
    assert max(agree, 1 - agree) > 0.9


def test_expected_durations_are_causal_and_plain(spark):
    rng = np.random.default_rng(2)
    d = rng.weibull(1.2, 200) * 10 + 0.5
    times = np.append(0, np.cumsum(d * 60_000)).astype(int).tolist()
    df = spark.createDataFrame([("a", t) for t in times], "symbol string, close_time long")
    got = models.acd(df).toPandas().sort_values("close_time")
    alpha, beta = got.alpha.iloc[-1], got.beta.iloc[-1]
    x = np.diff(times) / 60_000
    mean, e = x[:100].mean(), got.expected_minutes.to_numpy()[1:]
    omega = mean * max(1e-4, 1 - alpha - beta)
    want = [mean]
    for v in x[:-1]:
        want.append(omega + alpha * v + beta * want[-1])
    assert e.tolist() == pytest.approx(want, rel=1e-6) and 0 <= alpha + beta < 1
    shorter = models.acd(df.where(f"close_time <= {times[150]}"), train_share=2 / 3).toPandas().sort_values("close_time")
    assert shorter.expected_minutes.iloc[1:].tolist() == pytest.approx(e[:150].tolist(), rel=1e-6)


def test_plain_variance_path(spark):
    """Flat returns of one size: the variance stays where the news is average, and jumps after a large move."""
    rng = np.random.default_rng(9)
    sd = np.where((np.arange(240) // 40) % 2, 0.04, 0.01)
    rows = [("a", i, float(rng.normal(0, sd[i]))) for i in range(240)]
    got = models.egarch(spark.createDataFrame(rows, "symbol string, open_time long, x double"), "x", 0.8).toPandas().sort_values("open_time")
    v, x = got.variance.to_numpy(), np.array([r[2] for r in rows])
    assert (v > 0).all() and v[sd > 0.02].mean() > v[sd < 0.02].mean()
    loss = lambda h: float((np.log(h) + x[:192] ** 2 / h).sum())
    assert loss(v[:192]) <= loss(np.full(192, x[:192].var())) + 1e-6
