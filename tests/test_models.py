"""Fits against closed forms."""

import math
import os

import numpy as np
import pytest

import __spark_entry__ as entry
from tutorgauge.operators import models


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 6)) @ rng.normal(size=(6, 6))
    y = x @ np.array([1.0, -2.0, 0.5, 0.0, 0.3, 0.1]) + rng.normal(size=120) * 0.3 + 4
    return x, y


@pytest.fixture(scope="module")
def parts(spark, data):
    x, y = data
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], [*models.FEATURES, "result"])
    return models.Components(df), df


def scaled(x):
    return (x - x.mean(0)) / x.std(0)


def test_components(parts, data):
    got, df = parts
    _, s, vt = np.linalg.svd(scaled(data[0]), full_matrices=False)
    assert got.ratios == pytest.approx(s**2 / (s**2).sum())
    for mine, theirs in zip(got.loadings.T, vt):
        assert abs(mine @ theirs) == pytest.approx(1.0)
        assert mine[np.argmax(np.abs(mine))] > 0
    assert got.variance_table(df).collect()[-1].cumulative == pytest.approx(1.0)


def test_regressions(parts, data):
    got, _ = parts
    x, y = data
    z = scaled(x) @ got.loadings
    fits = models.fit_regressions(got.scores(), "result", ["linear", "ridge", "lasso", "quadratic"])
    yc = y - y.mean()
    linear = np.linalg.solve(z.T @ z, z.T @ yc)
    assert fits["linear"]["model"].coefficients.toArray() == pytest.approx(linear, rel=1e-6)
    assert fits["linear"]["r2"] == pytest.approx(1 - ((yc - z @ linear) ** 2).sum() / (yc**2).sum())
    ridge = np.linalg.solve(z.T @ z + np.eye(6), z.T @ yc)
    assert fits["ridge"]["model"].coefficients.toArray() == pytest.approx(ridge, rel=1e-6)
    # Components are orthogonal, so the lasso is a soft threshold of each slope.
    scale = (z**2).sum(0) / len(y)
    lasso = np.sign(linear) * np.maximum(np.abs(linear) - 0.1 / scale, 0)
    assert fits["lasso"]["model"].coefficients.toArray() == pytest.approx(lasso, abs=1e-5)
    assert fits["quadratic"]["r2"] >= fits["linear"]["r2"]
    table = {r.model: r.best for r in models.comparison(got.scores(), "result", ["linear", "ridge"]).collect()}
    assert table == {"linear": True, "ridge": False}


def test_boosted_trees(parts):
    got, _ = parts
    rows = got.scores()
    fits = models.fit_regressions(rows, "result", ["linear", "boosted"])
    assert fits["boosted"]["r2"] > 0.98
    weights = fits["boosted"]["model"].featureImportances.toArray()
    assert weights.sum() == pytest.approx(1.0) and len(weights) == 6


def dense_cost(theta, x, y, groups, reml=True):
    n, p = x.shape
    v = np.eye(n) + theta * (groups[:, None] == groups[None, :])
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    res = y - x @ beta
    free = n - p if reml else n
    s2 = res @ vi @ res / free
    cost = free * math.log(s2) + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(a)[1] if reml else 0)
    return cost, beta, np.sqrt(s2 * np.diag(np.linalg.inv(a)))


@pytest.mark.parametrize("reml", [True, False])
@pytest.mark.parametrize("balanced", [True, False])
def test_random_intercept(spark, reml, balanced):
    rng = np.random.default_rng(2)
    groups = np.repeat(np.arange(12), 6) if balanced else np.repeat(np.arange(12), np.arange(1, 13))
    x = rng.normal(size=len(groups))
    y = 1 + 0.7 * x + rng.normal(size=12)[groups] + rng.normal(size=len(groups)) * 0.5
    df = spark.createDataFrame([(int(g), float(a), float(b)) for g, a, b in zip(groups, x, y)], "g int, x double, y double")
    got = models.random_intercept(df, "y", ["x"], "g", reml).first()
    design = np.column_stack([np.ones_like(x), x])
    best = min((dense_cost(t, design, y, groups, reml) + (t,) for t in np.exp(np.linspace(-4, 5, 400))), key=lambda c: c[0])
    at = dense_cost(got.ratio, design, y, groups, reml)
    assert at[0] <= best[0] + 1e-9
    assert (got.beta, got.se) == pytest.approx((at[1][1], at[2][1]))
    assert (got.aic is None) == reml


def test_random_intercept_without_group_effect(spark):
    rows = [(i % 4, float(i), 2.0 * i + (1 if i % 2 else -1)) for i in range(40)]
    got = models.random_intercept(spark.createDataFrame(rows, "g int, x double, y double"), "y", ["x"], "g").first()
    assert got.beta == pytest.approx(2.0, abs=0.02) and got.p < 1e-6


@pytest.mark.parametrize("name", ["x11_model_comparison", "l15_feature_model"])
def test_best_is_chosen_among_all_five(spark, name):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    rows = entry.queries()[name](spark, folder).collect()
    assert sorted(r.model for r in rows) == sorted(models.REGRESSIONS)
    assert [r.model for r in rows if r.best] == [max(rows, key=lambda r: r.r2).model]
