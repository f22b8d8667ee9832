"""Solvers against stationarity of the penalised likelihoods and dense algebra."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectrafold.functions.filters import NAMES, multivariate, univariate
from spectrafold.operators import dense


def chain(n):
    k = np.arange(n)
    u = np.sqrt(np.where(k > 0, 2.0, 1.0) / n) * np.cos(np.pi * (k[:, None] + 0.5) * k / n)
    return 2 - 2 * np.cos(np.pi * k / n), u


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(1)
    (l0, u0), (l1, u1) = chain(5), chain(6)
    gain = multivariate("diffusion", 0.3, 0.4).array(*np.meshgrid(l0, l1, indexing="ij"))
    s = np.ones(30)
    s[rng.permutation(30)[:15]] = 0
    return {"prior": dense.Prior((u0, u1), gain), "s": s.reshape(5, 6), "x": rng.standard_normal((5, 6, 4)), "rng": rng, "gamma": 1.2, "lam": 5.0}


def precision(prior):
    return np.linalg.inv(dense.covariance(prior))


def test_gsr_is_stationary_and_agrees_with_the_dual(case):
    p, s, g = case["prior"], case["s"], case["gamma"]
    y = s * case["rng"].standard_normal((5, 6))
    f = dense.gsr(y, s, p, g)
    assert np.abs(s * (f - y) + g * (precision(p) @ f.ravel()).reshape(5, 6)).max() < 1e-6
    assert np.allclose(f, dense.gsr_dual(y, s, p, g), atol=1e-7)
    full = case["rng"].standard_normal((5, 6))
    ones = np.ones((5, 6))
    assert np.allclose(dense.gsr(full, ones, p, g), dense.gsr_dual(full, ones, p, g), atol=1e-9)


def test_kernel_axis(case):
    rng = case["rng"]
    x = rng.standard_normal((3, 5))
    lam, v = np.linalg.eigh(dense.rbf_kernel(x, 1.0))
    p = case["prior"].with_kernel(v, lam)
    s = (rng.random((3, 5, 6)) < 0.5).astype(float)
    y = s * rng.standard_normal((3, 5, 6))
    assert np.allclose(dense.gsr(y, s, p, 1.2), dense.gsr_dual(y, s, p, 1.2), atol=1e-6)
    assert np.allclose(np.diag(dense.rbf_kernel(x, 1.0)), 1)


def test_cohesion_regression_is_stationary(case):
    p, s, x, g, lam = (case[k] for k in ("prior", "s", "x", "gamma", "lam"))
    y = s * case["rng"].standard_normal((5, 6))
    b, w = dense.solve_rnc(y, s, x, p, g, lam)
    r = s * (b + x @ w - y)
    assert np.abs(r + g * (precision(p) @ b.ravel()).reshape(5, 6)).max() < 1e-6
    assert np.abs(np.tensordot(r, x, 2) + lam * w).max() < 1e-6


def test_logistic_models_are_stationary(case):
    p, s, x, g, lam = (case[k] for k in ("prior", "s", "x", "gamma", "lam"))
    y = s * (case["rng"].random((5, 6)) < 0.5)
    f = dense.lgsr(y, s, p, g)
    assert np.abs(s * (dense.mu_logistic(f) - y) + g * (precision(p) @ f.ravel()).reshape(5, 6)).max() < 1e-4
    b, w = dense.lrnc(y, s, x, p, g, lam)
    r = s * (dense.mu_logistic(b + x @ w) - y)
    assert np.abs(r + g * (precision(p) @ b.ravel()).reshape(5, 6)).max() < 1e-4
    assert np.abs(np.tensordot(r, x, 2) + lam * w).max() < 1e-4


def test_softmax_models_are_stationary(case):
    p, s, x, g, lam = (case[k] for k in ("prior", "s", "x", "gamma", "lam"))
    y = np.eye(3)[case["rng"].integers(0, 3, (5, 6))] * s[..., None]
    f = dense.lgsr_multiclass(y, s, p, g)
    r = s[..., None] * (dense.mu_softmax(f) - y)
    assert np.abs(r + g * (precision(p) @ f.reshape(30, 3)).reshape(5, 6, 3)).max() < 1e-4
    b, w = dense.lrnc_multiclass(y, s, x, p, g, lam)
    r = s[..., None] * (dense.mu_softmax(b + x @ w) - y)
    assert np.abs(r + g * (precision(p) @ b.reshape(30, 3)).reshape(5, 6, 3)).max() < 1e-4
    assert np.abs(np.tensordot(x, r, ((0, 1), (0, 1))) + lam * w).max() < 1e-4


def test_samples_have_the_posterior_covariance(case):
    p, s, g = case["prior"], case["s"], case["gamma"]
    y = s * case["rng"].standard_normal((5, 6))
    draws = np.array([dense.sample_gsr(y, s, p, g, np.random.default_rng(i)).ravel() for i in range(3000)])
    exact = np.linalg.inv(np.diag(s.ravel()) + g * precision(p))
    assert np.abs(np.cov(draws.T) - exact).max() < 0.12 * exact.max()
    assert np.allclose(dense.marginal_variance(s, p, g).ravel(), np.diag(exact), atol=1e-8)
    assert np.abs(draws.mean(0) - dense.gsr(y, s, p, g).ravel()).max() < 0.08


def test_linear_solvers():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((8, 8))
    a = a @ a.T + 8 * np.eye(8)
    y = rng.standard_normal(8)
    want = np.linalg.solve(a, y)
    assert np.allclose(dense.conjugate_gradients(lambda v: a @ v, y)[0], want)
    phi = np.diag(1 / np.sqrt(np.diag(a)))
    assert np.allclose(dense.preconditioned(lambda v: a @ v, lambda v: phi @ v, lambda v: phi.T @ v, y)[0], want)
    d = np.full(8, np.abs(a).sum(1).max())
    assert np.allclose(dense.splitting(lambda v: v - a @ v / d, lambda v: v / d, y, 1e-12)[0], want, atol=1e-6)


@pytest.mark.parametrize("name", NAMES)
def test_filters(name):
    assert univariate(name, 0.5).array(np.zeros(3)).tolist() == [1, 1, 1]
    assert multivariate(name, 0.5, 0.2).array(np.zeros(3), np.zeros(3)).tolist() == [1, 1, 1]
    with pytest.raises(ValueError):
        multivariate(name, 0.5, 0.2).array(np.zeros(3))


def test_golden_filter_values():
    assert univariate("random_walk", 1.5).array(np.array([2.0]))[0] == 0.25
    assert univariate("bandlimited", 1).array(np.array([1.0]))[0] == 1 and multivariate("bandlimited", 1).array(np.array([1.0]))[0] == 0
    assert univariate("bandlimited", 0).array(np.array([9.0]))[0] == 1


@settings(max_examples=25, deadline=None)
@given(st.floats(0, 2), st.floats(0, 2), st.floats(0, 8))
def test_diffusions_add_up(a, b, lam):
    x = np.array([lam])
    assert np.allclose(univariate("diffusion", a).array(x) * univariate("diffusion", b).array(x), univariate("diffusion", a + b).array(x))
