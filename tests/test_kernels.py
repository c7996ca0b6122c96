"""Numeric kernels against known truths."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.functions import kernels as K
from tessera.functions.stats import f_sf, t_quantile, t_sf


def ar2(n, phi, seed, scale):
    rng = np.random.default_rng(seed)
    e = rng.normal(0, scale, n + 50)
    for t in range(2, n + 50):
        e[t] += phi[0] * e[t - 1] + phi[1] * e[t - 2]
    return e[50:]


def test_tails():
    assert 2 * t_sf(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-8)
    assert f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-10)


def test_ar_irls_recovers_truth():
    n, beta, phi = 2000, np.array([2.0, 1.5]), (0.65, 0.25)
    block = (np.arange(n) // 25 % 2).astype(float)
    x = np.column_stack([np.ones(n), block])
    y = x @ beta + ar2(n, phi, 1, 0.3)
    fit = K.ar_irls(x, y, pmax=6)
    assert fit["beta"][1] == pytest.approx(1.5, abs=0.1)
    assert fit["ar"][:2] == pytest.approx(phi, abs=0.1)
    resid = K.whiten(y, fit["ar"]) - K.whiten(x, fit["ar"]) @ fit["beta"]
    assert abs(np.corrcoef(resid[1:], resid[:-1])[0, 1]) < 3 / np.sqrt(n)


def test_robust_ignores_outliers():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(100), rng.normal(size=100)])
    y = x @ [1.0, 2.0] + rng.normal(0, 0.1, 100)
    y[:5] += 10
    assert K.irls(x, y)["beta"] == pytest.approx([1, 2], abs=0.05)
    assert abs(K.ols(x, y)["beta"][0] - 1) > 0.3


def test_butterworth_keeps_band_and_phase():
    t = np.arange(2000) / 100
    slow, fast = np.sin(2 * np.pi * 1 * t), np.sin(2 * np.pi * 20 * t)
    out = K.butter_filtfilt(slow + fast, 100, None, 5)
    assert np.abs(out - slow)[100:-100].max() < 0.01
    out = K.butter_filtfilt(slow + fast, 100, 10, 30)
    assert np.abs(out - fast)[100:-100].max() < 0.02
    z, p, k = K.butter(4, None, 10, 100)
    gain = lambda f: abs(k * np.prod(np.exp(2j * np.pi * f / 100) - z) / np.prod(np.exp(2j * np.pi * f / 100) - p))
    assert gain(10) == pytest.approx(np.sqrt(0.5), abs=1e-9) and gain(0.001) == pytest.approx(1, abs=1e-6)


def test_constant_survives_filters():
    assert K.butter_filtfilt(np.full(200, 3.0), 100, None, 5) == pytest.approx(np.full(200, 3.0))
    assert K.filtfilt_fir(np.full(80, 3.0), K.gausswin(20)) == pytest.approx(np.full(80, 3.0))


def test_spectra_find_the_peak():
    t = np.arange(640) / 64
    x = np.sin(2 * np.pi * 10 * t)
    for f, p in (K.welch(x, 64, 128), K.multitaper(x, 64)):
        assert abs(f[np.argmax(p)] - 10) <= 0.6
    f, p = K.welch(np.random.default_rng(0).normal(size=6400), 64, 128)
    assert np.trapezoid(p, f) == pytest.approx(1, abs=0.1)
    power = K.morlet_power(x, 64, np.array([5.0, 10.0, 20.0]))[:, 200:-200].mean(axis=1)
    assert np.argmax(power) == 1
    assert K.envelope(x)[50:-50] == pytest.approx(np.ones(540), abs=0.01)


def test_tapers_are_orthonormal():
    v = K.dpss(64, 2.5, 4)
    assert v @ v.T == pytest.approx(np.eye(4), abs=1e-9)


def test_resample_and_spline_and_peaks():
    t = np.arange(64) / 64
    x = np.cos(2 * np.pi * 3 * t)
    assert K.resample_fft(x, 32) == pytest.approx(x[::2], abs=1e-9)
    assert K.resample_fft(K.resample_fft(x, 128), 64) == pytest.approx(x, abs=1e-9)
    assert K.bspline(50, 8).sum(axis=1) == pytest.approx(np.ones(50))
    v = np.array([0, 3, 0, 5, 0, 0, 0, 4, 0.0])
    assert K.find_peaks(v, 3).tolist() == [3, 7]


def test_series_side_by_side_fit_as_one_by_one():
    rng = np.random.default_rng(8)
    xs = [np.column_stack([np.ones(n), rng.normal(size=n)]) for n in (3, 4, 9, 33, 34, 120)]
    ys = [x @ [1.0, 2.0] + rng.standard_t(2, len(x)) for x in xs] + [np.ones(5)]
    xs.append(np.ones((5, 2)))
    for norm in ("bisquare", "huber"):
        for x, y, f in zip(xs, ys, K.irls_many(xs, ys, norm), strict=True):
            one = K.irls(x, y, norm)
            assert f["beta"] == pytest.approx(one["beta"], abs=1e-9) and len(f["weights"]) == len(y)
    for x, y, f in zip(xs, ys, K.ar_irls_many(xs, ys, 3), strict=True):
        one = K.ar_irls(x, y, 3)
        assert f["beta"] == pytest.approx(one["beta"], abs=1e-9) and f["ar"] == pytest.approx(one["ar"], abs=1e-9)
