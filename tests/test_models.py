"""Nested fits, group tests, spline expansion, summed power and the sweep against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.functions.stats import f_sf
from tessera.operators import regression as R
from tessera.operators import signals as S
from tessera.operators import trials as T
from tessera.plans.trial_queries import SIGMAS


def rss(x, y):
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return float(e @ e)


@pytest.fixture(scope="module")
def regressors():
    rng = np.random.default_rng(5)
    data = {}
    for key, n in (("a", 60), ("b", 25), ("c", 9), ("tiny", 4)):
        x = rng.normal(size=(n, 5))
        if key == "b":
            x[:, 4] = 2 * x[:, 3] - 1  # adds nothing to the other of its group
        data[key] = x, x @ [0.5, 0.0, 1.0, -0.4, 0.2] + rng.normal(size=n)
    return data


def test_nested_models(spark, regressors):
    rows = [(k, *map(float, r), float(v)) for k, (x, y) in regressors.items() for r, v in zip(x, y)] + [("a", None, 0.0, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, x0 double, x1 double, x2 double, x3 double, x4 double, y double")
    groups = {"s": {"x1": F.col("x1"), "x2": F.col("x2")}, "e": {"x3": F.col("x3"), "x4": F.col("x4")}}
    m = R.nested_models(df, "y", {"one": F.lit(1.0), "x0": F.col("x0")}, groups, ["key"]).persist()
    columns = {"base": [0, 1], "s": [0, 1, 2, 3], "e": [0, 1, 4, 5], "s+e": [0, 1, 2, 3, 4, 5]}
    fits = {(r["key"], r["design"]): r for r in R.design_fits(m, ["key"]).collect()}
    assert len(fits) == 4 * len(regressors)
    for key, (x, y) in regressors.items():
        x = np.column_stack([np.ones(len(y)), x])
        for d, at in columns.items():
            assert fits[key, d]["rank"] == np.linalg.matrix_rank(x[:, at])
            assert fits[key, d]["rss"] == pytest.approx(rss(x[:, at], y), abs=1e-8)
    tests = {(r["key"], r["design"], r["tested"]): r for r in R.group_tests(m, ["key"]).collect()}
    assert len(tests) == 5 * len(regressors)
    for key in ("a", "c"):
        x, y = np.column_stack([np.ones(len(regressors[key][1])), regressors[key][0]]), regressors[key][1]
        for (_, design, tested), r in ((k, r) for k, r in tests.items() if k[0] == key):
            at, own = columns[design], [2, 3] * ("s" in tested) + [4, 5] * ("e" in tested)
            fit = K.ols(x[:, at], y)
            chosen = np.array([at.index(c) for c in own])
            f, p, z = K.contrast(fit, chosen)
            assert (r["df1"], r["df2"]) == (len(own), len(y) - len(at))
            assert (r["f"], r["p"], r["z"]) == pytest.approx((f, f_sf(f, len(own), len(y) - len(at)), z))
    b = tests["b", "s+e", "e"]
    assert b["df1"] == 1 and b["df2"] == 25 - 5 and b["z"] is not None
    assert tests["tiny", "s+e", "s"]["f"] is None


def test_added_variable_test_is_the_same_f(spark, regressors):
    x, y = regressors["a"]
    df = spark.createDataFrame([(1, *map(float, r), float(v)) for r, v in zip(x, y)], "key int, x0 double, x1 double, x2 double, x3 double, x4 double, y double")
    small = {"one": F.lit(1.0), "x0": F.col("x0")}
    old = R.added_variable_test(R.ols(df, "y", small, ["key"]), R.ols(df, "y", small | {"x1": F.col("x1"), "x2": F.col("x2")}, ["key"]), ["key"]).first()
    new = R.group_tests(R.nested_models(df, "y", small, {"s": {"x1": F.col("x1"), "x2": F.col("x2")}}, ["key"]), ["key"]).first()
    assert (new["f"], new["p"]) == pytest.approx((old["f"], old["p"]))


@pytest.mark.parametrize("n_taps, n_splines", [(4, 4), (6, 6), (12, 5)])
def test_spline_response(spark, n_taps, n_splines):
    """A full basis gives the uncompressed fit and its variances; a smaller one the fit within the span of the splines."""
    rng = np.random.default_rng(n_taps)
    x, e = rng.normal(size=300), rng.normal(size=300)
    lags = np.stack([np.concatenate([np.zeros(d), x[: 300 - d]]) for d in range(n_taps)], axis=1)
    y = lags @ rng.normal(size=n_taps) + 2 + e
    df = spark.createDataFrame([(1, i, float(a), float(b), 1.0) for i, (a, b) in enumerate(zip(x, y))], "k int, i int, x double, y double, one double")
    taps = R.spline_taps(df, "x", ["k"], "i", n_taps, n_splines)
    fit = R.fit_series(taps, ["k"], "y", ["one", *[f"s{k}" for k in range(n_splines)]], "i")
    got = {r["delay"]: (r["h"], r["var"]) for r in R.bspline_expand(fit, ["k"], n_taps, n_splines, first=1).collect()}
    b = K.bspline(n_taps, n_splines)
    plain = K.ols(np.column_stack([np.ones(300), lags @ b]), y)
    h, cov = b @ plain["beta"][1:], b @ plain["cov"][1:, 1:] @ b.T
    assert got == {d: pytest.approx((h[d], cov[d, d])) for d in range(n_taps)}
    if n_taps == n_splines and np.linalg.matrix_rank(b) == n_taps:
        whole = K.ols(np.column_stack([np.ones(300), lags]), y)
        assert got == {d: pytest.approx((whole["beta"][d + 1], whole["cov"][d + 1, d + 1])) for d in range(n_taps)}


def test_power_is_summed_over_epochs_of_any_length(spark):
    rng = np.random.default_rng(2)
    epochs = [(k, [float(v) for v in rng.normal(size=n)]) for k, n in [("a", 64), ("a", 64), ("b", 64), (None, 32), ("a", 48)] * 3] + [("a", None)]
    df = spark.createDataFrame(epochs, "k string, v array<double>").repartition(3)
    freqs = [4.0, 9.0, 15.0]
    got = {(r["k"], round(r["freq"]), r["pos"], r["n"]): r["v"] for r in S.mean_by_place(df, ["k"], lambda m: K.morlet_power(m, 64.0, np.array(freqs)).swapaxes(0, 1).reshape(len(m), -1)).withColumns({"freq": F.get(F.array(*map(F.lit, freqs)), F.floor(F.col("pos") / F.col("n")).cast("int")), "pos": F.col("pos") % F.col("n")}).collect()}
    groups = {}
    for k, v in epochs:
        if v is not None:
            groups.setdefault((k, len(v)), []).append(v)
    assert len(got) == sum(3 * n for _, n in groups)
    for (k, n), own in groups.items():
        for f in freqs:
            sd = 0.5 / (2 * np.pi)
            t = np.arange(-int(5 * sd * 64), int(5 * sd * 64) + 1) / 64
            w = np.exp(2j * np.pi * f * t - t**2 / (2 * sd**2))
            w /= np.sqrt(0.5) * np.linalg.norm(w)
            full = [np.convolve(v, w) for v in own]
            want = np.mean([np.abs(c[(len(c) - n) // 2 :][:n]) ** 2 for c in full], axis=0)
            assert [got[k, round(f), i, n] for i in range(n)] == pytest.approx(want.tolist())
    assert S.morlet_power(df, ["k"], 64.0, freqs).count() == 3 * sum(n for _, n in groups)


def test_sweep_of_all_widths(spark):
    """Each width by a plain weighted sum over mirrored places; runs of 1, 2, 7 and 90 trials, one with a gap."""
    rng = np.random.default_rng(33)
    runs = {(1, 1): 1, (1, 2): 2, (2, 1): 7, (2, 2): 90, (3, 1): 30}
    data = {k: (np.abs(rng.normal(size=n)), rng.uniform(0.3, 1.2, n), rng.random(n) < 0.8) for k, n in runs.items()}
    rows = [(*k, i, None if (k, i) == ((3, 1), 4) else float(x), float(t), "city_correct" if c else "mnt_correct") for k, (xs, ts, cs) in data.items() for i, (x, t, c) in enumerate(zip(xs, ts, cs))]
    df = spark.createDataFrame(rows, "subject int, run int, trial_idx int, VTC double, reaction_time double, condition string").repartition(5)
    got = {r["sigma"]: (r["rt_diff_ms"], r["n_runs"]) for r in T.smoothing_sweep(df, SIGMAS).collect()}
    assert sorted(got) == SIGMAS and len(SIGMAS) == 199 and SIGMAS[-1] == 99.5
    for s in SIGMAS[:12] + SIGMAS[20::30]:
        found = []
        for k, (x, t, c) in data.items():
            n, radius = len(x), int(4 * s + 0.5)
            at = np.arange(-radius, radius + 1)
            w = np.exp(-0.5 * (at / s) ** 2) if s else np.ones(1)
            place = (np.arange(n)[:, None] + at) % (2 * n)
            smooth = np.where(place < n, x[np.minimum(place, n - 1)], x[np.minimum(2 * n - 1 - place, n - 1) % n]) @ (w / w.sum())
            low = smooth < np.median(smooth)
            if k != (3, 1) and (low & c).any() and (~low & c).any():
                found.append(t[low & c].mean() - t[~low & c].mean())
        assert got[s] == (pytest.approx(1000 * np.mean(found)), len(found))


def test_sweep_in_parts_of_bounded_size(monkeypatch):
    rng = np.random.default_rng(1)
    x, rt = rng.normal(size=200), rng.normal(size=200)
    want = T._sweep(x, rt, tuple(SIGMAS))
    monkeypatch.setattr(T, "_SWEEP_VALUES", 3 * 400)
    assert T._sweep(x, rt, tuple(SIGMAS)) == pytest.approx(want)


def test_plan_of_the_sweep_does_not_grow_with_the_widths(spark):
    df = spark.createDataFrame([(1, 1, 0, 1.0, 0.5, "city_correct")], "subject int, run int, trial_idx int, VTC double, reaction_time double, condition string")
    plans = [T.smoothing_sweep(df, w)._jdf.queryExecution().optimizedPlan().toString().count("\n") for w in (SIGMAS[:2], SIGMAS)]
    assert plans[0] == plans[1]


def test_zones_by_window_mean(spark):
    trials = [(1, i, 10.0 * i) for i in range(6)] + [(2, 0, 0.0)]
    samples = [(1, 10.0 * i + k, float(i * i)) for i in range(6) if i != 3 for k in (0, 1, 2)] + [(1, 30.0, 100.0), (2, 0.5, 1.0), (2, 0.6, 2.0)]
    got = T.zone_by_window_mean(spark.createDataFrame(trials, "subject int, trial_idx int, onset double"), spark.createDataFrame(samples, "subject int, t double, v double"), ["subject"], 0.0, 3.0, 2, ["subject"])
    assert {(r["subject"], r["trial_idx"]): (r["mean_v"], r["zone"]) for r in got.collect()} == {(1, 0): (0.0, "in"), (1, 1): (1.0, "in"), (1, 2): (4.0, "out"), (1, 4): (16.0, "out"), (1, 5): (25.0, "out"), (2, 0): (1.5, "out")}
