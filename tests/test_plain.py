"""Queries that SQL can't say, compared row for row with plain numpy versions written another way."""

from __future__ import annotations

import functools

import numpy as np
import pytest

from tessera.operators import regression as R
from tessera.operators import signals as S
from tessera.plans.model_queries import Q, days, fitted, series
from tessera.plans.views import v_epochs, v_samples

SF = "/root/testdata/sf0.001"


# Filters: coefficients of one polynomial from the roots of the squared magnitude, the difference equation sample by sample.


def butter_ba(low, high, fs, order=4):
    warp = lambda f: np.tan(np.pi * f / fs)
    if low is None:
        proto = np.polynomial.Polynomial([1] + [0] * (2 * order - 1) + [(-1) ** order / warp(high) ** (2 * order)])  # 1 + (-s^2)^n / w^2n
        poles, zeros = proto.roots(), np.zeros(0)
    else:
        w0, bw = warp(low) * warp(high), warp(high) - warp(low)
        ring = np.polynomial.Polynomial([w0, 0, 1]) ** (2 * order)  # (s^2 + w0^2)^2n + (-1)^n (bw s)^2n
        poles, zeros = (ring + (-1) ** order * np.polynomial.Polynomial([0, bw]) ** (2 * order)).roots(), np.zeros(order)
    poles = poles[poles.real < 0]
    to_z = lambda s: (1 + s) / (1 - s)
    b = np.real(np.poly(np.concatenate((to_z(zeros), -np.ones(len(poles) - len(zeros))))))
    a = np.real(np.poly(to_z(poles)))
    at = 1.0 if low is None else np.exp(2j * np.arctan(np.sqrt(w0)))
    return b * abs(np.polyval(a, at) / np.polyval(b, at)), a


def filtfilt(x, fs, low=None, high=None):
    b, a = butter_ba(low, high, fs)
    n_sections = (len(a) - 1) // 2
    pad = min(3 * (2 * n_sections + 1), len(x) - 1)
    y = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    gain = b.sum() / a.sum()
    for _ in range(2):
        past_x, past_y, out = np.full(len(b), y[0]), np.full(len(a), gain * y[0]), []
        for v in y:
            past_x = np.concatenate(([v], past_x[:-1]))
            new = b @ past_x - a[1:] @ past_y[: len(a) - 1]
            past_y = np.concatenate(([new], past_y[:-1]))
            out.append(new)
        y = np.array(out)[::-1]
    return y[pad : len(y) - pad]


@functools.cache
def epochs_of(spark):
    return [(r.subject, r.trial_idx, r.channel, np.array(r.v)) for r in v_epochs(spark, SF).collect()]


def g15(spark):
    return {(s, t, c): np.sum(filtfilt(v, 64, 1, 20) ** 2) for s, t, c, v in epochs_of(spark)}


def g11(spark):
    return {(s, t, c): np.log(np.mean((w := filtfilt(v, 64, 8, 12)) ** 2) - np.mean(w) ** 2 + 1e-30) for s, t, c, v in epochs_of(spark)}


def g14(spark):
    return {(s, t, c, i): np.sort(w)[len(w) // 2] for s, t, c, v in epochs_of(spark) for i in (8, 24, 40, 56) for w in [filtfilt(v, 64, 8, 12)[max(0, i - 8) : i + 9] ** 2] if len(w) % 2} | {
        (s, t, c, i): np.median(filtfilt(v, 64, 8, 12)[max(0, i - 8) : i + 9] ** 2) for s, t, c, v in epochs_of(spark) for i in (8, 24, 40, 56) if (min(64, i + 9) - max(0, i - 8)) % 2 == 0
    }


def g16(spark):
    k = np.arange(64)
    lag = k[:, None] - k
    hilbert = np.where(lag % 2 == 1, 2 / 64 / np.tan(np.pi * np.where(lag % 2 == 1, lag, 1) / 64), 0)
    out = {}
    for s, t, _, v in epochs_of(spark):
        w = filtfilt(v, 64, 8, 12)
        out.setdefault((s, t), []).append(np.hypot(w, hilbert @ w))
    return {(s, t, i): x for (s, t), e in out.items() for i, x in enumerate(np.mean(e, axis=0))}


def g26(spark):
    by = {}
    for s, t, c, v in epochs_of(spark):
        by.setdefault((s, t), {})[c] = v
    out = {}
    for (s, t), chans in by.items():
        m = np.stack([chans[c] - chans[c].mean() for c in sorted(chans)])
        u, sv, _ = np.linalg.svd(m)
        w = u[:, 0] * np.sign(u[np.argmax(np.abs(u[:, 0])), 0])
        share = np.concatenate((sv**2, np.zeros(len(m) - len(sv)))) / (sv**2).sum()
        n90 = 1 + int((np.cumsum(share) < 0.9 - 1e-12).sum())
        out |= {(s, t, i): (x, share[0], n90) for i, x in enumerate(w @ m)}
    return out


def w21(spark):
    out = set()
    for r in series(spark, SF).collect():
        v, kept = r.v, []
        tops = [i for i in range(1, len(v) - 1) if v[i - 1] < v[i] >= v[i + 1]]
        for i in sorted(tops, key=lambda i: (-v[i], i)):
            if not any(abs(i - j) < 3 for j in kept):
                kept.append(i)
        out |= {(r.subject, i) for i in kept}
    return dict.fromkeys(out, ())


def g19(spark):
    out, by = {}, {}
    for r in v_samples(spark, SF).collect():
        by.setdefault(r.subject, []).append((r.i / 4, r.v, r.event_type == "error"))
    for s, rows in by.items():
        rows.sort()
        t, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        v[[any(abs(x - rows[j][0]) <= 0.1 for j in range(len(rows)) if rows[j][2]) for x in t]] = np.nan
        ok = np.isfinite(v)
        if ok.mean() < 0.7 or len(t) < 3:
            continue
        i = np.arange(len(v))
        v = np.interp(i, i[ok], v[ok])
        v = v - np.polyval(np.polyfit(i - i.mean(), v, 2), i - i.mean())
        v = filtfilt(v, 4.0, None, 1.0)
        grid = np.arange(0, t[-1] + 1e-9, 0.5)
        out |= {(s, k): x for k, x in enumerate(np.interp(grid, t, v))}
    return out


# Fits: weights and autoregression by normal equations.


def weighted(x, y, w):
    return np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y)


def robust(x, y, norm):
    b = weighted(x, y, np.ones(len(y)))
    for _ in range(50):
        r = np.abs(y - x @ b)
        scale = np.median(r) / 0.6745
        if scale < 1e-12:
            break
        u = r / scale
        w = np.where(u < 4.685, (1 - (u / 4.685) ** 2) ** 2, 0) if norm == "bisquare" else np.minimum(1, 1.345 / np.maximum(u, 1e-300))
        new = weighted(x, y, w)
        done = np.abs(new - b).max() < 1e-8
        b = new
        if done:
            break
    return b


def ar(r, pmax):
    n = len(r) - pmax
    if n <= pmax + 2:
        return np.zeros(0)
    past = np.lib.stride_tricks.sliding_window_view(r, pmax + 1)[:, ::-1]  # r(t), r(t - 1) ...
    best = (np.inf, None)
    for p in range(pmax + 1):
        x = np.column_stack([np.ones(n), past[:, 1 : p + 1]])
        b = np.linalg.pinv(x) @ past[:, 0]
        bic = n * np.log(((past[:, 0] - x @ b) ** 2).sum() / n) + (p + 1) * np.log(n)
        if bic < best[0] - 1e-9:
            best = (bic, b[1:])
    return best[1]


def white(v, phi):
    return np.convolve(v, np.concatenate(([1], -phi)))[len(phi) : len(v)] if len(phi) else v


def ar_fits(spark, pmax):
    out = {}
    for key, t, v in runs(spark, ["subject", "run"]):
        x = np.column_stack([np.ones(len(t)), t / 10])
        if len(v) <= 2:
            out[key] = (None, -1, len(v))
            continue
        b = robust(x, v, "bisquare")
        for _ in range(4):
            phi = ar(v - x @ b, pmax)
            b = robust(np.column_stack([white(x[:, 0], phi), white(x[:, 1], phi)]), white(v, phi), "bisquare")
        out[key] = (b[1], len(phi), len(v))
    return out


@functools.cache
def _days(spark):
    return days(spark, SF).select("subject", "run", "trial_idx", "onset", "day", "VTC", "reaction_time").toPandas()


def runs(spark, keys):
    d = _days(spark).dropna(subset=["VTC"]).sort_values([*keys, "onset"])
    for key, g in d.groupby(keys):
        yield key, g.day.to_numpy(), g.VTC.to_numpy()


def r18(spark):
    return ar_fits(spark, 5)


def r19(spark):
    return {k: tuple(robust(np.column_stack([np.ones(len(t)), t / 10]), v, "huber")) for k, t, v in runs(spark, ["subject"])}


def r26(spark):
    by = {}
    for (s, _), (b, *_) in ar_fits(spark, 3).items():
        if b is not None:
            by.setdefault(s, []).append(b)
    m = np.array([np.mean(b) for b in by.values()])
    t = m.mean() / (m.std(ddof=1) / np.sqrt(len(m)))
    grid = np.linspace(0, abs(t), 200_001)  # the density of t, integrated
    from math import lgamma

    v = len(m) - 1
    density = np.exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / np.sqrt(v * np.pi) * (1 + grid**2 / v) ** (-(v + 1) / 2)
    return {(): (m.mean(), t, 1 - 2 * np.trapezoid(density, grid), len(m))}


def r27(spark):
    out = {}
    for s, g in fitted(spark, SF).toPandas().sort_values(["subject", "run", "trial_idx"]).groupby("subject"):
        e = (g.y - g.y_hat).dropna().to_numpy()
        phi = ar(e, 5)
        w = np.concatenate((e[: len(phi)], white(e, phi)))
        gap = 1 - (phi**2).sum()
        out[s,] = (len(phi), -len(w) / 2 * (np.log(2 * np.pi * np.mean(w**2)) + 1) + (0.5 * np.log(gap) if 0 < gap < 1 else 0))
    return out


def r31(spark):
    out = {}
    for (s, run), g in _days(spark).dropna(subset=["VTC"]).sort_values("trial_idx").groupby(["subject", "run"]):
        x, y = (g[c].to_numpy() - g[c].mean() for c in ("VTC", "reaction_time"))
        phi = ar(x, 5)
        x, y = (white(v, phi) for v in (x, y))
        x, y = ((v - v.mean()) / (v.std() or 1) for v in (x, y))
        full = np.correlate(y, x, "full") / len(x)
        out |= {(s, run, k): full[len(x) - 1 + k] for k in range(-3, 4) if abs(k) < len(x)}
    return out


def r15(spark):
    from tessera.functions import kernels as K

    out, b = {}, K.bspline(12, 5)
    for subject, g in v_samples(spark, SF).toPandas().sort_values("i").groupby("subject"):
        x, y = (g["event_type"] == "view").to_numpy(float), g["v"].to_numpy(float)
        if len(y) < 20:
            continue
        lags = np.array([[x[i - d] if i >= d else 0.0 for d in range(12)] for i in range(len(x))])
        design = np.column_stack([np.ones(len(y)), lags @ b])
        pinv = np.linalg.pinv(design)
        beta = pinv @ y
        e = y - design @ beta
        cov = pinv @ pinv.T * (e @ e) / (len(y) - np.linalg.matrix_rank(design))
        for d in range(12):
            out[(subject, d)] = (b[d] @ beta[1:], b[d] @ cov[1:, 1:] @ b[d])
    return out


PLAIN = {
    "r15_delay_response": (r15, ["subject", "delay"], ["h", "var"], 2e-4),
    "r18_fit_ar_irls": (r18, ["subject", "run"], ["b1", "order", "n"], 5e-5), "r19_fit_huber": (r19, ["subject"], ["b0", "b1"], 5e-5), "r26_robust_group_t": (r26, [], ["mean", "t", "p", "n"], 5e-5),
    "r27_ar_loglik": (r27, ["subject"], ["p", "loglik"], 1e-4), "r31_prewhitened_xcorr": (r31, ["subject", "run", "lag"], ["r"], 2e-5), "w21_find_peaks": (w21, ["subject", "i"], [], 0),
    "g11_band_logvar": (g11, ["subject", "trial_idx", "channel"], ["logvar"], 2e-5), "g14_band_power_at": (g14, ["subject", "trial_idx", "channel", "sample"], ["power"], 2e-8),
    "g15_butter_filtfilt": (g15, ["subject", "trial_idx", "channel"], ["energy"], 2e-6), "g16_envelope": (g16, ["subject", "trial_idx", "pos"], ["v"], 2e-5),
    "g19_pupil_pipeline": (g19, ["subject", "i"], ["v"], 2e-5), "g26_pc_scores": (g26, ["subject", "trial_idx", "i"], ["score", "ratio", "n90"], 2e-5),
}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_values(spark, name):
    plain, keys, values, tolerance = PLAIN[name]
    flat = lambda x: tuple(np.atleast_1d(np.asarray(x, dtype=float)).tolist()) if x is not None else (float("nan"),)
    wide = lambda k: k if isinstance(k, tuple) else (k,)
    want = {tuple(int(i) for i in wide(k)): sum((flat(x) for x in (v if isinstance(v, tuple) else (v,))), ()) for k, v in plain(spark).items()}
    got = {tuple(int(r[k]) for k in keys): tuple(float("nan") if r[v] is None else float(r[v]) for v in values) for r in Q[name](spark, SF).collect()}
    assert len(want) > 0 and set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=tolerance, nan_ok=True), (name, k)


# Known truths at operator level.


def ar_noise(rng, phi, n, sd):
    e = rng.normal(0, sd, n + 100)
    for t in range(len(phi), n + 100):
        e[t] += sum(p * e[t - 1 - k] for k, p in enumerate(phi))
    return e[100:]


def test_robust_ar_fit_recovers_truth_beside_outliers(spark):
    rng = np.random.default_rng(42)
    rows = []
    for unit in range(3):
        n = 1500
        x = (np.arange(n) // 25 % 2).astype(float)
        y = 2.5 + 1.5 * x + ar_noise(rng, (0.6, 0.25), n, 0.3)
        y[[200, 700, 1200]] += (1.5, -1.5, 1.5)
        rows += [(unit, i, 1.0, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "unit int, i int, const double, x double, y double").repartition(5)
    for r in R.fit_series(df, ["unit"], "y", ["const", "x"], "i", "ar_irls", pmax=6).collect():
        assert r["beta"][1] == pytest.approx(1.5, abs=0.15) and r["ar"][:2] == pytest.approx([0.6, 0.25], abs=0.1)
        assert abs(r["beta"][1] - 1.5) < 4 * np.sqrt(r["cov"][1][1])


def test_first_order_series(spark):
    v = 2 + ar_noise(np.random.default_rng(1), (0.7,), 500, 1.0)
    df = spark.createDataFrame([(1, i, float(x) - 2) for i, x in enumerate(v)], "k int, i int, e double")
    r = R.ar_loglik(df, ["k"], "e", "i").first()
    assert r["p"] == 1
    w = R.whiteness(df, ["k"], "e", "i").first()
    assert w["acf1"] == pytest.approx(0.7, abs=0.1) and w["correlated"]


def test_lagged_pair_peaks_at_its_lag(spark):
    rng = np.random.default_rng(3)
    x = ar_noise(rng, (0.7,), 400, 1.0)
    y = np.concatenate(([0, 0], 0.5 * x[:-2])) + rng.normal(0, 0.3, 400)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k int, i int, a double, b double")
    got = {r["lag"]: r["r"] for r in R.prewhitened_xcorr(df, ["k"], "a", "b", "i", 5).collect()}
    assert max(got, key=got.get) == 2 and got[2] > 0.5 and all(abs(got[k]) < 0.25 for k in got if k != 2)
    long = lambda c: df.select("k", "i", df[c].alias("v"))
    for norm in ("n", "overlap"):
        raw = {r["lag"]: r["r"] for r in S.xcorr(long("a"), long("b"), ["k"], 4, norm).collect()}
        za, zb = ((v - v.mean()) / v.std() for v in (x, y))
        for k, r in raw.items():
            pairs = [(i, i + k) for i in range(400) if 0 <= i + k < 400]
            assert r == pytest.approx(sum(za[i] * zb[j] for i, j in pairs) / (400 if norm == "n" else len(pairs)), abs=1e-9)


def test_two_sines_are_coherent_where_they_are(spark):
    rng = np.random.default_rng(7)
    t = np.arange(8192) / 100
    a, b = (np.sin(2 * np.pi * 10 * t + p) * 3 + rng.normal(0, 4, len(t)) for p in (0, np.pi / 2))
    df = lambda c, v: spark.createDataFrame([(1, c, [float(x) for x in v])], "k int, channel int, v array<double>")
    x, y = S.cross_spectra(df(0, a), ["k"], 100, 256), S.cross_spectra(df(1, b), ["k"], 100, 256)
    c = {r["f"] * 100 / 256: r["coherence"] for r in S.coherence(x, y, ["k"]).collect()}
    top = max(c, key=c.get)
    assert abs(top - 10) < 0.5 and c[top] > 0.8 and np.median(list(c.values())) < 0.1


def test_xcorr_with_gaps_and_no_overlap(spark):
    df = lambda rows: spark.createDataFrame(rows, "k int, i int, v double")
    a, b = df([(1, 0, 1.0), (1, 2, 3.0), (1, 5, 2.0), (2, 0, 1.0)]), df([(1, 2, 5.0), (1, 3, 1.0), (2, 9, 1.0), (3, 0, 1.0)])
    got = {(r["k"], r["lag"]): r["r"] for r in S.xcorr(a, b, ["k"], 3).collect()}
    za, zb = {0: -1.0, 2: 1.0, 5: 0.0}, {2: 1.0, 3: -1.0}
    sd = np.std([1, 3, 2])
    want = {}
    for i, x in za.items():
        for j, y in zb.items():
            if abs(j - i) <= 3:
                want[1, j - i] = want.get((1, j - i), 0) + x / sd * y / 3
    assert got == pytest.approx(want)
