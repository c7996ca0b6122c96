"""Numeric kernels that Spark has no function for: filters, spectra, robust and autoregressive fits, splines, peaks.

All work on one series or a small stack of series; the operators run them inside tasks.
"""

from __future__ import annotations

import functools

import numpy as np

from tessera.functions.stats import t_sf


def interpolate_missing(v: np.ndarray) -> np.ndarray:
    """NaN filled linearly, ends with the nearest value; all-NaN stays."""
    ok = np.isfinite(v)
    if ok.all() or not ok.any():
        return v
    at = np.arange(len(v))
    return np.interp(at, at[ok], v[ok])


def butter(order: int, low: float | None, high: float | None, fs: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of a digital Butterworth filter: low-pass (high only), high-pass or band-pass."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    zeros, gain = np.array([], dtype=complex), 1.0
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if low is None:
        w = warp(high)
        poles, gain = poles * w, gain * w**order
    elif high is None:
        w = warp(low)
        gain *= np.real(1 / np.prod(-poles))
        poles, zeros = w / poles, np.zeros(order, dtype=complex)
    else:
        w1, w2 = warp(low), warp(high)
        bw, w0 = w2 - w1, np.sqrt(w1 * w2)
        half = poles * bw / 2
        root = np.sqrt(half**2 - w0**2)
        poles, zeros, gain = np.concatenate((half + root, half - root)), np.zeros(order, dtype=complex), gain * bw**order
    k = 2 * fs
    degree = len(poles) - len(zeros)
    gain *= np.real(np.prod(k - zeros) / np.prod(k - poles))
    return np.concatenate(((k + zeros) / (k - zeros), -np.ones(degree))), (k + poles) / (k - poles), float(gain)


def sections(z: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) from conjugate pole pairs, the gain in the first."""

    def pairs(x: np.ndarray) -> list[np.ndarray]:
        cplx = sorted((c for c in x if c.imag > 1e-10), key=lambda c: abs(c))
        real = sorted((c.real for c in x if abs(c.imag) <= 1e-10), key=abs)
        out = [np.array([1, -2 * c.real, abs(c) ** 2]) for c in cplx]
        for i in range(0, len(real), 2):
            out.append(np.poly(real[i : i + 2]) if i + 1 < len(real) else np.array([1, -real[i], 0]))
        return out

    a, b = pairs(p), pairs(z)
    b += [np.array([1.0, 0, 0])] * (len(a) - len(b))
    sos = np.array([np.concatenate((x, y)) for x, y in zip(b, a, strict=True)])
    sos[0, :3] *= k
    return sos


_BLOCK = 128


@functools.lru_cache(64)
def _blocks(c: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a section does with a block of samples and a state: output from both, next state from both."""
    b0, b1, b2, _, a1, a2 = c
    step, enter = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(_BLOCK):
        powers.append(powers[-1] @ step)
    echo = np.array([b0, *(p[0] @ enter for p in powers[: _BLOCK - 1])])
    lag = np.arange(_BLOCK)[:, None] - np.arange(_BLOCK)
    return np.where(lag >= 0, echo[np.maximum(lag, 0)], 0.0), np.array([p[0] for p in powers[:_BLOCK]]), np.array([p @ enter for p in powers[_BLOCK - 1 :: -1]]).T, powers[_BLOCK]


def _section(x: np.ndarray, c: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One section over the last axis, series in parallel, from a start state (transposed direct form).

    Blocks of samples go through matrices at once; only the two state values run from block to block.
    """
    by_x, by_state, next_x, next_state = _blocks(tuple(map(float, c)))
    n = x.shape[-1]
    full = np.zeros((*x.shape[:-1], -(-n // _BLOCK) * _BLOCK))
    full[..., :n] = x
    full = full.reshape(*x.shape[:-1], -1, _BLOCK)
    s = np.stack(state, axis=-1)
    gained = full @ next_x.T
    states = np.empty((*full.shape[:-1], 2))
    for k in range(full.shape[-2]):
        states[..., k, :] = s
        s = s @ next_state.T + gained[..., k, :]
    return (full @ by_x.T + states @ by_state.T).reshape(*x.shape[:-1], -1)[..., :n]


def sosfiltfilt(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase pass: odd padding at both ends, steady-state start, forward and backward."""
    pad = min(3 * (2 * len(sos) + 1), x.shape[-1] - 1)
    if pad < 1:
        return x.copy()
    left = 2 * x[..., :1] - x[..., pad:0:-1]
    right = 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
    y = np.concatenate((left, x, right), axis=-1)
    for _ in range(2):
        level = y[..., 0]
        for c in sos:
            gain = c[:3].sum() / c[3:].sum()
            # Steady state for a constant input of that level.
            s2 = (c[2] - c[5] * gain) * level
            s1 = (c[1] - c[4] * gain) * level + s2
            y = _section(y, c, (s1, s2))
            level = level * gain
        y = y[..., ::-1]
    return y[..., pad : y.shape[-1] - pad]


def butter_filtfilt(x: np.ndarray, fs: float, low: float | None = None, high: float | None = None, order: int = 4) -> np.ndarray:
    return sosfiltfilt(sections(*butter(order, low, high, fs)), np.asarray(x, dtype=float))


def filtfilt_fir(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Forward and backward pass of a normalised FIR kernel with odd padding of three kernel lengths."""
    w = np.asarray(w, dtype=float) / np.sum(w)
    pad = min(3 * len(w), len(x) - 1)
    if pad < 1:
        return np.asarray(x, dtype=float).copy()
    y = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    for _ in range(2):
        y = np.convolve(np.concatenate((np.full(len(w) - 1, y[0]), y)), w, mode="valid")[::-1]
    return y[pad : len(y) - pad]


def gausswin(n: int, alpha: float = 2.5) -> np.ndarray:
    t = np.arange(n) - (n - 1) / 2
    return np.exp(-0.5 * (alpha * t / ((n - 1) / 2)) ** 2)


def welch(x: np.ndarray, fs: float, nperseg: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density: Hann segments with half overlap, mean removed."""
    n = min(nperseg, x.shape[-1])
    w = np.hanning(n + 1)[:-1]
    starts = range(0, x.shape[-1] - n + 1, max(1, n - n // 2))
    seg = np.stack([x[..., s : s + n] for s in starts], axis=-2)
    p = np.abs(np.fft.rfft((seg - seg.mean(axis=-1, keepdims=True)) * w)) ** 2 / (fs * (w**2).sum())
    p[..., 1 : None if n % 2 else -1] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p.mean(axis=-2)


def band_power(f: np.ndarray, p: np.ndarray, lo: float, hi: float, how: str = "integral") -> np.ndarray:
    m = (f >= lo) & (f <= hi)
    return np.trapezoid(p[..., m], f[m], axis=-1) if how == "integral" else p[..., m].mean(axis=-1)


def hann_psd(x: np.ndarray, fs: float) -> np.ndarray:
    w = np.hanning(x.shape[-1])
    return np.abs(np.fft.rfft(x * w)) ** 2 / (fs * (w**2).sum())


@functools.lru_cache(32)
def dpss(n: int, nw: float, k: int) -> np.ndarray:
    """First k Slepian tapers, from the symmetric tridiagonal eigenproblem."""
    i = np.arange(n)
    d = ((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * nw / n)
    e = i[1:] * (n - i[1:]) / 2
    _, v = np.linalg.eigh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    v = v[:, ::-1][:, :k].T
    v = v * np.where(v[:, [0]] + v[:, [1]] < 0, -1, 1)
    v.setflags(write=False)  # shared by all callers
    return v


def detrend(x: np.ndarray, order: int = 1) -> np.ndarray:
    t = np.linspace(-1, 1, x.shape[-1])
    basis = np.linalg.qr(np.vander(t, order + 1))[0]
    return x - (x @ basis) @ basis.T


def multitaper(x: np.ndarray, fs: float, nw: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Mean power over 2 NW - 1 tapers after a linear detrend."""
    n = x.shape[-1]
    tapers = dpss(n, nw, max(1, int(2 * nw - 1)))
    p = np.abs(np.fft.rfft(detrend(x)[..., None, :] * tapers)) ** 2 / fs
    return np.fft.rfftfreq(n, 1 / fs), p.mean(axis=-2)


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = x.shape[-1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * h))


def resample_fft(x: np.ndarray, m: int) -> np.ndarray:
    """Band-limited change of the number of samples."""
    n = x.shape[-1]
    s = np.fft.rfft(x)
    out = np.zeros((*x.shape[:-1], m // 2 + 1), dtype=complex)
    k = min(n, m) // 2 + 1
    out[..., :k] = s[..., :k]
    if min(n, m) % 2 == 0 and n != m:
        out[..., k - 1] *= 0.5 if m > n else 2.0
    if m < n and m % 2 == 0:
        out[..., k - 1] = out[..., k - 1].real
    return np.fft.irfft(out, m) * (m / n)


def morlet_power(x: np.ndarray, fs: float, freqs: np.ndarray) -> np.ndarray:
    """Power by frequency (first axis) of series (last axis), wavelets of f / 2 cycles with unit energy."""
    n, out = x.shape[-1], []
    for f in freqs:
        sd = f / 2 / (2 * np.pi * f)
        t = np.arange(-int(5 * sd * fs), int(5 * sd * fs) + 1) / fs
        w = np.exp(2j * np.pi * f * t - t**2 / (2 * sd**2))
        w = w / np.sqrt(0.5) / np.linalg.norm(w)
        size = n + len(w) - 1
        full = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(w, size))
        start = (size - n) // 2
        out.append(np.abs(full[..., start : start + n]) ** 2)
    return np.array(out)


def find_peaks(v: np.ndarray, distance: int, sign: int = 1) -> np.ndarray:
    """Local maxima (or minima), the highest kept first, at least `distance` samples apart."""
    x = v * sign
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
    near = np.zeros(len(x), dtype=bool)
    keep: list[int] = []
    for i in at[np.argsort(-x[at], kind="stable")].tolist():
        if not near[i]:
            keep.append(i)
            near[max(0, i - distance + 1) : i + distance] = True
    return np.array(sorted(keep), dtype=int)


def ols(x: np.ndarray, y: np.ndarray) -> dict:
    """Least squares (minimum norm if rank-deficient): beta, cov, residuals, scale, df."""
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    df = max(len(y) - rank, 1)
    scale = float(resid @ resid / df)
    return {"beta": beta, "cov": np.linalg.pinv(x.T @ x) * scale, "resid": resid, "scale": scale, "df": df}


def robust_weights(r: np.ndarray, norm: str = "bisquare") -> np.ndarray:
    """Weights of scaled residuals: Tukey's bisquare (4.685) or Huber (1.345)."""
    a = np.abs(r)
    if norm == "bisquare":
        return np.where(a < 4.685, (1 - (a / 4.685) ** 2) ** 2, 0.0)
    return np.where(a <= 1.345, 1.0, 1.345 / np.maximum(a, 1e-300))


#: Values of the series that are fitted side by side.
SIDE_BY_SIDE = 500_000


def irls(x: np.ndarray, y: np.ndarray, norm: str = "bisquare", steps: int = 50) -> dict:
    """Robust fit: scale is the median absolute residual / .6745, anew in each step."""
    return irls_many([x], [y], norm, steps)[0]


def irls_many(xs: list[np.ndarray], ys: list[np.ndarray], norm: str = "bisquare", steps: int = 50) -> list[dict]:
    """`irls` of many series, those of like length side by side; each stops at its own step."""
    out: list[dict] = [{}] * len(ys)
    order = sorted(range(len(ys)), key=lambda i: len(ys[i]))
    while order:
        size = max(1, SIDE_BY_SIDE // max(1, len(ys[order[-1]])))
        part, order = order[-size:], order[:-size]
        for i, root in zip(part, _irls_roots([xs[i] for i in part], [ys[i] for i in part], norm, steps), strict=True):
            fit = ols(xs[i] * root[:, None], ys[i] * root)
            out[i] = fit | {"resid": ys[i] - xs[i] @ fit["beta"], "weights": root**2}
    return out


def _irls_roots(xs: list[np.ndarray], ys: list[np.ndarray], norm: str, steps: int) -> list[np.ndarray]:
    """Roots of the last weights of each series; shorter ones are padded with rows of weight 0."""
    n = np.array([len(y) for y in ys])
    inside = np.arange(n.max()) < n[:, None]
    x, y = np.zeros((*inside.shape, xs[0].shape[1])), np.zeros(inside.shape)
    x[inside], y[inside] = np.concatenate(xs), np.concatenate(ys)
    beta = np.stack([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(xs, ys, strict=True)])
    roots = inside.astype(float)
    live = np.flatnonzero(n)
    for _ in range(steps):
        resid = y[live] - np.einsum("bmk,bk->bm", x[live], beta[live])
        ranked = np.sort(np.where(inside[live], np.abs(resid), np.inf), axis=1)
        at, c = np.arange(len(live)), n[live]
        scale = (ranked[at, (c - 1) // 2] + ranked[at, c // 2]) / 2 / 0.6745
        spread = ~(scale < 1e-12)
        live, resid, scale = live[spread], resid[spread], scale[spread]
        if not len(live):
            break
        root = np.sqrt(robust_weights(resid / scale[:, None], norm)) * inside[live]
        roots[live] = root
        xw, yw = x[live] * root[:, :, None], y[live] * root
        gram, right = np.swapaxes(xw, 1, 2) @ xw, np.einsum("bmk,bm->bk", xw, yw)
        # Normal equations are enough for a step; a singular one falls back to the minimum-norm solution.
        regular = np.linalg.cond(gram) < 1e10
        new = np.empty_like(right)
        new[regular] = np.linalg.solve(gram[regular], right[regular][:, :, None])[:, :, 0]
        for i in np.flatnonzero(~regular):
            new[i] = np.linalg.lstsq(xw[i], yw[i], rcond=None)[0]
        moved = ~(np.max(np.abs(new - beta[live]), axis=1) < 1e-8)
        beta[live] = new
        live = live[moved]
        if not len(live):
            break
    return [r[:k] for r, k in zip(roots, n, strict=True)]


def ar_fit(r: np.ndarray, pmax: int) -> np.ndarray:
    """AR coefficients by least squares with intercept, the order by BIC (0 .. pmax)."""
    n = len(r) - pmax
    if n <= pmax + 2:
        return np.zeros(0)
    y = r[pmax:]
    x = np.column_stack([np.ones(n)] + [r[pmax - k : len(r) - k] for k in range(1, pmax + 1)])
    # Nested orders share one moment matrix: by its Cholesky factor each lag takes its part off the residual sum.
    gram = x.T @ x
    if np.linalg.cond(gram) < 1e10:
        parts = np.linalg.solve(np.linalg.cholesky(gram), x.T @ y) ** 2
        rss = np.maximum(y @ y - np.cumsum(parts), 1e-300)
    else:
        rss = np.array([max(float(((y - x[:, : p + 1] @ np.linalg.lstsq(x[:, : p + 1], y, rcond=None)[0]) ** 2).sum()), 1e-300) for p in range(pmax + 1)])
    best = 0
    bic = n * np.log(rss / n) + np.arange(1, pmax + 2) * np.log(n)
    for p in range(1, pmax + 1):
        if bic[p] < bic[best] - 1e-9:
            best = p
    return np.linalg.lstsq(x[:, : best + 1], y, rcond=None)[0][1:]


def whiten(v: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """FIR filter [1, -phi]; the first len(phi) rows are dropped."""
    p = len(phi)
    out = v[p:].astype(float).copy()
    for k in range(1, p + 1):
        out -= phi[k - 1] * v[p - k : len(v) - k]
    return out


def ar_irls(x: np.ndarray, y: np.ndarray, pmax: int = 30, norm: str = "bisquare", rounds: int = 4, ar: np.ndarray | None = None) -> dict:
    """Robust fit, AR of its residuals, whitening of y and x, refit; one round with given coefficients."""
    return ar_irls_many([x], [y], pmax, norm, rounds, ar)[0]


def ar_irls_many(xs: list[np.ndarray], ys: list[np.ndarray], pmax: int = 30, norm: str = "bisquare", rounds: int = 4, ar: np.ndarray | None = None) -> list[dict]:
    """`ar_irls` of many series, with the robust fits side by side."""
    fits = irls_many(xs, ys, norm)
    phis = [np.zeros(0)] * len(ys)
    for _ in range(1 if ar is not None else rounds):
        phis = [np.asarray(ar, dtype=float) if ar is not None else ar_fit(y - x @ f["beta"], pmax) for x, y, f in zip(xs, ys, fits, strict=True)]
        fits = irls_many([whiten(x, p) for x, p in zip(xs, phis, strict=True)], [whiten(y, p) for y, p in zip(ys, phis, strict=True)], norm)
    return [f | {"ar": p} for f, p in zip(fits, phis, strict=True)]


def ar_loglik(resid: np.ndarray, phi: np.ndarray) -> float:
    """Gaussian log-likelihood of AR residuals, the first p kept as they are, with log sqrt |1 - sum phi^2| if positive."""
    p = len(phi)
    e = np.concatenate((resid[:p], whiten(resid, phi)))
    s2 = float(e @ e / len(e))
    gap = 1 - float(np.sum(np.square(phi)))
    return float(-len(e) / 2 * np.log(2 * np.pi * s2) - (e @ e) / (2 * s2) + (0.5 * np.log(gap) if 0 < gap < 1 else 0.0))


def bspline(n: int, df: int, degree: int = 3) -> np.ndarray:
    """(n, df) B-spline basis with intercept on [0, 1], clamped knots, by the Cox-de Boor recursion."""
    t = np.linspace(0, 1, n)
    inner = np.linspace(0, 1, df - degree + 1)
    knots = np.concatenate((np.zeros(degree), inner, np.ones(degree)))
    b = np.array([(t >= knots[i]) & (t < knots[i + 1]) for i in range(len(knots) - 1)], dtype=float).T
    b[t == 1, df - 1] = 1
    for d in range(1, degree + 1):
        for i in range(len(knots) - d - 1):
            left, right = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            b[:, i] = (b[:, i] * (t - knots[i]) / left if left else 0) + (b[:, i + 1] * (knots[i + d + 1] - t) / right if right else 0)
    return b[:, :df]


def contrast(fit: dict, chosen: np.ndarray) -> tuple[float, float, float]:
    """Joint F of chosen coefficients, and z with two-sided p of their sum."""
    from tessera.functions.stats import f_sf

    b, c = fit["beta"][chosen], fit["cov"][np.ix_(chosen, chosen)]
    f = float(b @ np.linalg.pinv(c) @ b / max(1, len(b)))
    z = float(b.sum() / np.sqrt(max(c.sum(), 1e-300)))
    return f, f_sf(f, len(b), fit["df"]), z


def t_p(t: float, df: float) -> float:
    return 2 * t_sf(abs(t), df)
