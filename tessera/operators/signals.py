"""Signal operators: filters, spectra, envelopes, resampling, cross-correlation, components of channels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from tessera.functions import kernels as K

_DOUBLES = ArrayType(DoubleType())


def per_series(fn: Callable[[np.ndarray], np.ndarray], stacked: bool = False) -> Callable[[Column | str], Column]:
    """A column function that maps each packed series by `fn`; batches go to Python as Arrow. Null series stay null.

    With `stacked`, `fn` takes the series of one length of a batch together, as rows of a matrix.
    """

    @pandas_udf(_DOUBLES)
    def run(v: pd.Series) -> pd.Series:
        if not stacked:
            return pd.Series([None if x is None else np.asarray(fn(np.asarray(x, dtype=float)), dtype=float) for x in v])
        out: list = [None] * len(v)
        by_length: dict[int, list[int]] = {}
        for k, x in enumerate(v):
            if x is not None:
                by_length.setdefault(len(x), []).append(k)
        for places in by_length.values():
            for k, y in zip(places, fn(np.stack([np.asarray(v.iloc[k], dtype=float) for k in places])), strict=True):
                out[k] = y
        return pd.Series(out)

    return run


def pack(samples: DataFrame, keys: list[str], order: str = "i", col: str = "v") -> DataFrame:
    """Long samples to one array per key, in order; one series is one run of one channel."""
    return samples.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).alias("x")))), lambda s: s["x"]).alias("v"))


def filtfilt_fir(samples: DataFrame, keys: list[str], length: int = 20, block: int = 4096) -> DataFrame:
    """(keys, i, v) smoothed without shift by a Gaussian window, forward and backward (W4); i counts from 0 without gaps.

    A value depends on `length` - 1 samples to each side, so a series is cut in blocks with so much more, and one of any length
    spans many tasks. Beyond its ends a series goes on by its odd reflection, of which a block has all it needs; one shorter than
    the window is one block.
    """
    if block <= 2 * length:
        raise ValueError("a block is longer than two windows")
    w, margin = K.gausswin(length), length - 1
    w = w / w.sum()
    ends = samples.groupBy(*keys).agg(F.count("*").alias("__n"), F.min_by("v", "i").alias("__a"), F.max_by("v", "i").alias("__z"))
    x = samples.select(*keys, "i", F.col("v").cast("double").alias("v")).join(ends, keys)
    last = F.floor((F.col("__n") - 1) / block)
    spans = F.sequence(F.greatest(F.lit(0), F.floor((F.col("i") - margin) / block)), F.least(last, F.floor((F.col("i") + margin) / block)))
    x = x.withColumn("__block", F.explode(spans)).groupBy(*keys, "__block", "__n", "__a", "__z").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("__s"))

    @pandas_udf(_DOUBLES)
    def smooth(at: pd.Series, n: pd.Series, a: pd.Series, z: pd.Series, first: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for b, size, head, tail, start, x in zip(at, n, a, z, first, v, strict=True):
            x = np.asarray(x, float)
            if size < length:
                out.append(K.filtfilt_fir(x, w))
                continue
            i = np.arange(b * block - margin, min(size, (b + 1) * block) + margin)
            inside = np.clip(np.where(i < 0, -i, np.where(i >= size, 2 * size - 2 - i, i)) - start, 0, len(x) - 1)
            y = np.where(i < 0, 2 * head - x[inside], np.where(i >= size, 2 * tail - x[inside], x[inside]))
            for _ in range(2):
                y = np.convolve(y, w, mode="valid")[::-1]
            out.append(y)
        return pd.Series(out)

    done = x.select(*keys, "__block", smooth("__block", "__n", F.col("__a").cast("double"), F.col("__z").cast("double"), F.col("__s")[0]["i"], "__s.v").alias("__v"))
    return done.select(*keys, "__block", F.posexplode("__v").alias("i", "v")).select(*keys, (F.col("__block") * block + F.col("i")).cast("int").alias("i"), "v")


def butter_filtfilt(series: DataFrame, fs: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """Order-4 zero-phase Butterworth filter."""
    return series.withColumn("v", per_series(lambda x: K.butter_filtfilt(x, fs, low, high), stacked=True)("v"))


def find_peaks(series: DataFrame, distance: int, sign: int = 1) -> DataFrame:
    """Places of local peaks at least `distance` samples apart, the highest first (W21), as array `peaks`."""
    return series.withColumn("peaks", per_series(lambda x: K.find_peaks(x, distance, sign))("v").cast("array<int>"))


def epoch_spectrum(epochs: DataFrame) -> DataFrame:
    """log10 FFT power per epoch, missing samples as 0."""
    return epochs.withColumn("v", per_series(lambda x: np.log10(np.abs(np.fft.rfft(np.nan_to_num(x))) ** 2 + 1e-30))("v"))


def hann_psd(epochs: DataFrame, fs: float) -> DataFrame:
    """Hann-windowed density without doubling."""
    return epochs.withColumn("v", per_series(lambda x: K.hann_psd(x, fs))("v"))


def band_power(epochs: DataFrame, fs: float, bands: dict[str, tuple[float, float]], how: str = "integral", nperseg: int = 256) -> DataFrame:
    """Welch power per band as columns."""

    def powers(x: np.ndarray) -> np.ndarray:
        f, p = K.welch(x, fs, nperseg)
        return np.array([K.band_power(f, p, lo, hi, how) for lo, hi in bands.values()])

    x = epochs.withColumn("__p", per_series(powers)("v"))
    return x.withColumns({name: F.col("__p")[i] for i, name in enumerate(bands)}).drop("__p")


def band_logvar(epochs: DataFrame, fs: float, low: float, high: float) -> DataFrame:
    """Log variance of the band-passed epoch."""
    return epochs.withColumn("logvar", per_series(lambda x: np.log(np.var(K.butter_filtfilt(x, fs, low, high), axis=-1, keepdims=True) + 1e-30), stacked=True)("v")[0])


def mean_by_place(epochs: DataFrame, keys: list[str], fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(keys, n, pos, v): mean over epochs, n samples long, of what `fn` makes of each; `fn` maps a matrix of epochs to one of values.

    Values are summed over the epochs of a key in each batch before anything leaves it, so what is shuffled are the
    values of a key, not of an epoch. Null epochs take no part.
    """
    kinds = ", ".join(f"{k} {epochs.schema[k].dataType.simpleString()}" for k in keys)

    def sums(batches):
        for pdf in batches:
            pdf = pdf[pdf["v"].notna()].assign(__n=lambda d: d["v"].map(len))
            for key, g in pdf.groupby([*keys, "__n"], dropna=False):
                total = fn(np.stack([np.asarray(x, dtype=float) for x in g["v"]])).sum(axis=0)
                yield pd.DataFrame({k: [None if pd.isna(z) else z] for k, z in zip([*keys, "n"], key, strict=True)} | {"epochs": [len(g)], "sums": [total]})

    parts = epochs.select(*keys, "v").mapInPandas(sums, f"{kinds}, n long, epochs long, sums array<double>")
    x = parts.select(*keys, "n", "epochs", F.posexplode("sums").alias("pos", "s"))
    return x.groupBy(*keys, "n", "pos").agg((F.sum("s") / F.sum("epochs")).alias("v"))


def multitaper_power(epochs: DataFrame, keys: list[str], fs: float, win: int, step: int, nw: float = 2.0) -> DataFrame:
    """Mean multitaper power (keys, window, f, v) over epochs and tapers, by window (from 0) and frequency."""

    def windows(x: np.ndarray) -> np.ndarray:
        starts = range(0, x.shape[-1] - win + 1, step)
        return K.multitaper(np.stack([x[:, s : s + win] for s in starts], axis=1), fs, nw)[1].reshape(len(x), -1)

    width = win // 2 + 1
    x = mean_by_place(epochs, keys, windows)
    return x.select(*keys, F.floor(F.col("pos") / width).cast("int").alias("window"), (F.col("pos") % width).alias("f"), "v")


def ratio_to_baseline(power: DataFrame, keys: list[str], t0: float, fs: float, step: int) -> DataFrame:
    """`power` (keys, window, f, v) as log10 of its ratio to the mean over the windows that begin before time 0."""
    before = power.filter(F.col("window") * step / fs + t0 < 0).groupBy(*keys, "f").agg(F.avg("v").alias("__r"))
    return power.join(before, [*keys, "f"]).withColumn("v", F.log10(F.try_divide("v", "__r"))).drop("__r")


def power_ratio(power: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """log10 of mean power over that of another condition at the same keys (G12, G25); both have (keys, v)."""
    j = power.join(reference.select(*keys, F.col("v").alias("__r")), keys)
    return j.withColumn("v", F.log10(F.greatest(F.try_divide("v", "__r"), F.lit(1e-30)))).drop("__r")


def alpha_power(epochs: DataFrame, fs: float, band: tuple[float, float] = (8.0, 12.0)) -> DataFrame:
    """Mean multitaper power in the alpha band per epoch."""

    def alpha(x: np.ndarray) -> np.ndarray:
        f, p = K.multitaper(x, fs)
        return p[:, (f >= band[0]) & (f <= band[1])].mean(axis=-1, keepdims=True)

    return epochs.withColumn("alpha", per_series(alpha, stacked=True)("v")[0])


def band_power_at(series: DataFrame, centres: DataFrame, keys: list[str], fs: float, band: tuple[float, float], half: int, how: Callable[[np.ndarray], float] = np.median) -> DataFrame:
    """Filtered, squared signal around given centre samples, summarised by a function (G14): `power`.

    Centres (keys, sample) are gathered per run, a few hundred; a window that leaves the series is cut.
    """
    c = centres.groupBy(*keys).agg(F.sort_array(F.collect_list("sample")).alias("__c"))

    @pandas_udf(_DOUBLES)
    def run(v: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for x, places in zip(v, at, strict=True):
            p = K.butter_filtfilt(np.asarray(x, float), fs, *band) ** 2
            out.append([float(how(p[max(0, int(i) - half) : int(i) + half + 1])) for i in places])
        return pd.Series(out)

    x = series.join(c, keys).withColumn("__p", run("v", F.col("__c").cast("array<double>")))
    return x.withColumn("__z", F.explode(F.arrays_zip("__c", "__p"))).select(*keys, *[k for k in ("channel",) if k in series.columns and k not in keys], F.col("__z.__c").alias("sample"), F.col("__z.__p").alias("power"))


def envelope(series: DataFrame, keys: list[str], fs: float, band: tuple[float, float]) -> DataFrame:
    """Mean over channels of the band's envelope, in long form (keys, pos, v)."""
    x = series.withColumn("v", per_series(lambda x: K.envelope(K.butter_filtfilt(x, fs, *band)), stacked=True)("v"))
    return x.select(*keys, F.posexplode("v").alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("v"))


def sampling_rate(samples: DataFrame, keys: list[str]) -> DataFrame:
    """1 / median time step."""
    d = F.col("t") - F.lag("t").over(W.partitionBy(*keys).orderBy("t"))
    return samples.withColumn("__d", d).groupBy(*keys).agg(F.try_divide(F.lit(1.0), F.percentile("__d", 0.5)).alias("rate"))


def resample_linear(samples: DataFrame, keys: list[str], hz: float) -> DataFrame:
    """Linear interpolation on a regular grid from the first to the last time."""
    from tessera.operators.joins import interp_join

    ends = samples.groupBy(*keys).agg(F.min("t").alias("__a"), F.max("t").alias("__b"))
    n = F.floor((F.col("__b") - F.col("__a")) * hz)
    grid = ends.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n))).select(*keys, "i", (F.col("__a") + F.col("i") / hz).alias("t"))
    return interp_join(grid, samples.select(*keys, F.col("t").alias("ts"), "v"), keys, "t", "ts", "v", "v")


def resample_fft(series: DataFrame, m: int) -> DataFrame:
    """Band-limited resampling to m samples."""
    return series.withColumn("v", per_series(lambda x: K.resample_fft(x, m))("v"))


def truncate_common(series: DataFrame, keys: list[str]) -> DataFrame:
    """Series cut to the shortest length of their key."""
    return series.withColumn("v", F.slice("v", F.lit(1), F.min(F.size("v")).over(W.partitionBy(*keys))))


def pupil_pipeline(gaze: DataFrame, blinks: DataFrame, keys: list[str], hz: float = 60.0, min_valid: float = 0.7, order: int = 2, cutoff: float = 4.0) -> DataFrame:
    """Clean pupil series (keys, v) (G19): mask blinks, reject runs under `min_valid`, fill, detrend, low-pass, resample.

    `gaze` has t and v (both eyes' mean). The relational steps are joins and windows; the numeric tail
    runs per packed run.
    """
    from tessera.operators.joins import mask_intervals

    x = mask_intervals(gaze.select(*keys, "t", "v"), blinks, keys)
    ok = x.groupBy(*keys).agg(F.avg(F.col("v").isNotNull().cast("int")).alias("__s")).filter(F.col("__s") >= min_valid)
    x = x.join(ok.select(*keys), keys, "left_semi")
    runs = x.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("__x"))

    @pandas_udf(_DOUBLES)
    def clean(ts: pd.Series, vs: pd.Series) -> pd.Series:
        out = []
        for t, v in zip(ts, vs, strict=True):
            t = np.asarray(t, float)
            v = K.detrend(K.interpolate_missing(np.array([np.nan if a is None else a for a in v], float)), order)
            rate = 1 / np.median(np.diff(t))
            if cutoff < rate / 2:
                v = K.butter_filtfilt(v, rate, None, cutoff)
            out.append(np.interp(np.arange(t[0], t[-1] + 1e-9, 1 / hz), t, v))
        return pd.Series(out)

    return runs.filter(F.size("__x") >= 3).select(*keys, clean(F.transform("__x", lambda s: s["t"]), F.transform("__x", lambda s: s["v"])).alias("v"))


def xcorr(a: DataFrame, b: DataFrame, keys: list[str], max_lag: int, norm: str = "n", block: int = 4096) -> DataFrame:
    """(keys, lag, r) of z-scored series (keys, i, v) (G20, G21): a at i against b at i + lag.

    norm='n' divides by n, 'overlap' by n - |lag|. The series are cut in blocks of `block` places, those of b with `max_lag` more to
    either side, so a series of any length spans many tasks; a block gives a sum of products per lag, and Spark adds them. Means and
    deviations are aggregates of the key. A lag without a pair of samples has no row, one without a pair of values a null.
    """
    size, wide = block, block + 2 * max_lag
    stats = lambda df, c: df.groupBy(*keys).agg(F.avg("v").alias(f"m{c}"), F.stddev_pop("v").alias(f"s{c}"), F.count("*").alias(f"n{c}"))
    packed = lambda df, c: df.groupBy(*keys, "__block").agg(F.collect_list(F.struct("i", F.coalesce(F.col("v").cast("double"), F.lit(float("nan"))).alias("v"))).alias(c))
    left = packed(a.withColumn("__block", F.floor(F.col("i") / block)), "pa")
    spans = F.sequence(F.floor((F.col("i") - max_lag) / block), F.floor((F.col("i") + max_lag) / block))
    right = packed(b.withColumn("__block", F.explode(spans)), "pb")

    @pandas_udf("array<double>")
    def products(at: pd.Series, ia: pd.Series, va: pd.Series, ib: pd.Series, vb: pd.Series, ma: pd.Series, sa: pd.Series, mb: pd.Series, sb: pd.Series) -> pd.Series:
        out = []
        for first, places, x, others, y, *moments in zip(at * block, ia, va, ib, vb, ma, sa, mb, sb, strict=True):
            dense = []
            for where, values, start, n, mean, sd in ((places, x, first, size, *moments[:2]), (others, y, first - max_lag, wide, *moments[2:])):
                z = (np.asarray(values, float) - mean) / sd if sd and sd > 0 else np.full(len(values), np.nan)
                k = np.asarray(where) - int(start)
                own = np.zeros((3, n))  # values, whether there is one, whether there is a sample
                own[0, k], own[1, k], own[2, k] = np.nan_to_num(z), np.isfinite(z), 1
                dense.append(own)
            shifted = np.lib.stride_tricks.sliding_window_view(dense[1], size, axis=1)
            out.append(np.einsum("cls,cs->cl", shifted, dense[0]).ravel())
        return pd.Series(out)

    x = left.join(right, [*keys, "__block"]).join(stats(a, "a"), keys).join(stats(b, "b").drop("nb"), keys)
    x = x.select(*keys, "na", products(F.col("__block").cast("long"), "pa.i", "pa.v", "pb.i", "pb.v", *[F.col(c).cast("double") for c in ("ma", "sa", "mb", "sb")]).alias("__s"))
    x = x.select(*keys, "na", "__s", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"))
    part = lambda k: F.sum(F.get("__s", F.col("lag") + max_lag + k * (2 * max_lag + 1)))
    g = x.groupBy(*keys, "lag").agg(F.max("na").alias("n"), *[part(k).alias(f"__{k}") for k in range(3)]).filter(F.col("__2") > 0)
    d = F.col("n") if norm == "n" else F.col("n") - F.abs("lag")
    return g.select(*keys, "lag", F.try_divide(F.when(F.col("__1") > 0, F.col("__0")), d).alias("r"))


def cross_spectra(series: DataFrame, keys: list[str], fs: float, nperseg: int) -> DataFrame:
    """Per series, segment spectra (keys, channel, n_f, re, im), packed by segment, then frequency: half-overlapping Hann segments."""

    def spectra(x: np.ndarray) -> np.ndarray:
        n = min(nperseg, x.shape[-1])
        w = np.hanning(n + 1)[:-1]
        seg = np.stack([x[:, s : s + n] for s in range(0, x.shape[-1] - n + 1, max(1, n // 2))], axis=1)
        s = np.fft.rfft((seg - seg.mean(axis=-1, keepdims=True)) * w).reshape(len(x), -1)
        return np.concatenate([s.real, s.imag], axis=-1)

    n_f = (F.floor(F.least(F.lit(nperseg), F.size("v")) / 2) + 1).cast("int")
    x = series.select(*keys, "channel", n_f.alias("n_f"), per_series(spectra, stacked=True)("v").alias("__s"))
    half = (F.size("__s") / 2).cast("int")
    return x.select(*keys, "channel", "n_f", F.slice("__s", F.lit(1), half).alias("re"), F.slice("__s", half + 1, half).alias("im"))


def coherence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Magnitude-squared coherence of each channel of a with b, mean over b's channels (G23), from `cross_spectra`.

    Spectra are made once per channel; a pair of channels is one row with both packed spectra.
    """

    @pandas_udf(_DOUBLES)
    def pair(n_f: pd.Series, re: pd.Series, im: pd.Series, re2: pd.Series, im2: pd.Series) -> pd.Series:
        out = []
        for n, *parts in zip(n_f, re, im, re2, im2, strict=True):
            r, i, r2, i2 = (np.asarray(p, dtype=float).reshape(-1, int(n)) for p in parts)
            x, y = r + 1j * i, r2 + 1j * i2
            both = (np.abs(x) ** 2).mean(axis=0) * (np.abs(y) ** 2).mean(axis=0)
            cross = np.abs((x * y.conj()).mean(axis=0)) ** 2
            out.append(np.divide(cross, both, out=np.full(int(n), np.nan), where=both > 0))
        return pd.Series(out)

    y = b.select(*keys, F.col("channel").alias("other"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    j = a.join(y, keys).select(*keys, "channel", F.posexplode(pair("n_f", "re", "im", "re2", "im2")).alias("f", "c"))
    return j.groupBy(*keys, "channel", "f").agg(F.avg(F.when(~F.isnan("c"), F.col("c"))).alias("coherence"))


def source_spectrum(series: DataFrame, source: str, fs: float, nperseg: int) -> DataFrame:
    """Welch spectrum per channel, mean per source (source, pos, v); channels with anything missing are skipped."""
    ok = series.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    x = ok.withColumn("v", per_series(lambda x: K.welch(x, fs, nperseg)[1])("v"))
    return x.select(source, "channel", F.posexplode("v").alias("pos", "v")).groupBy(source, "channel", "pos").agg(F.avg("v").alias("v")).groupBy(source, "pos").agg(F.avg("v").alias("v"))


def morlet_power(epochs: DataFrame, keys: list[str], fs: float, freqs: list[float]) -> DataFrame:
    """Mean wavelet power over epochs (keys, freq, pos, v)."""
    fr = np.array(freqs)
    x = mean_by_place(epochs, keys, lambda m: K.morlet_power(m, fs, fr).swapaxes(0, 1).reshape(len(m), -1))
    f = F.get(F.array(*[F.lit(float(z)) for z in freqs]), F.floor(F.col("pos") / F.col("n")).cast("int"))
    return x.select(*keys, f.alias("freq"), (F.col("pos") % F.col("n")).alias("pos"), "v")


def channel_products(c: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, channel, other, s): sums of products of all pairs of channels over the times i of (keys, channel, i, x).

    The channels of a time are one row; matrices are summed in each batch before anything is shuffled, so the
    number of rows is that of times, not of pairs at times. A missing channel takes no part.
    """
    kinds = ", ".join(f"{k} {c.schema[k].dataType.simpleString()}" for k in keys)
    channel = c.schema["channel"].dataType.simpleString()
    times = c.filter("x is not null").groupBy(*keys, "i").agg(F.sort_array(F.collect_list(F.struct("channel", "x"))).alias("z"))
    times = times.select(*keys, F.transform("z", lambda s: s["channel"]).alias("names"), F.transform("z", lambda s: s["x"]).alias("xs"))

    def products(batches):
        for pdf in batches:
            # One frame leaves a batch, whatever the number of its keys.
            group = pdf.groupby(keys, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), int)
            order = np.argsort(group, kind="stable")
            first = np.unique(group[order], return_index=True)[1]
            own, xs, made = pdf["names"].to_numpy(), pdf["xs"].to_numpy(), []
            for rows in np.split(order, first[1:]):
                names = sorted(set().union(*own[rows]))
                at = {k: i for i, k in enumerate(names)}
                m = np.zeros((len(rows), len(names)))
                for row, r in enumerate(rows):
                    m[row, [at[k] for k in own[r]]] = xs[r]
                made.append((rows[0], names, m.T @ m))
            if made:
                sizes = [len(names) ** 2 for _, names, _ in made]
                heads = pdf[keys].iloc[np.repeat([r for r, _, _ in made], sizes)].reset_index(drop=True)
                yield heads.assign(
                    channel=np.concatenate([np.repeat(names, len(names)) for _, names, _ in made]),
                    other=np.concatenate([np.tile(names, len(names)) for _, names, _ in made]),
                    s=np.concatenate([s.ravel() for _, _, s in made]),
                )

    parts = times.mapInPandas(products, f"{kinds}, channel {channel}, other {channel}, s double")
    return parts.groupBy(*keys, "channel", "other").agg(F.sum("s").alias("s"))


def pc_scores(samples: DataFrame, keys: list[str]) -> DataFrame:
    """First principal component over channels per time (keys, i, score, ratio).

    Channel covariances are sums over rows of one time with all its channels; the eigenproblem is channels x
    channels; scores are a join with the weights. The sign makes the largest weight positive.
    """
    w = W.partitionBy(*keys, "channel")
    c = samples.withColumn("x", F.col("v") - F.avg("v").over(w)).select(*keys, "channel", "i", "x")
    cov = channel_products(c, keys)
    kind = samples.schema["channel"].dataType.simpleString()

    @pandas_udf(f"array<struct<channel: {kind}, weight: double, ratio: double, n90: int>>")
    def first(pairs: pd.Series) -> pd.Series:
        out = []
        for rows in pairs:
            names = sorted({p["channel"] for p in rows})
            at = {c: i for i, c in enumerate(names)}
            m = np.zeros((len(names), len(names)))
            for p in rows:
                m[at[p["channel"]], at[p["other"]]] = p["s"]
            values, vectors = np.linalg.eigh(m)
            v = vectors[:, -1] * np.sign(vectors[np.argmax(np.abs(vectors[:, -1])), -1])
            share = values[::-1] / max(values.sum(), 1e-300)
            n90 = int(np.searchsorted(np.cumsum(share), 0.9 - 1e-12) + 1)
            out.append([(c, float(w), float(share[0]), n90) for c, w in zip(names, v, strict=True)])
        return pd.Series(out)

    # The keys of a batch are solved in one Python call: a group each would cost more than its small matrix.
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = cov.repartition(parts, *keys).groupBy(*keys).agg(F.collect_list(F.struct("channel", "other", "s")).alias("__m"))
    weights = packed.select(*keys, F.explode(first("__m")).alias("__w")).select(*keys, "__w.*")
    return c.join(weights, [*keys, "channel"]).groupBy(*keys, "i").agg(F.sum(F.col("x") * F.col("weight")).alias("score"), F.max("ratio").alias("ratio"), F.max("n90").alias("n90"))


def trace_on_grid(df: DataFrame, keys: list[str], x: str, v: str, points: int = 100) -> DataFrame:
    """Run traces on a common [0, 1] grid (keys, g, v)."""
    from tessera.operators.joins import interp_join

    grid = df.select(*keys).distinct().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("gt", F.col("g") / (points - 1.0))
    return interp_join(grid, df.select(*keys, F.col(x).alias("ts"), F.col(v).alias("v")), keys, "gt", "ts", "v", "v")
