"""Trial tables: timing, markers, variability time course, zones and error profiles."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions.scalars import WHOLE, grid, whole
from tessera.operators.ranges import exact_quantiles

RUN = ["subject", "run"]


def drop_last_trial(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Without the last (fade-out) trial of each run."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter("__r > 1").drop("__r")


def trial_timing(df: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """onset = clock - start + device offset; duration = next clock - clock, null for the last."""
    following = F.lead("onset_clock").over(W.partitionBy(*keys).orderBy("trial_idx"))
    return df.withColumns(
        {"onset": F.col("onset_clock") - F.col("start_clock") + F.col("device_offset"), "duration": following - F.col("onset_clock")}
    )


def markers(df: DataFrame, sfreq: float) -> DataFrame:
    """Stimulus-locked markers and their response-locked copies at onset + rt.

    The copy's id is moved 10 away from zero and its rt negated; samples are truncated toward zero.
    """
    base = df.select("subject", "run", "trial_idx", F.lit("stimulus").alias("lock"), F.col("response_code").alias("event"), "onset", "reaction_time")
    code = F.col("event")
    moved = base.select(
        "subject",
        "run",
        "trial_idx",
        F.lit("response").alias("lock"),
        F.when(code < 0, code - 10).otherwise(code + 10).alias("event"),
        (F.col("onset") + F.col("reaction_time")).alias("onset"),
        (-F.col("reaction_time")).alias("reaction_time"),
    )
    return base.unionByName(moved).withColumn("sample", (F.col("onset") * sfreq).cast("long"))


def filter_in_range(marks: DataFrame, recordings: DataFrame, tmin: float, tmax: float, sfreq: float) -> DataFrame:
    """Markers whose window fits the recording (subject, run, n_samples)."""
    before, after = int(abs(tmin) * sfreq), int(abs(tmax) * sfreq)
    joined = marks.join(recordings, RUN)
    return joined.filter((F.col("sample") >= before) & (F.col("sample") <= F.col("n_samples") - after)).drop("n_samples")


def _around(col: str, keys: list[str], order: str) -> tuple[Column, Column]:
    """The last point (i, x) with a value up to each row, and the first from it on.

    Both windows grow from one end: one that ends at the last row would be evaluated anew for every row.
    """
    point = F.when(F.col(col).isNotNull(), F.struct(F.col(order).alias("i"), F.col(col).alias("x")))
    w = W.partitionBy(*keys)
    return tuple(F.last(point, ignorenulls=True).over(w.orderBy(o).rowsBetween(W.unboundedPreceding, 0)) for o in (order, F.desc(order)))


def fill(df: DataFrame, col: str, keys: list[str], order: str, method: str = "linear", out: str | None = None) -> DataFrame:
    """Fill nulls over the order within the keys.

    linear: between neighbours, ends take the nearest value (the least-squares 'spring' fill of a
    vector is the same); previous: last value, the start takes the first; extrapolate: linear, ends go
    on along the two nearest points.
    """
    out = out or f"{col}_filled"
    df = df.withColumns(dict(zip(("__p", "__n"), _around(col, keys, order), strict=True)))
    p, n = F.col("__p"), F.col("__n")
    slope = (n["x"] - p["x"]) / (n["i"] - p["i"])
    linear = F.when(p["i"] == n["i"], p["x"]).when(p.isNotNull() & n.isNotNull(), p["x"] + slope * (F.col(order) - p["i"]))
    if method == "previous":
        value = F.coalesce(p["x"], n["x"])
    elif method == "extrapolate":
        w = W.partitionBy(*keys).orderBy(order)
        every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        # Only the two points at each end are needed; null-skipping ranks find them without gathering the run.
        rank = F.when(F.col(col).isNotNull(), F.count(col).over(w.rowsBetween(W.unboundedPreceding, 0)))
        back = F.when(F.col(col).isNotNull(), F.count(col).over(W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)))
        df = df.withColumns({"__r": rank, "__b": back})
        df = df.withColumns(
            {f"__{name}{k}": F.max(F.when(F.col(c) == k, F.struct(F.col(order).alias("i"), F.col(col).alias("x")))).over(every) for name, c in (("s", "__r"), ("e", "__b")) for k in (1, 2)}
        )
        line = lambda a, b: a["x"] + (a["x"] - b["x"]) / (a["i"] - b["i"]) * (F.col(order) - a["i"])
        value = F.coalesce(
            linear,
            F.when(p.isNull(), F.coalesce(line(F.col("__s1"), F.col("__s2")), n["x"])),
            F.when(n.isNull(), F.coalesce(line(F.col("__e1"), F.col("__e2")), p["x"])),
        )
    else:
        value = F.coalesce(linear, p["x"], n["x"])
    return df.withColumn(out, value).drop("__p", "__n", "__r", "__b", "__s1", "__s2", "__e1", "__e2")


def vtc(df: DataFrame, base: str = "pressed", keys: list[str] = RUN) -> DataFrame:
    """Variability time course |(rt - mean) / population SD| of the filled reaction times.

    A reaction time of 0 is 'no press'. base='pressed': mean and SD over pressed trials; 'all': over
    all trials, zeros included.
    """
    rt = F.when(F.col("reaction_time") != 0, F.col("reaction_time"))
    df = fill(df.withColumn("__rt", rt), "__rt", keys, "trial_idx", out="rt_filled")
    w = W.partitionBy(*keys)
    x = "__rt" if base == "pressed" else "reaction_time"
    sd = F.stddev_pop(x).over(w)
    return df.withColumn("VTC", F.when(sd > 0, F.abs((F.col("rt_filled") - F.avg(x).over(w)) / sd))).drop("__rt")


def exact_vtc(df: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """`vtc` over pressed trials from whole-number sums, so that it doesn't depend on the order of rows: zones compare it.

    With u the press times in billionths, n their number, s and q the sums of u and its squares, |n u - s| / sqrt(n q - s^2).
    """
    rt = F.when(F.col("reaction_time") != 0, F.col("reaction_time"))
    df = fill(df.withColumn("__rt", rt), "__rt", keys, "trial_idx", out="rt_filled")
    w, u = W.partitionBy(*keys), whole(F.col("__rt"))
    df = df.withColumns({"__n": F.count("__rt").over(w), "__s": F.sum(u).over(w), "__q": F.sum(u * u).over(w)})
    n, s = F.col("__n"), F.col("__s")
    spread = n * F.col("__q") - s * s
    deviation = F.abs(n * whole(F.col("rt_filled")) - s)
    return df.withColumn("VTC", F.when(spread > 0, deviation.cast("double") / F.sqrt(spread.cast("double")))).drop("__rt", "__n", "__s", "__q")


def gauss_kernel(length: int | None = 20) -> list[float]:
    """Weights from -r to r: SD (L-1)/5 and r = ceil((L-1)/2) for a length, else SD 12 and r = 48."""
    sd, radius = ((length - 1) / 5, math.ceil((length - 1) / 2)) if length else (12.0, 48)
    w = [math.exp(-0.5 * (k / sd) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def gauss_smooth(df: DataFrame, col: str, keys: list[str], order: str, length: int | None = 20, out: str | None = None, kernel: list[float] | None = None) -> DataFrame:
    """Gaussian smoothing over the order with reflected edges (d c b a | a b c d | d c b a).

    One packed array per key, then array functions: each value is a weighted sum at folded places.
    """
    kernel = kernel or gauss_kernel(length)
    radius = len(kernel) // 2
    weights = F.array(*[F.lit(x) for x in kernel])
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*rest).alias("__row")))).alias("__v"))
    packed = packed.withColumn("__x", F.transform("__v", lambda v: v["__row"][col])).withColumn("__n", F.size("__x"))

    def folded(i: Column) -> Column:
        m = F.pmod(i, 2 * F.col("__n"))
        return F.when(m < F.col("__n"), m).otherwise(2 * F.col("__n") - 1 - m)

    def at(i: Column) -> Column:
        terms = F.transform(F.sequence(F.lit(0), F.lit(2 * radius)), lambda k: F.get("__x", folded(i + k - radius).cast("int")) * F.get(weights, k))
        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)

    packed = packed.withColumn("__s", F.transform("__x", lambda _, i: at(i)))
    rows = packed.select(*keys, F.posexplode("__v").alias("__i", "__r"), "__s")
    return rows.select(*keys, "__r.__row.*", F.get("__s", F.col("__i")).alias(out or f"{col}_smoothed"))


def median_by(df: DataFrame, keys: list[str], col: str, q: float = 0.5, out: str = "threshold") -> DataFrame:
    """Exact quantile per key with linear interpolation (A6, A7), for keys of any size; null where a key has no value."""
    return exact_quantiles(df, keys, col, [q], "__q").select(*keys, F.col("__q")[0].alias(out))


def zone_label(df: DataFrame, by: str, scope: list[str], closed: str = "out", q_low: float = 0.5, q_high: float | None = None, computed: bool = True) -> DataFrame:
    """zone 'in' below the threshold of the scope, else 'out'; null values have no zone (W6, W6b, W6c, W6d).

    Ties at the threshold are 'out', or 'in' if closed='in'. With q_high, values in between have none. Computed values are
    compared by their step of the grid, measured ones as they are.
    """
    steps = grid if computed else (lambda c: c)
    cuts = [q_low] if q_high is None else [q_low, q_high]
    cut = df.groupBy(*scope).agg(F.percentile(steps(F.col(by)), F.array(*[F.lit(q) for q in cuts])).alias("__q"))
    x, low, high = steps(F.col(by)), F.col("__q")[0], F.col("__q")[len(cuts) - 1]
    inside = x <= low if closed == "in" else x < low
    outside = x >= high if q_high is not None else x.isNotNull()
    return df.join(cut, scope).withColumn("zone", F.when(inside, "in").when(outside, "out")).drop("__q")


def zone_by_window_mean(trials: DataFrame, samples: DataFrame, keys: list[str], lo: float, hi: float, min_n: int, scope: list[str], on: str = "onset") -> DataFrame:
    """Zones by the mean of a sampled signal around each trial (W6d): 'in' below the scope's median, else 'out'.

    (keys, trial_idx, mean_v, zone); the window is [on + lo, on + hi). Trials with fewer than `min_n` samples have no mean: they
    don't count for the median and are dropped. Trials that share their samples have equal means: means are compared by their step
    of the grid.
    """
    from tessera.operators.joins import window_mean

    means = window_mean(trials, samples, keys, lo, hi, min_n, on).withColumn("__m", grid(F.col("mean_v")))
    cut = exact_quantiles(means, scope, "__m", [0.5], "__q")
    return means.join(cut, scope).select(*keys, "trial_idx", "mean_v", F.when(F.col("__m") < F.col("__q")[0], "in").otherwise("out").alias("zone"))


def zone_confusion(df: DataFrame, keys: list[str] = ["subject", "run", "zone"]) -> DataFrame:  # noqa: B006
    """Counts per zone: correct omission, commission error, correct commission, omission error (A1)."""
    return df.filter("zone is not null").groupBy(*keys).agg(
        *[F.count_if(F.col("condition") == c).alias(n) for c, n in (("mnt_correct", "co"), ("mnt_incorrect", "ce"), ("city_correct", "cc"), ("city_incorrect", "oe"))]
    )


def zone_error_rates(confusion: DataFrame) -> DataFrame:
    """Commission and omission error rates; 0 / 0 is null (A2)."""
    return confusion.withColumns(
        {"ce_rate": F.try_divide(F.col("ce"), F.col("ce") + F.col("co")), "oe_rate": F.try_divide(F.col("oe"), F.col("oe") + F.col("cc"))}
    )


def zone_rt_stats(df: DataFrame, keys: list[str] = ["subject", "run", "zone"]) -> DataFrame:  # noqa: B006
    """Mean and sample SD of correct press times per zone (A3), from whole-number sums: the order of rows doesn't matter."""
    u = whole(F.col("reaction_time"))
    x = df.filter("condition = 'city_correct' and zone is not null").groupBy(*keys).agg(F.count("reaction_time").alias("__n"), F.sum(u).alias("__s"), F.sum(u * u).alias("__q"))
    n, s = F.col("__n"), F.col("__s")
    sd = F.sqrt((n * F.col("__q") - s * s).cast("double") / (n * (n - 1))) / float(WHOLE)
    return x.select(*keys, F.try_divide(s.cast("double") / float(WHOLE), n).alias("rt_mean"), F.when(n > 1, sd).alias("rt_sd"))


def pre_outcome_rt(df: DataFrame, keys: list[str] = ["subject", "zone"]) -> DataFrame:  # noqa: B006
    """Mean press time of the trial before each outcome, if it was a correct city trial, by current zone (A4)."""
    w = W.partitionBy(*RUN).orderBy("trial_idx")
    prev = F.when(F.lag("condition").over(w) == "city_correct", F.lag("reaction_time").over(w))
    x = df.withColumn("__p", prev).filter("zone is not null")
    return x.groupBy(*keys).agg(
        *[F.avg(F.when(F.col("condition") == c, F.col("__p"))).alias(f"pre_{n}") for c, n in (("mnt_correct", "co"), ("mnt_incorrect", "ce"), ("city_incorrect", "oe"))]
    )


def zone_share(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of trials in and out of the zone per event."""
    return df.filter("zone is not null").groupBy(*keys).agg(
        F.count("*").alias("n"), (F.count_if(F.col("zone") == "in") / F.count("*")).alias("share_in"), (F.count_if(F.col("zone") == "out") / F.count("*")).alias("share_out")
    )


def zone_rt_diff(df: DataFrame, keys: list[str]) -> DataFrame:
    """Correct press time in minus out of the zone, in milliseconds (A32), from whole-number sums."""
    x = df.filter("condition = 'city_correct'")
    rt = lambda z: F.when(F.col("zone") == z, F.col("reaction_time"))
    mean = lambda z: F.try_divide(F.sum(whole(rt(z))).cast("double") / float(WHOLE), F.count(rt(z)))
    return x.groupBy(*keys).agg(((mean("in") - mean("out")) * 1000).alias("rt_diff_ms"))


@functools.lru_cache(maxsize=64)
def _transfer(n: int, sigmas: tuple[float, ...]) -> np.ndarray:
    """What each frequency of a run of n mirrored to 2 n places keeps, by width: the spectrum of the truncated kernel, folded to 2 n places."""
    out = np.ones((len(sigmas), n + 1))
    for row, s in zip(out, sigmas, strict=True):
        if s:
            radius = int(4 * s + 0.5)
            k = np.arange(-radius, radius + 1)
            w = np.exp(-0.5 * (k / s) ** 2)
            row[:] = np.fft.rfft(np.bincount(k % (2 * n), w / w.sum(), minlength=2 * n)).real
    return out


#: Values of all widths together that the sweep of one run holds at a time.
_SWEEP_VALUES = 4_000_000


def _sweep(x: np.ndarray, rt: np.ndarray, sigmas: tuple[float, ...]) -> list[float | None]:
    """In minus out mean of rt for each width; rt is not a number where a trial doesn't count."""
    n, some = len(x), ~np.isnan(rt)
    times = np.where(some, rt, 0.0)
    if np.isnan(x).any():
        return [None] * len(sigmas)
    # Reflected edges (d c b a | a b c d | d c b a) have period 2 n, so one transform of a run serves every width.
    spectrum = np.fft.rfft(np.concatenate([x, x[::-1]]))
    out: list[float | None] = []
    step = max(1, _SWEEP_VALUES // (2 * n))
    for at in range(0, len(sigmas), step):
        part = sigmas[at : at + step]
        kept = _transfer(n, part) if n <= 4096 else _transfer.__wrapped__(n, part)
        smooth = np.fft.irfft(spectrum * kept, 2 * n)[:, :n]
        for k, s in enumerate(part):
            if not s:
                smooth[k] = x
        # All widths of a part at once: sums and counts of each side are products with the sides' masks.
        inside = smooth < np.median(smooth, axis=1)[:, None]
        sums, counts = inside @ times, inside @ some.astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = sums / counts - (times.sum() - sums) / (some.sum() - counts)
        out.extend(None if np.isnan(v) else float(v) for v in np.where((counts > 0) & (counts < some.sum()), d, np.nan))
    return out


def smoothing_sweep(df: DataFrame, sigmas: Sequence[float], keys: list[str] = RUN) -> DataFrame:
    """In minus out press time for each smoothing width, per run, then over runs (A33); sigma 0 is unsmoothed.

    (sigma, rt_diff_ms, n_runs). A run is packed once and transformed once; each width is a product in the frequencies of the
    mirrored run, exact for the truncated kernel (four widths to each side) with reflected edges. The plan is the same for any
    number of widths, and a run gives one value per width. Trials split at the run's median of the smoothed values; the press
    times of correct city trials count. A run with a missing value, or without such trials on one side, has no difference.
    """
    widths = tuple(float(s) for s in sigmas)

    @pandas_udf("array<double>")
    def differences(x: pd.Series, rt: pd.Series) -> pd.Series:
        return pd.Series([_sweep(np.asarray(a, float), np.asarray(b, float), widths) for a, b in zip(x, rt, strict=True)])

    counts = F.when(F.col("condition") == "city_correct", F.col("reaction_time"))
    row = F.struct(F.col("trial_idx").alias("i"), F.coalesce("VTC", F.lit(float("nan"))).alias("x"), F.coalesce(counts, F.lit(float("nan"))).alias("rt"))
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__v"))
    runs = packed.select(differences("__v.x", "__v.rt").alias("__d"))
    each = runs.select(F.posexplode("__d").alias("__i", "__d"))
    sigma = F.get(F.array(*[F.lit(s) for s in widths]), F.col("__i"))
    return each.groupBy("__i").agg((F.avg("__d") * 1000).alias("rt_diff_ms"), F.count("__d").alias("n_runs")).select(sigma.alias("sigma"), "rt_diff_ms", "n_runs")


def sliding_trials(df: DataFrame, win: int = 50, step: int = 15, keys: list[str] = RUN) -> DataFrame:
    """Behaviour per sliding window of trials, full windows only (W7); trial_idx counts from 0 without gaps.

    False-alarm rate, share of presses slower than the run's 80th percentile, press time mean and CV
    (population SD / mean, from two on), mean of the variability time course. Each trial is exploded
    to the windows it is in, at most ceil(win / step).
    """
    run = W.partitionBy(*keys)
    correct = F.when(F.col("condition") == "city_correct", F.col("reaction_time"))
    q80 = df.withColumn("__c", correct).groupBy(*keys).agg(F.percentile("__c", 0.8).alias("__q"))
    x = df.withColumn("__rt", correct).withColumn("__n", F.count("*").over(run)).join(q80, keys)
    i = F.col("trial_idx")
    first = F.greatest(F.lit(0), F.ceil((i - win + 1) / step)).cast("int")
    last = F.least(F.floor(i / step), F.floor((F.col("__n") - win) / step)).cast("int")
    x = x.filter(last >= first).withColumn("window_id", F.explode(F.sequence(first, last)))
    mnt = F.col("trial_type") == "mnt"
    return x.groupBy(*keys, "window_id").agg(
        (F.col("window_id") * step + (win - 1) / 2).alias("centre"),
        F.try_divide(F.count_if(F.col("condition") == "mnt_incorrect"), F.count_if(mnt)).alias("fa_rate"),
        F.try_divide(F.count_if(F.col("__rt") > F.col("__q")), F.count("__rt")).alias("slow_share"),
        F.avg("__rt").alias("rt_mean"),
        F.when(F.count("__rt") >= 2, F.try_divide(F.stddev_pop("__rt"), F.avg("__rt"))).alias("rt_cv"),
        F.avg("VTC").alias("vtc_mean"),
    )


def time_on_task(df: DataFrame, keys: list[str], order: str, out: str = "time_on_task") -> DataFrame:
    """Index scaled to [0, 1] over the key's rows; a single row keeps its index."""
    n = F.count("*").over(W.partitionBy(*keys))
    i = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    return df.withColumn(out, F.when(n > 1, i / (n - 1)).otherwise(i.cast("double")))


def trials_to_grid(df: DataFrame, col: str, keys: list[str] = RUN) -> DataFrame:
    """Trial values on a 1 s grid (G22): the last trial of a second wins, gaps are filled linearly."""
    per = df.groupBy(*keys, F.floor("onset").cast("int").alias("sec")).agg(F.max_by(col, F.struct("onset", "trial_idx")).alias(col))
    grid = per.groupBy(*keys).agg(F.min("sec").alias("a"), F.max("sec").alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias("sec"))
    return fill(grid.join(per, [*keys, "sec"], "left"), col, keys, "sec", out=col + "_grid").select(*keys, "sec", col + "_grid")
