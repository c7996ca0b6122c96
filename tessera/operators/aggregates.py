"""Group summaries, channel and epoch quality, weighted region statistics, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.stats import norm_ppf, t_critical
from tessera.operators.ranges import exact_quantiles


def sdt(df: DataFrame) -> DataFrame:
    """d' and criterion from zone counts (A5): hit = 1 - CE rate, false alarm = OE rate; 1 and 0 are moved by half a trial."""

    def corrected(rate: Column, n: Column) -> Column:
        return F.when(n == 0, None).when(rate == 1, 1 - 0.5 / n).when(rate == 0, 0.5 / n).otherwise(rate)

    n_mnt, n_city = F.col("ce") + F.col("co"), F.col("oe") + F.col("cc")
    hit = corrected(1 - F.try_divide(F.col("ce"), n_mnt), n_mnt)
    fa = corrected(F.try_divide(F.col("oe"), n_city), n_city)
    z = df.withColumns({"__h": norm_ppf(hit), "__f": norm_ppf(fa)})
    return z.withColumns({"d_prime": F.col("__h") - F.col("__f"), "criterion": -(F.col("__h") + F.col("__f")) / 2}).drop("__h", "__f")


def group_summary(df: DataFrame, col: str, inner: list[str], outer: list[str], ddof: int = 0) -> DataFrame:
    """Mean per inner key, then mean, SEM and n over these per outer key (A8); ddof says which SD."""
    per = df.groupBy(*dict.fromkeys([*inner, *outer])).agg(F.avg(col).alias("__m"))
    sd = F.stddev_samp("__m") if ddof else F.stddev_pop("__m")
    return per.groupBy(*outer).agg(F.avg("__m").alias("mean"), (sd / F.sqrt(F.count("__m"))).alias("sem"), F.count("__m").alias("n"))


def mean_ci(summary: DataFrame, level: float = 0.95) -> DataFrame:
    """Confidence bounds of a group summary (mean, sem, n), by the t distribution."""
    t = t_critical(F.lit(0.5 + level / 2), F.col("n") - 1.0)
    return summary.withColumn("__h", t * F.col("sem")).withColumns({"ci_low": F.col("mean") - F.col("__h"), "ci_high": F.col("mean") + F.col("__h")}).drop("__h")


def erp(epochs: DataFrame, keys: list[str]) -> DataFrame:
    """Average waveform per key in long form (keys, pos, v); null samples are skipped (A10)."""
    return epochs.select(*keys, F.posexplode("v").alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("v"))


def grand_mean(waves: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over subjects and mean +- 2 SEM per time point (A10)."""
    sem = F.stddev_samp("v") / F.sqrt(F.count("v"))
    return waves.groupBy(*keys, "pos").agg(F.avg("v").alias("mean"), (F.avg("v") - 2 * sem).alias("low"), (F.avg("v") + 2 * sem).alias("high"), F.count("v").alias("n"))


def zone_erp(epochs: DataFrame, keys: list[str]) -> DataFrame:
    """Average waveform per zone, for subjects with both zones."""
    both = epochs.filter("zone is not null").groupBy("subject").agg(F.count_distinct("zone").alias("__z")).filter("__z = 2").select("subject")
    return erp(epochs.filter("zone is not null").join(both, "subject", "left_semi"), ["subject", "zone", *keys])


def condition_diff(df: DataFrame, col: str, condition: str, a, b, keys: list[str]) -> DataFrame:
    """Mean of condition a minus mean of b per key; both must be there (A12). Pairs by key, not by position."""
    mean = lambda c: F.avg(F.when(F.col(condition) == c, F.col(col)))
    return df.groupBy(*keys).agg((mean(a) - mean(b)).alias("diff")).filter("diff is not null")


def epoch_window_mean(epochs: DataFrame, sfreq: float, t0: float, lo: float, hi: float) -> DataFrame:
    """Mean amplitude of each epoch in [lo, hi) seconds as `amp`; nulls skipped."""
    at = lambda i: t0 + i / sfreq
    inside = F.filter(F.filter("v", lambda _, i: (at(i) >= lo) & (at(i) < hi)), lambda x: x.isNotNull())
    return epochs.withColumn("amp", F.try_divide(F.aggregate(inside, F.lit(0.0), lambda s, x: s + x), F.size(inside)))


def bad_by_variance(stats: DataFrame, keys: list[str], threshold: float = 3.0, two_sided: bool = False) -> DataFrame:
    """Channels whose variance has a z-score beyond the threshold among the key's channels (A15); stats has var."""
    w = W.partitionBy(*keys)
    z = F.try_divide(F.col("var") - F.avg("var").over(w), F.stddev_pop("var").over(w))
    return stats.withColumn("z", z).filter((F.abs("z") if two_sided else F.col("z")) > threshold)


def channel_stats(samples: DataFrame, keys: list[str], col: str = "v") -> DataFrame:
    """Variance (population) and peak-to-peak per channel."""
    return samples.groupBy(*keys).agg(F.var_pop(col).alias("var"), (F.max(col) - F.min(col)).alias("ptp"))


def bad_by_amplitude(stats: DataFrame, limit: float = 1000.0) -> DataFrame:
    """Channels whose peak-to-peak exceeds the limit."""
    return stats.filter(F.col("ptp") > limit)


def reject_ptp(epochs: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Per trial, whether any channel's peak-to-peak exceeds the threshold."""
    return epochs.groupBy(*keys).agg(F.bool_or(F.array_max("v") - F.array_min("v") > threshold).alias("rejected"))


def array_moments(epochs: DataFrame) -> DataFrame:
    """Sample variance and SD of each packed epoch, `var` and `sd`."""
    n = F.size("v")
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / n
    ss = F.aggregate(F.transform("v", lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x)
    return epochs.withColumn("var", ss / (n - 1)).withColumn("sd", F.sqrt("var"))


def reject_std_var(epochs: DataFrame, keys: list[str], sd: float = 20.0, var: float = 200.0) -> DataFrame:
    """Per trial, whether the channels' mean SD or mean variance reaches its limit."""
    return array_moments(epochs).groupBy(*keys).agg(((F.avg("sd") >= sd) | (F.avg("var") >= var)).alias("rejected"))


def trial_yield(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Kept and total trials, percent rejected, and both lists of trial numbers (A19); a run has a few hundred trials."""
    kept, lost = F.when(~F.col("rejected"), F.col("trial_idx")), F.when(F.col("rejected"), F.col("trial_idx"))
    return trials.groupBy(*keys).agg(
        F.count(kept).alias("kept"),
        F.count("*").alias("total"),
        (100 * F.count(lost) / F.count("*")).alias("pct_rejected"),
        F.sort_array(F.collect_list(kept)).alias("kept_trials"),
        F.sort_array(F.collect_list(lost)).alias("rejected_trials"),
    )


def enough_trials(trials: DataFrame, min_n: int) -> DataFrame:
    """Trials of subjects that keep at least min_n."""
    keep = trials.filter(~F.col("rejected")).groupBy("subject").agg(F.count("*").alias("__n")).filter(F.col("__n") >= min_n)
    return trials.join(keep, "subject", "left_semi")


def bad_channels(amplitude: DataFrame, saturated: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Channels whose smallest time-mean amplitude over wavelengths is below the threshold, or flagged 0."""
    low = amplitude.groupBy(*keys, "wavelength").agg(F.avg("v").alias("m")).groupBy(*keys).agg(F.min("m").alias("m")).filter(F.col("m") < threshold)
    return low.select(*keys).unionByName(saturated.filter("flag = 0").select(*keys)).distinct()


def short_regressor(series: DataFrame, distances: DataFrame, keys: list[str], mm: float = 20.0) -> DataFrame:
    """Mean over channels closer than `mm`, per time."""
    near = distances.filter(F.col("mm") < mm).select("channel")
    return series.join(near, "channel", "left_semi").groupBy(*keys).agg(F.avg("v").alias("short"))


def global_mean(series: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Mean over channels per time; weighted, the weights of all channels are in the denominator."""
    how = F.avg("v") if weight is None else F.try_divide(F.sum(F.col("v") * F.col(weight)), F.sum(weight))
    return series.groupBy(*keys).agg(how.alias("gm"))


def ivw_mean(df: DataFrame, keys: list[str], x: str = "x", m: str = "m") -> DataFrame:
    """Inverse-variance mean and its variance."""
    w = F.sum(1 / F.col(m))
    return df.groupBy(*keys).agg((F.sum(F.col(x) / F.col(m)) / w).alias("ivw"), (1 / w).alias("ivw_var"))


def parcel_variance(df: DataFrame) -> DataFrame:
    """Variance of a parcel mean, sum v / n^2 per run, then sum / runs^2."""
    per = df.groupBy("parcel", "run").agg((F.sum("m") / F.count("*") / F.count("*")).alias("v"))
    return per.groupBy("parcel").agg((F.sum("v") / F.count("*") / F.count("*")).alias("var"))


def weighted_stats(df: DataFrame, keys: list[str], x: str, w: str) -> DataFrame:
    """Weighted mean, variance and standard error."""
    sw, swx, swxx = F.sum(w), F.sum(F.col(w) * F.col(x)), F.sum(F.col(w) * F.col(x) * F.col(x))
    mean = swx / sw
    var = swxx / sw - mean * mean
    return df.groupBy(*keys).agg(mean.alias("w_mean"), var.alias("w_var"), F.sqrt(var * F.sum(F.col(w) * F.col(w)) / (sw * sw)).alias("w_se"))


def overlap_table(df: DataFrame, cluster: str, parcel: str, min_fraction: float = 0.0) -> DataFrame:
    """Counts of cluster x parcel, their fraction of the cluster, above a fraction (A27). `pivot` turns it wide."""
    c = df.groupBy(cluster, parcel).agg(F.count("*").alias("n"))
    c = c.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy(cluster)))
    return c.filter(F.col("fraction") >= min_fraction)


def effect_summary(df: DataFrame, keys: list[str], value: str = "value", p: str = "p") -> DataFrame:
    """Subjects, mean effect, number and percent of p < .05."""
    sig = F.count_if(F.col(p) < 0.05)
    return df.groupBy(*keys).agg(F.count_distinct("subject").alias("n_subjects"), F.avg(value).alias("mean"), sig.alias("n_sig"), (100 * sig / F.count("*")).alias("pct_sig"))


def availability(df: DataFrame, flags: list[str]) -> DataFrame:
    """Counts for every combination of modality flags, with subtotals."""
    return df.cube(*flags).agg(F.count("*").alias("n"))


def sig_ratio(df: DataFrame, bad: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Share of significant channels per subject, bad channels left out."""
    return df.join(bad, ["subject", "channel"], "left_anti").groupBy("subject").agg(F.avg((F.col("p") < alpha).cast("int")).alias("ratio"))


def exclusions(*reasons: DataFrame) -> DataFrame:
    """(subject, reason): the first reason a subject is listed for, in the order given."""
    every = reduce(DataFrame.unionByName, [r.select("subject", "reason", F.lit(i).alias("__k")) for i, r in enumerate(reasons)])
    rank = F.row_number().over(W.partitionBy("subject").orderBy("__k", "reason"))
    return every.withColumn("__r", rank).filter("__r = 1").select("subject", "reason")


def raster(epochs: DataFrame, by: str, tie: str, keys: list[str], n: int) -> DataFrame:
    """Epochs sorted by a criterion, row numbers, and the criterion smoothed over n rows."""
    from tessera.operators.windows import moving_avg

    x = epochs.withColumn("row", F.row_number().over(W.partitionBy(*keys).orderBy(by, tie)) - 1)
    return moving_avg(x, by, keys, ["row"], n, "nearest", out="smoothed")


def top_channel(df: DataFrame, keys: list[str], stat: str, largest: bool = True, trim: tuple[float, float] | None = None) -> DataFrame:
    """The channel with the extreme statistic, ties to the smaller channel; optionally within percentiles."""
    if trim:
        q = exact_quantiles(df, keys, stat, list(trim), "__q")
        df = df.join(q, keys).filter((F.col(stat) >= F.col("__q")[0]) & (F.col(stat) <= F.col("__q")[1]))
    best = F.min_by("channel", F.struct((-F.col(stat) if largest else F.col(stat)).alias("s"), "channel"))
    return df.groupBy(*keys).agg(best.alias("channel"), (F.max(stat) if largest else F.min(stat)).alias(stat))


def argmax_abs(v: Column, first: int = 0, n: int | None = None) -> Column:
    """Place of the largest absolute value of an array from `first` on, the first one wins (T3); an empty window is the whole."""
    part = F.slice(v, first + 1, n) if n is not None else v
    whole = F.size(part) == 0
    use = F.when(whole, v).otherwise(part)
    mags = F.transform(use, lambda x: F.abs(x))
    return F.array_position(mags, F.array_max(mags)).cast("int") - 1 + F.when(whole, 0).otherwise(first if n is not None else 0)


def peak_near(waves: DataFrame, keys: list[str], sfreq: float, centre: float, tol: float) -> DataFrame:
    """Series whose largest absolute value is within `tol` of a time, with that value (T4)."""
    x = waves.withColumn("__i", argmax_abs(F.col("v"))).withColumn("peak", F.get("v", F.col("__i")))
    return x.filter(F.abs(F.col("__i") / sfreq - centre) <= tol).select(*keys, "peak")


def subject_sets(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Set algebra of single-column tables: 'intersect', 'union' or 'minus' (T5)."""
    return {"intersect": a.intersect, "union": lambda x: a.union(x).distinct(), "minus": a.subtract}[how](b)


def common_channels(df: DataFrame) -> DataFrame:
    """Channels that every subject has."""
    n = df.agg(F.count_distinct("subject").alias("__n"))
    per = df.groupBy("channel").agg(F.count_distinct("subject").alias("__c"))
    return per.withColumn("__k", F.lit(1)).join(n.withColumn("__k", F.lit(1)), "__k").filter("__c = __n").select("channel")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Subjects with both values."""
    return a.join(b, "subject")
