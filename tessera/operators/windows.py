"""Window operators over trials and samples: moving averages, bins, triggers, lags, false-discovery control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.stats import t_quantile
from tessera.operators.ranges import RANGE, carried, exact_quantiles, in_ranges


def moving_avg(df: DataFrame, col: str, keys: list[str], order: list[str], n: int, edge: str = "nearest", out: str = "moving") -> DataFrame:
    """Centred moving average over places i - n//2 .. i + (n-1)//2.

    edge='nearest': places beyond the ends take the end's value; 'zero': they count as 0. Both divide by n.
    """
    lo, hi = n // 2, (n - 1) // 2
    w = W.partitionBy(*keys).orderBy(*order)
    full = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum(col).over(w.rowsBetween(-lo, hi))
    if edge == "nearest":
        i = F.row_number().over(w) - 1
        m = F.count("*").over(full)
        total = total + F.greatest(F.lit(0), lo - i) * F.first(col).over(full) + F.greatest(F.lit(0), i + hi - (m - 1)) * F.last(col).over(full)
    return df.withColumn(out, total / n)


def equal_count_bins(df: DataFrame, x: str, k: int, keys: list[str], y: str, tie: str) -> DataFrame:
    """k bins of equal counts after sorting, the first n mod k one larger; mean of x and y per bin.

    Rows are sorted in ranges of (keys, x); a place is that in the range after the counts of the key's ranges before. So a key
    of any size, or no key at all, spans many tasks.
    """
    s = carried(in_ranges(df, keys, x), keys, {"__c": F.count("*")}, before={"__before": F.sum("__c")}, total={"__n": F.sum("__c")})
    i = F.row_number().over(W.partitionBy(*keys, RANGE).orderBy(x, tie)) - 1 + F.coalesce("__before", F.lit(0))
    small, extra = F.floor(F.col("__n") / k), F.col("__n") % k
    edge = extra * (small + 1)
    b = F.when(i < edge, F.floor(i / (small + 1))).otherwise(extra + F.floor((i - edge) / F.greatest(small, F.lit(1)))) + 1
    return s.withColumn("bin", b.cast("int")).groupBy(*keys, "bin").agg(F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"), F.count("*").alias("n"))


def equal_count_bins_global(df: DataFrame, x: str, k: int, y: str, tie: str) -> DataFrame:
    """The same without a key."""
    return equal_count_bins(df, x, k, [], y, tie)


def quantile_bins(df: DataFrame, x: str, k: int, keys: list[str], mode: str = "closed_last", out: str = "bin") -> DataFrame:
    """Bins by k + 1 quantile edges.

    closed_last: bins [e, e') numbered from 0, the last closed on both sides; digitize: the number of inner edges <= x.
    """
    edges = exact_quantiles(df, keys, x, [i / k for i in range(k + 1)], "__e")
    inner = lambda e: F.size(F.filter(F.slice(e, 2, k - 1), lambda q: q <= F.col(x)))
    b = inner(F.col("__e"))
    if mode == "closed_last":
        b = F.least(b, F.lit(k - 1))
    return df.join(edges, keys).withColumn(out, F.when(F.col(x).isNotNull(), b)).drop("__e")


def fixed_bins(df: DataFrame, x: str, y: str, lo: float = -1.5, hi: float = 1.5, n: int = 10, min_subjects: int = 2) -> DataFrame:
    """Equal bins on [lo, hi): subject means, then mean, SEM and count over subjects, bins with enough of them."""
    b = F.floor((F.col(x) - lo) / ((hi - lo) / n)).cast("int")
    per = df.filter((F.col(x) >= lo) & (F.col(x) < hi)).groupBy("subject", b.alias("bin")).agg(F.avg(y).alias("m"))
    out = per.groupBy("bin").agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("sem"), F.count("m").alias("n_subjects"))
    return out.filter(F.col("n_subjects") >= min_subjects)


def sliding_samples(df: DataFrame, keys: list[str], size: int, step: int, cols: list[str], edge: int = 0) -> DataFrame:
    """Means over sliding windows of `size` samples every `step`, full windows only.

    Windows centred within `edge` samples of either end are dropped. Samples have i from 0 without gaps.
    """
    x = df.join(df.groupBy(*keys).agg(F.count("*").alias("__n")), keys)
    i = F.col("i")
    first = F.greatest(F.lit(0), F.ceil((i - size + 1) / step)).cast("int")
    last = F.least(F.floor(i / step), F.floor((F.col("__n") - size) / step)).cast("int")
    x = x.filter(last >= first).withColumn("window_id", F.explode(F.sequence(first, last)))
    out = x.groupBy(*keys, "window_id").agg(F.first("__n").alias("__n"), *[F.avg(c).alias(f"{c}_mean") for c in cols])
    centre = F.col("window_id") * step + (size - 1) / 2
    return out.filter((centre >= edge) & (centre <= F.col("__n") - 1 - edge)).drop("__n")


def longest_flat(df: DataFrame, keys: list[str], col: str = "v") -> DataFrame:
    """Longest run of equal neighbours, counted on differences (W13): gaps and islands."""
    w = W.partitionBy(*keys).orderBy("i")
    x = df.withColumn("__c", F.coalesce((F.col(col) != F.lag(col).over(w)).cast("int"), F.lit(1)))
    x = x.withColumn("__g", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*keys, "__g").agg((F.count("*") - 1).alias("__l")).groupBy(*keys).agg(F.max("__l").alias("longest"))


def bad_by_flat(df: DataFrame, keys: list[str], sfreq: float, seconds: float = 5.0) -> DataFrame:
    """Channels that stay flat for at least that long."""
    return longest_flat(df, keys).filter(F.col("longest") >= seconds * sfreq)


def trigger_edges(df: DataFrame, keys: list[str], mode: str = "falling") -> DataFrame:
    """Trigger edges with times and gaps.

    falling: first sample below half the maximum after one at or above; rising: the last low sample
    before a high one; mid: first sample below the middle of the range.
    """
    part = W.partitionBy(*keys)
    w = part.orderBy("i")
    thr = F.max("v").over(part) / 2 if mode != "mid" else (F.max("v").over(part) + F.min("v").over(part)) / 2
    x = df.withColumn("__low", F.col("v") < thr)
    if mode == "rising":
        x = x.withColumn("__e", F.col("__low") & ~F.lead("__low").over(w))
    else:
        x = x.withColumn("__e", F.col("__low") & ~F.lag("__low").over(w))
    x = x.filter("__e")
    if mode == "mid":
        return x.groupBy(*keys).agg(F.min("i").alias("i"), F.min_by("t", "i").alias("t"))
    return x.select(*keys, "i", "t", (F.col("t") - F.lag("t").over(w)).alias("gap"))


def trigger_span(df: DataFrame, keys: list[str], minutes: float = 6.0) -> DataFrame:
    """Longest gap between pressed samples (v = 0) in minutes, and whether it is too short; a majority of pressed samples is read as reversed."""
    x = df.withColumn("__flip", F.avg((F.col("v") == 0).cast("int")).over(W.partitionBy(*keys)) > 0.5)
    x = x.filter((F.col("v") == 0) != F.col("__flip"))
    gap = (F.col("t") - F.lag("t").over(W.partitionBy(*keys).orderBy("i"))) / 60
    x = x.withColumn("__gap", gap).groupBy(*keys).agg(F.max("__gap").alias("longest_gap"))
    return x.withColumn("too_short", F.col("longest_gap") < minutes)


def crop_to_trigger(df: DataFrame, keys: list[str], pressed) -> DataFrame:
    """Samples from the first to the last press; runs without one go (W16). `pressed` is a condition Column."""
    w = W.partitionBy(*keys)
    x = df.withColumns({"__a": F.min(F.when(pressed, F.col("i"))).over(w), "__b": F.max(F.when(pressed, F.col("i"))).over(w)})
    return x.filter("i between __a and __b").drop("__a", "__b")


def zero_crossings(df: DataFrame, keys: list[str], col: str = "v") -> DataFrame:
    """Neighbours of different sign and the interpolated time between them."""
    w = W.partitionBy(*keys).orderBy("i")
    x = df.withColumns({"__v": F.lead(col).over(w), "__t": F.lead("t").over(w)}).filter(F.signum(col) != F.signum("__v"))
    t = F.col("t") - F.col(col) * (F.col("__t") - F.col("t")) / (F.col("__v") - F.col(col))
    return x.select(*keys, "i", t.alias("t_zero"))


def delay_regressors(df: DataFrame, keys: list[str], col: str, n_delay: int) -> DataFrame:
    """Copies delayed by 0 .. n_delay - 1 samples, the first n_delay rows removed."""
    w = W.partitionBy(*keys).orderBy("i")
    return df.select(*keys, "i", *[F.lag(col, d).over(w).alias(f"delay{d}") for d in range(n_delay)]).filter(F.col("i") >= n_delay)


def lag_matrix(df: DataFrame, keys: list[str], col: str, n: int) -> DataFrame:
    """Lagged copies padded with 0."""
    w = W.partitionBy(*keys).orderBy("i")
    return df.select(*keys, "i", *[F.coalesce(F.lag(col, d).over(w), F.lit(0.0)).alias(f"lag{d}") for d in range(n)])


def concat_runs(df: DataFrame, dt: float) -> DataFrame:
    """Runs of a subject on one time axis: each starts dt after the end of the one before."""
    ends = df.groupBy("subject", "run").agg((F.max("t") + dt).alias("__len"))
    offset = F.coalesce(F.sum("__len").over(W.partitionBy("subject").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return df.join(ends.withColumn("offset", offset).drop("__len"), ["subject", "run"]).withColumn("t_all", F.col("t") + F.col("offset"))


def fdr_bh(df: DataFrame, p: str, family: list[str], alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg adjusted p and reject flag per family (W24); null p take no part.

    Families are sorted in ranges of p: a rank is the place in the range after the counts of the ranges before, and the
    running minimum from the largest p goes on with the minima of the ranges after. A family of any size, or one of all rows, works.
    """
    x = carried(in_ranges(df, family, p), family, {"__c": F.count(p)}, before={"__before": F.sum("__c")}, total={"__m": F.sum("__c")})
    own = W.partitionBy(*family, RANGE)
    rank = F.coalesce("__before", F.lit(0)) + F.count(p).over(own.orderBy(F.col(p).asc_nulls_first()).rangeBetween(W.unboundedPreceding, 0))
    x = x.withColumn("__q", F.when(F.col(p).isNotNull(), F.col(p) * F.col("__m") / rank)).drop("__before", "__m")
    x = carried(x, family, {"__least": F.min("__q")}, after={"__next": F.min("__least")})
    q = F.least(F.lit(1.0), F.min("__q").over(own.orderBy(F.desc(p)).rangeBetween(W.unboundedPreceding, 0)), F.col("__next"))
    return x.withColumn("p_adj", F.when(F.col(p).isNotNull(), q)).withColumn("reject", F.col("p_adj") <= alpha).drop("__q", "__next", RANGE)


def bonferroni(n_clusters: int, df_resid: float, alpha: float = 0.05, points: int = 30) -> tuple[float, float]:
    """Threshold alpha / (clusters x points) and its two-sided critical t."""
    a = alpha / (n_clusters * points)
    return a, t_quantile(1 - a / 2, df_resid)
