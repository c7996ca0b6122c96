"""Joins in time and space: nearest, interpolating, interval and matching joins, epoch cutting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.ranges import RANGE, carried, in_ranges


def _neighbours(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, value: str) -> DataFrame:
    """left with __p and __n, the right points (t, v) at or before and at or after each left time.

    Both sides are sorted together into ranges of (keys, time), never a theta join, and a large key spans many ranges. Windows
    look inside a range; beyond it stands the last point of the ranges before and the first of those after. Both windows
    grow from one end, so n rows cost n steps: what follows is what came before in falling time. Of right points with one
    time, the one with the largest value is taken; left rows without a time have no neighbours.
    """
    a = left.select(*keys, F.col(lt).cast("double").alias("__t"), F.lit(None).cast("double").alias("__v"), F.struct(*left.columns).alias("__l"))
    b = right.filter(F.col(rt).isNotNull()).select(*keys, F.col(rt).cast("double").alias("__t"), F.col(value).cast("double").alias("__v"), F.lit(True).alias("__r"))
    both = in_ranges(a.unionByName(b, allowMissingColumns=True), keys, "__t")

    def point(sign: int) -> Column:
        return F.max(F.when(F.col("__r"), F.struct((sign * F.col("__t")).alias("t"), F.col("__v").alias("v"))))

    both = carried(both, keys, {"__last": point(1), "__first": point(-1)}, before={"__earlier": F.max("__last")}, after={"__later": F.max("__first")})

    def seen(sign: int, beyond: str) -> Column:
        # Equal times are peers of a range frame: a point at the left's own time counts on both sides.
        w = W.partitionBy(*keys, RANGE).orderBy(sign * F.col("__t")).rangeBetween(W.unboundedPreceding, 0)
        most = F.coalesce(point(sign).over(w), F.col(beyond))
        return F.when(F.col("__t").isNotNull() & most.isNotNull(), F.struct((sign * most["t"]).alias("t"), most["v"].alias("v")))

    both = both.withColumns({"__p": seen(1, "__earlier"), "__n": seen(-1, "__later")})
    return both.filter("__l is not null").select("__l.*", "__p", "__n")


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, value: str) -> DataFrame:
    """Value and time of the nearest right point; the earlier one wins ties."""
    x = _neighbours(left, right, keys, lt, rt, value)
    p, n, t = F.col("__p"), F.col("__n"), F.col(lt)
    pick = F.when(n.isNull() | (t - p["t"] <= n["t"] - t), p).otherwise(n)
    return x.withColumn("near_t", pick["t"]).withColumn("near_v", pick["v"]).drop("__p", "__n")


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, value: str) -> DataFrame:
    """Value and time of the first right point at or after."""
    x = _neighbours(left, right, keys, lt, rt, value)
    return x.withColumn("next_t", F.col("__n")["t"]).withColumn("next_v", F.col("__n")["v"]).drop("__p", "__n")


def interp_join(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, value: str, out: str = "interp") -> DataFrame:
    """Right series at the left times, linear, clamped at the ends."""
    x = _neighbours(left, right, keys, lt, rt, value)
    p, n = F.col("__p"), F.col("__n")
    mid = p["v"] + (n["v"] - p["v"]) * (F.col(lt) - p["t"]) / (n["t"] - p["t"])
    return x.withColumn(out, F.when(p.isNull(), n["v"]).when(n.isNull() | (n["t"] == p["t"]), p["v"]).otherwise(mid)).drop("__p", "__n")


def _bucketed(intervals: DataFrame, lo: Column, hi: Column, width: float) -> DataFrame:
    return intervals.withColumn("__b", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, lo: str, hi: str, width: float, closed_right: bool = False, how: str = "inner") -> DataFrame:
    """Points in [lo, hi) or [lo, hi]: an equi-join on time buckets, then the exact test.

    An interval is copied to the buckets that it touches; `width` near the interval length keeps that
    to about two. A point has one bucket, so no pair appears twice.
    """
    b = _bucketed(intervals, F.col(lo), F.col(hi), width)
    p = points.withColumn("__b", F.floor(F.col(t) / width))
    on = [p[k] == b[k] for k in keys] + [p["__b"] == b["__b"], p[t] >= b[lo], p[t] <= b[hi] if closed_right else p[t] < b[hi]]
    out = p.join(b, on, how)
    return out.drop(p["__b"]) if how in ("left_semi", "left_anti") else out.drop(b["__b"], *[b[k] for k in keys]).drop("__b")


def window_mean(trials: DataFrame, samples: DataFrame, keys: list[str], lo: float, hi: float, min_n: int, on: str = "onset", width: float | None = None) -> DataFrame:
    """Mean of the samples in [onset + lo, onset + hi) for trials with at least `min_n` of them.

    `trials` has a trial_idx; samples have t and v.
    """
    iv = trials.select(*keys, "trial_idx", (F.col(on) + lo).alias("__lo"), (F.col(on) + hi).alias("__hi"))
    x = range_join(samples.select(*keys, "t", "v"), iv, keys, "t", "__lo", "__hi", width or hi - lo)
    return x.groupBy(*keys, "trial_idx").agg(F.avg("v").alias("mean_v"), F.count("v").alias("n")).filter(F.col("n") >= min_n)


def keep_in_intervals(samples: DataFrame, intervals: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Samples inside any closed interval."""
    return range_join(samples, intervals.select(*keys, "t_start", "t_stop"), keys, "t", "t_start", "t_stop", width, closed_right=True, how="left_semi")


def mask_intervals(samples: DataFrame, intervals: DataFrame, keys: list[str], col: str = "v") -> DataFrame:
    """Samples inside a closed interval become null (J7): a sweep over boundaries in ranges of (keys, time).

    The number of intervals open where a range begins is carried to it, so a large key spans many ranges.
    """
    s = samples.select(*keys, F.col("t").alias("__t"), F.lit(0).alias("__d"), F.lit(1).alias("__o"), F.struct(*samples.columns).alias("__s"))
    up = intervals.select(*keys, F.col("t_start").alias("__t"), F.lit(1).alias("__d"), F.lit(0).alias("__o"))
    down = intervals.select(*keys, F.col("t_stop").alias("__t"), F.lit(-1).alias("__d"), F.lit(2).alias("__o"))
    both = in_ranges(s.unionByName(up, allowMissingColumns=True).unionByName(down, allowMissingColumns=True), keys, "__t")
    both = carried(both, keys, {"__change": F.sum("__d")}, before={"__open": F.sum("__change")})
    depth = F.coalesce("__open", F.lit(0)) + F.sum("__d").over(W.partitionBy(*keys, RANGE).orderBy("__t", "__o").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("__in", depth > 0).filter("__s is not null").select("__s.*", "__in").withColumn(col, F.when(~F.col("__in"), F.col(col))).drop("__in")


def clock_offset(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """First onset on clock a minus first onset on clock b per run."""
    first = lambda df, n: df.groupBy(*keys).agg(F.min_by("onset", "trial_idx").alias(n))
    return first(a, "a0").join(first(b, "b0"), keys).select(*keys, (F.col("a0") - F.col("b0")).alias("offset"))


def match_runs(a: DataFrame, b: DataFrame, atol: float = 0.05, by: str = "onsets") -> DataFrame:
    """(subject, run_a, run_b): for each run of a, the first run of b of the subject that fits.

    onsets: same count and all relative onsets within atol + 1e-5 |b|; first: first onset within that;
    first_row: the first trial is equal in onset, type and reaction time; time_axis: all times equal,
    by count and a hash of the ordered times, then exactly.
    """

    def runs(df: DataFrame, r: str) -> DataFrame:
        w = W.partitionBy("subject", "run")
        return df.withColumns({"__n": F.count("*").over(w), "__t0": F.min("onset").over(w)}).withColumnRenamed("run", r)

    x, y = runs(a, "run_a"), runs(b, "run_b")
    if by == "onsets":
        x = x.select("subject", "run_a", "trial_idx", "__n", (F.col("onset") - F.col("__t0")).alias("ta"))
        y = y.select("subject", "run_b", "trial_idx", "__n", (F.col("onset") - F.col("__t0")).alias("tb"))
        gap = F.abs(F.col("ta") - F.col("tb")) - (atol + 1e-5 * F.abs(F.col("tb")))
        pairs = x.join(y, ["subject", "__n", "trial_idx"]).groupBy("subject", "run_a", "run_b").agg(F.max(gap).alias("g"), F.count("*").alias("c"), F.first("__n").alias("__n"))
        pairs = pairs.filter((F.col("g") <= 0) & (F.col("c") == F.col("__n")))
    elif by == "time_axis":
        key = lambda df, r: df.groupBy("subject", r, "__n").agg(F.xxhash64(F.sort_array(F.collect_list("onset"))).alias("h"), F.sort_array(F.collect_list("onset")).alias("ts_" + r))
        pairs = key(x, "run_a").join(key(y, "run_b"), ["subject", "__n", "h"]).filter("ts_run_a = ts_run_b")
    else:
        first = lambda df, r: df.groupBy("subject", r).agg(F.min_by(F.struct("onset", "trial_type", "reaction_time"), "trial_idx").alias("f_" + r))
        pairs = first(x, "run_a").join(first(y, "run_b"), "subject")  # a subject has a handful of runs
        ta, tb = F.col("f_run_a.onset"), F.col("f_run_b.onset")
        pairs = pairs.filter(F.abs(ta - tb) <= atol + 1e-5 * F.abs(tb) if by == "first" else F.col("f_run_a") == F.col("f_run_b"))
    rank = F.row_number().over(W.partitionBy("subject", "run_a").orderBy("run_b"))
    return pairs.withColumn("__k", rank).filter("__k = 1").select("subject", "run_a", "run_b")


def align_trials(a: DataFrame, b: DataFrame) -> DataFrame:
    """Trials of a whose sample survives in b."""
    return a.join(b, ["subject", "run", "sample"], "left_semi")


def epoch(series: DataFrame, marks: DataFrame, tmin: float, tmax: float, keys: list[str], pad: bool = False) -> DataFrame:
    """Cut packed series (keys, channel, sfreq, v) around markers (keys, trial_idx, event, sample).

    An epoch has round((tmax - tmin) * sfreq) + 1 samples. One that leaves the recording is dropped, or
    filled with nulls if `pad`. Series stay packed; `slice` copies only the epoch.
    """
    x = series.join(marks, keys)
    off = F.round(F.lit(tmin) * F.col("sfreq")).cast("int")
    n = (F.round(F.lit(tmax - tmin) * F.col("sfreq")) + 1).cast("int")
    start = F.col("sample").cast("int") + off
    size = F.size("v")
    x = x.withColumns({"__s": start, "__n": n})
    if not pad:
        x = x.filter((F.col("__s") >= 0) & (F.col("__s") + F.col("__n") <= size))
        cut = F.slice("v", F.col("__s") + 1, F.col("__n"))
    else:
        cut = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.when(F.col("__s") + i >= 0, F.get("v", F.col("__s") + i)))
    return x.withColumn("v", cut).withColumn("t0", F.lit(tmin)).drop("__s", "__n")


def neighbour_pairs(vertices: DataFrame, radius: float) -> DataFrame:
    """(a, b, distance) of vertices within a radius, a < b (J15): cubic cells, 27 around each."""
    cell = [F.floor(F.col(c) / radius).cast("int") for c in "xyz"]
    base = vertices.select("vertex", "x", "y", "z", *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    near = base
    for i in range(3):
        near = near.withColumn(f"c{i}", F.explode(F.array(*[F.col(f"c{i}") + k for k in (-1, 0, 1)])))
    a, b = base.alias("a"), near.alias("b")
    d = F.sqrt(sum((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in "xyz"))
    on = [F.col(f"a.c{i}") == F.col(f"b.c{i}") for i in range(3)]
    x = a.join(b, on + [F.col("a.vertex") < F.col("b.vertex")]).select(F.col("a.vertex").alias("a"), F.col("b.vertex").alias("b"), d.alias("distance"))
    return x.filter(F.col("distance") <= radius)
