"""Array functions over packed epochs: baselines, trends, areas, components, gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    """Sum of an array, nulls skipped."""
    return F.aggregate(F.filter(a, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    ok = F.filter(a, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(ok, F.lit(0.0), lambda s, x: s + x), F.size(ok))


def baseline_correct(epochs: DataFrame, sfreq: float, t0: float) -> DataFrame:
    """Minus the mean of t < 0; epochs without any value go (G1)."""
    base = mean(F.filter("v", lambda _, i: t0 + i / sfreq < 0))
    x = epochs.filter(F.exists("v", lambda x: x.isNotNull())).withColumn("__b", base)
    return x.withColumn("v", F.transform("v", lambda x: x - F.col("__b"))).drop("__b")


def demean(epochs: DataFrame) -> DataFrame:
    """Minus the epoch's mean."""
    return epochs.withColumn("__m", mean(F.col("v"))).withColumn("v", F.transform("v", lambda x: x - F.col("__m"))).drop("__m")


def detrend(epochs: DataFrame) -> DataFrame:
    """Minus the least-squares line of each epoch, in closed form."""
    n = F.size("v")
    mid = (n - 1) / 2.0
    sxy = F.aggregate(F.transform("v", lambda x, i: (i - mid) * x), F.lit(0.0), lambda s, x: s + x)
    slope = F.try_divide(sxy, n * (n * n - 1) / 12.0)
    x = epochs.withColumns({"__m": mean(F.col("v")), "__s": F.coalesce(slope, F.lit(0.0))})
    return x.withColumn("v", F.transform("v", lambda x, i: x - F.col("__m") - F.col("__s") * (i - mid))).drop("__m", "__s")


def trapz(v: Column, dt: float, a: Column | int, b: Column | int) -> Column:
    """Trapezoid area of samples a .. b, both included."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (a, b))
    part = F.slice(v, a + 1, F.greatest(b - a + 1, F.lit(0)))
    n = F.size(part)
    pairs = F.zip_with(F.slice(part, 1, F.greatest(n - 1, F.lit(0))), F.slice(part, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: (x + y) / 2 * dt)
    return F.when(n > 1, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def component_features(epochs: DataFrame, sfreq: float, t0: float, windows: list[tuple[float, float, int]]) -> DataFrame:
    """`components`: per window (from, to, sign), the extreme and the area between the zero crossings around it.

    The extreme is the maximum (sign 1) or minimum (-1) in the window. Its borders are the nearest
    samples of the other sign (or 0) on each side. Without a crossing on either side, or with an extreme of the wrong
    sign, the area is the window's and the borders are null.
    """
    out, rest = [], epochs.columns
    x = epochs
    for w, (lo, hi, sign) in enumerate(windows):
        a, b = round((lo - t0) * sfreq), round((hi - t0) * sfreq)
        part = F.slice("v", a + 1, b - a + 1)
        peak = F.array_max(part) if sign > 0 else F.array_min(part)
        # In steps, so that nothing is worked out twice.
        x = x.withColumns({f"__p{w}": peak, f"__c{w}": F.transform("v", lambda y: y * sign <= 0)})
        x = x.withColumn(f"__i{w}", F.array_position(part, F.col(f"__p{w}")).cast("int") - 1 + a)
        i, crossed = F.col(f"__i{w}"), F.col(f"__c{w}")
        back = F.nullif(F.array_position(F.reverse(F.slice(crossed, F.lit(1), i)), True), F.lit(0))
        ahead = F.nullif(F.array_position(F.slice(crossed, i + 2, F.size("v")), True), F.lit(0))
        x = x.withColumns({f"__l{w}": (i - back).cast("int"), f"__r{w}": (i + ahead).cast("int")})
        peak, left, right = (F.col(f"__{c}{w}") for c in "plr")
        ok = (peak * sign > 0) & left.isNotNull() & right.isNotNull()
        start, stop = F.when(ok, left), F.when(ok, right)
        area = F.when(ok, trapz(F.col("v"), 1 / sfreq, left, right)).otherwise(trapz(F.col("v"), 1 / sfreq, a, b))
        out.append(
            F.struct((t0 + i / sfreq).alias("peak_time"), peak.alias("peak_amp"), area.alias("area"), F.lit(sign).alias("sign"), start.alias("start_idx"), stop.alias("end_idx"))
        )
    return x.select(*[c for c in rest if c != "components"], F.array(*out).alias("components"))


STIMULUS_WINDOWS = [(0.4, 0.7, -1), (0.6, 1.1, 1)]
RESPONSE_WINDOWS = [(0.0, 0.2, -1)]


def erp_area(epochs: DataFrame, sfreq: float, t0: float, windows: list[tuple[float, float, int]]) -> DataFrame:
    """Sum of the components' absolute areas per epoch."""
    x = component_features(epochs, sfreq, t0, windows)
    return x.withColumn("erp_area", F.aggregate("components", F.lit(0.0), lambda s, c: s + F.abs(c["area"]))).drop("components")


def gradient(epochs: DataFrame, sfreq: float) -> DataFrame:
    """Time derivative: central differences, one-sided at the ends."""
    n = F.size("v")
    d = F.transform(
        "v",
        lambda x, i: F.when(i == 0, F.get("v", F.lit(1)) - x).when(i == n - 1, x - F.get("v", i - 1)).otherwise((F.get("v", i + 1) - F.get("v", i - 1)) / 2) * sfreq,
    )
    return epochs.withColumn("v", d)


def rereference(samples: DataFrame, keys: list[str], refs: list | None = None) -> DataFrame:
    """Minus the mean of the reference channels (or of all) at each sample."""
    own = samples if refs is None else samples.filter(F.col("channel").isin(refs))
    return samples.join(own.groupBy(*keys).agg(F.avg("v").alias("__r")), keys).withColumn("v", F.col("v") - F.col("__r")).drop("__r")
