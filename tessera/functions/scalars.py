"""Column functions: recoding, labels, transforms and name parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLOOR = 1e-30


def recode_response(df: DataFrame, by: str = "code") -> DataFrame:
    """Response codes: city correct 1, city missed -1, mnt correct 0, mnt pressed -2.

    by='code' reads the raw code (mnt -1 becomes -2, city 0 becomes -1); by='press' reads the reaction
    time instead (mnt with a press, city without one).
    """
    mnt, city = F.col("stim") == 1, F.col("stim") == 2
    if by == "code":
        bad_mnt, bad_city = mnt & (F.col("code") == -1), city & (F.col("code") == 0)
    else:
        bad_mnt, bad_city = mnt & (F.col("rt") != 0), city & (F.col("rt") == 0)
    return df.withColumn("response_code", F.when(bad_mnt, -2).when(bad_city, -1).otherwise(F.col("code")))


def label_condition(city_rule: str = "sign") -> Column:
    """Condition from trial_type and response_code; codes outside the rule give null."""
    code, mnt, city = F.col("response_code"), F.col("trial_type") == "mnt", F.col("trial_type") == "city"
    good, bad = (code > 0, code < 0) if city_rule == "sign" else (code != 0, code == 0)
    return (
        F.when(mnt & (code == 0), "mnt_correct")
        .when(mnt & (code != 0), "mnt_incorrect")
        .when(city & good, "city_correct")
        .when(city & bad, "city_incorrect")
    )


def zscore(col: str, keys: list[str], on_zero: str = "null") -> Column:
    """(x - mean) / population SD within the keys; for SD 0: null, 0, or 1e-30 added to every SD."""
    w = W.partitionBy(*keys)
    mean, sd = F.avg(col).over(w), F.stddev_pop(col).over(w)
    if on_zero == "eps":
        return (F.col(col) - mean) / (sd + FLOOR)
    return F.when(sd > 0, (F.col(col) - mean) / sd).when(F.col(col).isNotNull(), F.lit(None if on_zero == "null" else 0.0))


def center(col: str, keys: list[str]) -> Column:
    """x - mean within the keys."""
    return F.col(col) - F.avg(col).over(W.partitionBy(*keys))


def scale_by_max(col: str, keys: list[str]) -> Column:
    """x / max within the keys; null where the maximum is 0."""
    return F.try_divide(F.col(col), F.max(col).over(W.partitionBy(*keys)))


#: Steps of the grid on which computed values are compared: a power of two, so that scaling is exact and decimal values are no borders.
GRID = 2**30


def grid(x: Column) -> Column:
    """The step of the grid that is nearest to x, as a double.

    Sums of doubles end in noise that depends on their order. Values that are equal but for it share a step, so ties and signs
    don't hang on it.
    """
    scaled = x * F.lit(float(GRID))
    return F.when(F.abs(x) < float(2**32), F.floor(scaled + 0.5).cast("double")).otherwise(scaled)


def grid_round(x: Column, digits: int) -> Column:
    """x rounded by its step of the grid, so that halves fall the same way whatever the noise."""
    return F.round(grid(x) / F.lit(float(GRID)), digits)


#: Parts of a unit in which measured values are counted where their sums must be exact.
WHOLE = 10**9


def whole(x: Column) -> Column:
    """x in billionths, as a whole number: sums of these and of their squares are exact in any order up to 38 digits."""
    return F.round(x * F.lit(float(WHOLE))).cast("decimal(38,0)")


def half_up(x: Column, digits: int) -> Column:
    """x rounded by its step of the grid in plain double arithmetic, which every engine repeats to the bit."""
    p = float(10**digits)
    return F.signum(x) * F.floor(F.abs(grid(x)) / F.lit(float(GRID)) * p + 0.5) / p


def log_power(x: Column) -> Column:
    """log10 of a power, floored at 1e-30."""
    return F.log10(F.greatest(x, F.lit(FLOOR)))


def db_ratio(a: Column, b: Column) -> Column:
    """10 log10(a / b); null unless both are positive."""
    return F.when((a > 0) & (b > 0), 10 * F.log10(a / b))


def logit_r2(r2: Column) -> Column:
    """Logit of an R squared clipped to [1e-10, 1 - 1e-10]."""
    r = F.least(F.greatest(r2, F.lit(1e-10)), F.lit(1 - 1e-10))
    return F.log(r / (1 - r))


def fisher_z(r: Column) -> Column:
    """atanh(r) (P14)."""
    return F.atanh(r)


def parcel_network(label: Column, mapping: dict[str, str] | None = None, level: int = 1) -> Column:
    """First `level` tokens of a parcel label, renamed by a map whose default is the name itself."""
    name = F.array_join(F.slice(F.split(label, "_"), 1, level), "_")
    if not mapping:
        return name
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, name), name)


def is_brain_parcel(label: Column) -> Column:
    """Not scalp and not background."""
    return ~((label == "scalp") | label.startswith("Background+FreeSurfer"))


def select_regressors(df: DataFrame, prefix: str | None = None, contains: str | None = None) -> DataFrame:
    """Rows whose regressor name has a prefix or holds a piece."""
    keep = F.lit(True)
    if prefix is not None:
        keep &= F.col("regressor").startswith(prefix)
    if contains is not None:
        keep &= F.col("regressor").contains(contains)
    return df.filter(keep)


def sig_stars(p: Column) -> Column:
    """*** below .001, ** below .01, * below .05, else empty; null for null."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "")


def mask_channels(series: DataFrame, bad: DataFrame, keys: list[str], col: str = "v") -> DataFrame:
    """Values of listed channels become null (P18). `bad` holds distinct keys."""
    return (
        series.join(bad.select(*keys).distinct().withColumn("__bad", F.lit(True)), keys, "left")
        .withColumn(col, F.when(F.col("__bad").isNull(), F.col(col)))
        .drop("__bad")
    )
