"""Sorted ranges: ranks, running values and neighbours where one key may hold most of the rows.

Rows are dealt into ranges of their order, so a large key spans many tasks. What a range needs of the others is one row per
key and range: a count, a sum, an extreme. These are accumulated over the ranges of a key, and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.session import materialize

RANGE = "__range"


def in_ranges(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`df` in ranges of (keys, order), numbered by the column __range; equal values share a range.

    The bounds come from a sample, so the rows are written: every read sees the same ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *keys, order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def carried(ranged: DataFrame, keys: list[str], of_range: dict[str, Column], before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, total: dict[str, Column] | None = None) -> DataFrame:
    """`ranged` with what the other ranges of a key hold.

    `of_range` are aggregates of a (key, range); `before`, `after` and `total` are aggregates of those over the ranges of the key
    that come earlier, that come later, and over all. A key has one row per range in these windows.
    """
    sums = ranged.groupBy(*keys, RANGE).agg(*[c.alias(n) for n, c in of_range.items()])
    own = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    frames = [
        (before, own.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)),
        (after, own.orderBy(F.desc(RANGE)).rowsBetween(W.unboundedPreceding, -1)),
        (total, own),
    ]
    made = {n: c.over(w) for columns, w in frames for n, c in (columns or {}).items()}
    # Null keys are keys too.
    sums = sums.withColumns(made).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(RANGE).alias("__kr"), *made)
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col(RANGE) == F.col("__kr")]
    return ranged.join(sums, on).drop(*[f"__k{i}" for i in range(len(keys))], "__kr")


def exact_quantiles(df: DataFrame, keys: list[str], x: str, qs: list[float], out: str = "q") -> DataFrame:
    """(keys, out): exact quantiles with linear interpolation, as an array; nulls don't count, a key without values has null elements.

    The values at the ranks around (n - 1) x q are picked by their place in the sorted ranges, so no task holds the values of a key.
    """
    rows = in_ranges(df.select(*keys, F.col(x).cast("double").alias("__x")), keys, "__x")
    placed = carried(rows, keys, {"__c": F.count("__x")}, before={"__before": F.sum("__c")}, total={"__n": F.sum("__c")})
    place = F.row_number().over(W.partitionBy(*keys, RANGE, F.col("__x").isNull()).orderBy("__x")) - 1 + F.coalesce("__before", F.lit(0))
    placed = placed.withColumn("__i", F.when(F.col("__x").isNotNull(), place))
    at = [(F.col("__n") - 1) * F.lit(float(q)) for q in qs]
    value = lambda i: F.max(F.when(F.col("__i") == i, F.col("__x")))
    ends = [value(f(h)).alias(f"__{n}{k}") for k, h in enumerate(at) for n, f in (("l", F.floor), ("h", F.ceil))]
    g = placed.groupBy(*keys).agg(F.max("__n").alias("__n"), *ends)
    part = lambda k, h: F.col(f"__l{k}") + (F.col(f"__h{k}") - F.col(f"__l{k}")) * (h - F.floor(h))
    return g.select(*keys, F.array(*[part(k, h) for k, h in enumerate(at)]).alias(out))
