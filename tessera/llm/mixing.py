"""Operator 7: mixing sources to target weights with distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.session import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
ROWS_PER_RANGE = 2_000


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """Per source (source, source_size): its target. One row per source, so its windows stay small.

    Weights repeat over the sources in code-point order, null last. All targets sum to all sizes;
    none passes `max_epochs` x its source's size, and what that frees goes to the others by weight:
    target = min(cap, level x weight), with the level found over sources ordered by cap / weight.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = w.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = w.withColumns(
        {
            "cap_before": F.coalesce(F.sum("cap").over(order), F.lit(0.0)),
            "weight_before": F.coalesce(F.sum("weight").over(order), F.lit(0.0)),
            "weight_all": F.sum("weight").over(every),
            "size_all": F.sum("source_size").over(every).cast("double"),
        }
    )
    level = (F.col("size_all") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before"))
    w = w.withColumn("level", F.when(level * F.col("weight") < F.col("cap"), level))
    w = w.withColumn("level", F.max("level").over(every))
    return w.select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


#: Digits of a range that one window orders: at most 16^3 rows.
LEVEL_DIGITS = 3


def range_starts(sums: DataFrame, digits: int, level_digits: int = LEVEL_DIGITS) -> DataFrame:
    """(tag, none, range, range_start) from (tag, none, range, range_size): the sizes before each range of its source.

    Level by level: sizes are summed by prefixes of `level_digits` digits, and a prefix starts where its parent
    does plus the sizes of the siblings before it. So no window holds more than 16^`level_digits` rows, however
    many ranges a source has.
    """
    if digits > level_digits:
        sums = materialize(sums, "range-sums")
    starts, above = None, 0
    for upto in [*range(level_digits, digits, level_digits), digits]:
        level = sums.groupBy("tag", "none", F.substring("range", 1, upto).alias("range")).agg(F.sum("range_size").alias("range_size"))
        level = level.withColumn("parent", F.substring("range", 1, above))
        before = W.partitionBy("tag", "none", "parent").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
        level = level.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
        if starts is not None:
            up = starts.select("tag", "none", F.col("range").alias("parent"), F.col("range_start").alias("parent_start"))
            level = level.join(up, ["tag", "none", "parent"]).withColumn("range_start", F.col("range_start") + F.col("parent_start"))
        starts, above = level.select("tag", "none", "range", "range_start"), upto
    return starts


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 7,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Take words of each source up to its exact budget: (id, source, size, source_size, target, taken, text_md5).

    Each document gets a key by the hash of its id and text, so rows that share an id, or have none, spread like others. Within a source, documents in key order fill the budget:
    whole epochs first, then the documents whose running size fits, the last one cut so that the
    source gives floor(target) words. Keys are uniform, so the leading key digits are the ranges of a
    range sort; sizes are pre-summed per (source, range), and a document's offset is the sum of the
    ranges before it, found level by level of the digits, plus its place in its range. A hot source is
    spread over many ranges, and the number of ranges follows the row count, so that a range holds about
    `rows_per_range` rows.

    Cases: null text has size 0; a null source is a source of its own, last in order; rows with one id and text are
    equal and take what is left in turn; `text_md5` ties a row to its text (null for null); a corpus without words takes nothing; an empty table gives an
    empty result; other columns are not read. The same rows give the same result in any partitioning.
    """
    base = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.col(text_col)).alias("text_md5"),
    )
    base = base.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce("text_md5", F.lit("")))))
    base = materialize(base, "mix")  # the texts are read once
    n = base.count()
    digits = 1
    while 16**digits * rows_per_range < n:
        digits += 1
    base = base.withColumn("range", F.substring("key", 1, digits))

    base = base.withColumns({"tag": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})
    sums = base.groupBy("tag", "none", "range").agg(F.sum("size").alias("range_size"))
    sizes = sums.groupBy("tag", "none").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(sizes.select(F.when(~F.col("none"), F.col("tag")).alias("source"), "source_size"), weights, max_epochs)
    targets = targets.withColumns({"tag": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()}).drop("source")
    ranges = range_starts(sums, digits).join(targets, ["tag", "none"])

    own = W.partitionBy("tag", "none", "range").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    base = base.withColumn("in_range", F.coalesce(F.sum("size").over(own), F.lit(0)))
    placed = base.join(ranges, ["tag", "none", "range"])
    offset = F.col("range_start") + F.col("in_range")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - offset))
    return placed.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        taken.cast("long").alias("taken"),
        "text_md5",
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at weights 5, 2, 1 and at most 3 epochs."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         md5(concat('7:', coalesce(cast(doc_id as varchar), ''), ':', coalesce(md5(text), ''))) as key
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source asc nulls last) - 1 as rank from s),
w as (select *, [5.0, 2.0, 1.0][(rank % 3 + 1)::int]::double as weight, source_size * 3.0::double as cap from r),
p as (select *,
        coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0.0::double) as cap_before,
        coalesce(sum(weight) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0.0::double) as weight_before,
        sum(weight) over () as weight_all, (sum(source_size) over ())::double as size_all
      from w),
l as (select *, (size_all - cap_before) / (weight_all - weight_before) as level from p),
t as (select source, source_size,
        least(cap, coalesce(max(case when level * weight < cap then level end) over () * weight, cap))::double as target
      from l),
o as (select d.doc_id, d.size, t.source_size, t.target,
        coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size
                 rows between unbounded preceding and 1 preceding), 0)::bigint as pos
      from d join t on d.source is not distinct from t.source),
e as (select *, floor(target)::bigint as budget,
        case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs from o)
select doc_id, size::bigint as size, source_size, target,
       (epochs * size + least(size, greatest(0, budget - epochs * source_size - pos)))::bigint as taken
from e
"""
