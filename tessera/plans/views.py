"""Views that present the driver's tables as trials, samples, epochs and weighted values, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import label_condition


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials from events: subject = user, two runs, order by time; an 'error' event is an mnt trial."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    run = (F.col("event_id") % 2 + 1).cast("int")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    e = e.select("event_id", "user_id", run.alias("run"), k.alias("k"), "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = W.partitionBy("user_id", "run")
    mnt = F.col("event_type") == "error"
    pressed = F.when(mnt, F.col("k") % 10 < 3).otherwise(F.col("k") % 10 != 0)
    e = e.select(
        F.col("user_id").alias("subject"),
        "run",
        (F.row_number().over(w.orderBy("us", "event_id")) - 1).alias("trial_idx"),
        ((F.col("us") - F.min("us").over(w)) / 1e6).alias("onset"),
        F.when(mnt, "mnt").otherwise("city").alias("trial_type"),
        F.when(mnt, 1).otherwise(2).alias("stim"),
        F.when(pressed, F.col("value")).otherwise(0.0).alias("reaction_time"),
        F.when(mnt, F.when(pressed, -2).otherwise(0)).otherwise(F.when(pressed, 1).otherwise(-1)).alias("response_code"),
        F.when(mnt, F.when(pressed, -1).otherwise(0)).otherwise(F.when(pressed, 1).otherwise(0)).alias("code"),
    )
    return e.withColumn("condition", label_condition())


V_TRIALS = """
ev as (select event_id, user_id, event_type, value, (event_id % 2 + 1)::int as run, regexp_extract(props, '[0-9]+')::int as k, epoch_us(ts) as us from events),
pr as (select *, event_type = 'error' as mnt, case when event_type = 'error' then k % 10 < 3 else k % 10 <> 0 end as pressed from ev),
tr as (select user_id as subject, run, row_number() over (partition by user_id, run order by us, event_id) - 1 as trial_idx,
  (us - min(us) over (partition by user_id, run)) / 1e6 as onset, case when mnt then 'mnt' else 'city' end as trial_type,
  case when mnt then 1 else 2 end as stim, case when pressed then value else 0.0 end as reaction_time,
  case when mnt then case when pressed then -2 else 0 end else case when pressed then 1 else -1 end end as response_code,
  case when mnt then case when pressed then -1 else 0 end else case when pressed then 1 else 0 end end as code,
  case when mnt then case when pressed then 'mnt_incorrect' else 'mnt_correct' end else case when pressed then 'city_correct' else 'city_incorrect' end end as condition
  from pr),
rt as (select *, nullif(reaction_time, 0) as x,
  last_value(case when reaction_time <> 0 then trial_idx end ignore nulls) over p as pi, last_value(nullif(reaction_time, 0) ignore nulls) over p as px,
  first_value(case when reaction_time <> 0 then trial_idx end ignore nulls) over n as ni, first_value(nullif(reaction_time, 0) ignore nulls) over n as nx
  from tr window p as (partition by subject, run order by trial_idx rows between unbounded preceding and current row),
                n as (partition by subject, run order by trial_idx rows between current row and unbounded following)),
fi as (select *, case when px is null then nx when nx is null then px when pi = ni then px else px + (nx - px) / (ni - pi) * (trial_idx - pi) end as rt_filled from rt),
vt as (select subject, run, trial_idx, onset, trial_type, stim, reaction_time, response_code, code, condition, rt_filled,
  case when stddev_pop(x) over (partition by subject, run) > 0 then abs((rt_filled - avg(x) over (partition by subject, run)) / stddev_pop(x) over (partition by subject, run)) end as vtc from fi)
"""


def v_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular samples (subject, i, t, v) from all events of a user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    e = e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = W.partitionBy("user_id")
    return e.select(
        F.col("user_id").alias("subject"),
        (F.row_number().over(w.orderBy("us", "event_id")) - 1).alias("i"),
        ((F.col("us") - F.min("us").over(w)) / 1e6).alias("t"),
        F.col("value").alias("v"),
        "event_type",
    )


V_SAMPLES = """
sa as (select user_id as subject, row_number() over (partition by user_id order by ts, event_id) - 1 as i,
  (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6 as t, value as v, event_type from events)
"""

N_SUBJECTS = 14


def v_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs (subject, run, trial_idx, channel, event, v[64]) from embeddings; 64 samples from -0.2 s at 64 Hz."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    trial = F.floor(F.col("vec_id") / 4)
    return e.select(
        (trial % N_SUBJECTS).alias("subject"),
        F.lit(1).alias("run"),
        trial.alias("trial_idx"),
        (F.col("vec_id") % 4).alias("channel"),
        (F.col("label") % 3).alias("event"),
        F.col("embedding").cast("array<double>").alias("v"),
    )


V_EPOCHS = """
ep as (select (vec_id // 4) % 14 as subject, 1 as run, vec_id // 4 as trial_idx, vec_id % 4 as channel, label % 3 as event, embedding::double[] as v from embeddings)
"""


def v_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values x with variances m by parcel and network from line items."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_suppkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    x = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return x.select(
        F.col("l_partkey").alias("parcel"),
        F.col("p_brand").alias("network"),
        (F.col("l_suppkey") % 20).alias("subject"),
        F.col("l_linenumber").alias("run"),
        F.col("l_extendedprice").alias("x"),
        F.col("l_quantity").alias("m"),
    )


V_WEIGHTED = """
we as (select l_partkey as parcel, p_brand as network, l_suppkey % 20 as subject, l_linenumber as run, l_extendedprice as x, l_quantity as m
  from lineitem join part on l_partkey = p_partkey)
"""
