"""Queries of the joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.plans.views import V_EPOCHS, V_SAMPLES, V_TRIALS, v_epochs, v_samples, v_trials

Q, SQL = {}, {}
DAY = 86400.0


def query(name, sql=None, views=V_SAMPLES):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = f"with {views}{sql if sql.startswith(',') else ' ' + sql}"
        return f

    return add


def r(*cols, digits=5):
    return [F.round(F.col(c), digits).alias(c) for c in cols]


def sides(spark, d):
    s = v_samples(spark, d)
    return s.filter("event_type in ('error', 'purchase')").select("subject", "i", "t"), s.filter("event_type = 'view'").select("subject", F.col("t").alias("ts"), "v")


SIDES = ", l as (select subject, i, t from sa where event_type in ('error', 'purchase')), g as (select subject, t as ts, v from sa where event_type = 'view'), pv as (select l.subject, l.i, any_value(l.t) as t, max(ts) filter (ts <= l.t) as pt, arg_max(g.v, ts) filter (ts <= l.t) as px, min(ts) filter (ts >= l.t) as nt, arg_min(g.v, ts) filter (ts >= l.t) as nx from l left join g on l.subject = g.subject group by 1, 2) "


@query("j2_asof_nearest", SIDES + "select subject, i, round(case when nt is null or t - pt <= nt - t then pt else nt end, 3) as near_t, round(case when nt is null or t - pt <= nt - t then px else nx end, 5) as near_v from pv")
def _(spark, d):
    a, b = sides(spark, d)
    return J.asof_nearest(a, b, ["subject"], "t", "ts", "v").select("subject", "i", *r("near_t", digits=3), *r("near_v"))


@query("j3_asof_forward", SIDES + "select subject, i, round(nt, 3) as next_t, round(nx, 5) as next_v from pv")
def _(spark, d):
    a, b = sides(spark, d)
    return J.asof_forward(a, b, ["subject"], "t", "ts", "v").select("subject", "i", *r("next_t", digits=3), *r("next_v"))


@query("j4_interp_join", SIDES + "select subject, i, round(case when pt is null then nx when nt is null or nt = pt then px else px + (nx - px) * (t - pt) / (nt - pt) end, 5) as interp from pv")
def _(spark, d):
    a, b = sides(spark, d)
    return J.interp_join(a, b, ["subject"], "t", "ts", "v").select("subject", "i", *r("interp"))


@query("j5_window_mean", ", x as (select l.subject, l.i as trial_idx, avg(s.v) as mean_v, count(*) as n from sa l join sa s on l.subject = s.subject and s.t >= l.t - 86400 and s.t < l.t + 2 * 86400 where l.event_type = 'purchase' group by 1, 2) select subject, trial_idx, n, round(mean_v, 5) as mean_v from x where n >= 3")
def _(spark, d):
    s = v_samples(spark, d)
    trials = s.filter("event_type = 'purchase'").select("subject", F.col("i").alias("trial_idx"), F.col("t").alias("onset"))
    return J.window_mean(trials, s, ["subject"], -DAY, 2 * DAY, 3).select("subject", "trial_idx", "n", *r("mean_v"))


def blinks(spark, d):
    s = v_samples(spark, d).filter("event_type = 'error'")
    return s.select("subject", (F.col("t") - DAY / 4).alias("t_start"), (F.col("t") + DAY / 4).alias("t_stop"))


BLINK = ", b as (select subject, t - 21600.0 as t_start, t + 21600.0 as t_stop from sa where event_type = 'error') "


@query("j6_keep_in_intervals", BLINK + "select subject, i from sa where exists (select 1 from b where b.subject = sa.subject and sa.t >= t_start and sa.t <= t_stop)")
def _(spark, d):
    return J.keep_in_intervals(v_samples(spark, d), blinks(spark, d), ["subject"], DAY / 2).select("subject", "i")


@query("j7_mask_intervals", BLINK + "select subject, i, case when not exists (select 1 from b where b.subject = sa.subject and sa.t >= t_start and sa.t <= t_stop) then round(v, 5) end as v from sa")
def _(spark, d):
    return J.mask_intervals(v_samples(spark, d), blinks(spark, d), ["subject"]).select("subject", "i", *r("v"))


@query("j8_clock_offset", ", a as (select subject, run, arg_min(onset + 3.5, trial_idx) as a0, arg_min(onset, trial_idx) as b0 from tr group by 1, 2) select subject, run, round(a0 - b0, 5) as offset from a", V_TRIALS)
def _(spark, d):
    t = v_trials(spark, d)
    return J.clock_offset(t.withColumn("onset", F.col("onset") + 3.5), t, ["subject", "run"]).select("subject", "run", *r("offset"))


def shifted(spark, d):
    """The same trials under other run ids (3 - run) and, for relative matching, another clock."""
    t = v_trials(spark, d)
    return t, t.withColumn("run", F.lit(3) - F.col("run"))


SWAP = "select subject, run as run_a, 3 - run as run_b from tr group by 1, 2"


def _match(name, by, shift):
    # The first run whose trials fit; a subject has two, so the copy under the other id is found (unless both fit).
    @query(name)
    def _(spark, d):
        a, b = shifted(spark, d)
        return J.match_runs(a, b.withColumn("onset", F.col("onset") + shift), by=by).select("subject", "run_a", "run_b")


_match("j9_match_runs_onsets", "onsets", 12.0)
_match("j10_match_runs_first", "first", 0.0)
_match("j11_match_runs_first_row", "first_row", 0.0)
_match("j11_match_runs_time_axis", "time_axis", 0.0)
SQL["j9_match_runs_onsets"] = f"""with {V_TRIALS}, n as (select *, count(*) over (partition by subject, run) as n from tr),
p as (select a.subject, a.run as run_a, 3 - b.run as run_b, max(abs(a.onset - b.onset) - (0.05 + 1e-5 * abs(b.onset))) as g, count(*) as c, any_value(a.n) as n
  from n a join n b on a.subject = b.subject and a.n = b.n and a.trial_idx = b.trial_idx group by 1, 2, 3)
select subject, run_a, min(run_b) as run_b from p where g <= 0 and c = n group by 1, 2"""
SQL["j10_match_runs_first"] = f"with {V_TRIALS} select subject, run as run_a, min(run) over (partition by subject) as run_b from (select distinct subject, run from tr)"
SQL["j11_match_runs_first_row"] = f"""with {V_TRIALS}, f as (select subject, run, onset, trial_type, reaction_time from tr where trial_idx = 0)
select a.subject, a.run as run_a, min(3 - b.run) as run_b from f a join f b using (subject, onset, trial_type, reaction_time) group by 1, 2"""
SQL["j11_match_runs_time_axis"] = f"""with {V_TRIALS}, f as (select subject, run, list(onset order by onset) as ts from tr group by 1, 2)
select a.subject, a.run as run_a, min(3 - b.run) as run_b from f a join f b using (subject, ts) group by 1, 2"""


@query("j12_align_trials", ", m as (select subject, run, trial_idx, condition, trunc(onset)::bigint as sample from tr) select subject, run, trial_idx from m semi join (select * from m where condition = 'city_correct') c using (subject, run, sample)", V_TRIALS)
def _(spark, d):
    m = v_trials(spark, d).withColumn("sample", F.col("onset").cast("long"))
    return J.align_trials(m, m.filter("condition = 'city_correct'")).select("subject", "run", "trial_idx")


def series_and_marks(spark, d):
    """Embeddings as 64-sample series, with a marker every 9 samples from 3 on."""
    e = v_epochs(spark, d).withColumn("sfreq", F.lit(10.0)).withColumnRenamed("trial_idx", "series")
    marks = e.select("subject", "run", "series").distinct().withColumn("sample", F.explode(F.expr("sequence(3L, 63L, 9L)")))
    return e.drop("event"), marks


CUT = ", s as (select *, unnest(range(3, 64, 9)) as sample from ep) "


@query("j13_epoch", CUT + "select subject, run, trial_idx as series, channel, sample::bigint as sample, 11 as n, round(list_sum(v[sample - 2 + 1:sample + 8 + 1]), 4) as total from s where sample - 2 >= 0 and sample - 2 + 11 <= 64", V_EPOCHS)
def _(spark, d):
    s, m = series_and_marks(spark, d)
    x = J.epoch(s, m, -0.2, 0.8, ["subject", "run", "series"])
    total = F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 4)
    return x.select("subject", "run", "series", "channel", "sample", F.size("v").alias("n"), total.alias("total"))


@query("j14_epoch_response_padded", CUT + "select subject, run, trial_idx as series, channel, sample::bigint as sample, 16 as n, len(list_filter(range(sample - 10, sample + 6), lambda z: z >= 0 and z < 64))::int as n_valid, round(list_sum(v[greatest(sample - 10, 0) + 1:sample + 5 + 1]), 4) as total from s", V_EPOCHS)
def _(spark, d):
    s, m = series_and_marks(spark, d)
    x = J.epoch(s, m, -1.0, 0.5, ["subject", "run", "series"], pad=True)
    ok = F.filter("v", lambda a: a.isNotNull())
    return x.select("subject", "run", "series", "channel", "sample", F.size("v").alias("n"), F.size(ok).alias("n_valid"), F.round(F.aggregate(ok, F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query("j15_neighbour_pairs", ", ve as (select vec_id as vertex, embedding[1]::double * 50 as x, embedding[2]::double * 50 as y, embedding[3]::double * 50 as z from embeddings) select a.vertex as a, b.vertex as b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 4) as distance from ve a join ve b on a.vertex < b.vertex where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 5", V_EPOCHS)
def _(spark, d):
    return J.neighbour_pairs(vertices(spark, d), 5.0).select("a", "b", *r("distance", digits=4))


def vertices(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    return e.select(F.col("vec_id").alias("vertex"), *[(F.col("embedding")[k].cast("double") * 50).alias(c) for k, c in enumerate("xyz")])


