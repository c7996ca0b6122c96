"""Queries of the window operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import trials as T
from tessera.operators import windows as X
from tessera.plans.views import V_SAMPLES, V_TRIALS, v_samples, v_trials

Q, SQL = {}, {}
S = ["subject"]


def query(name, sql=None, views=V_SAMPLES):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = f"with {views}{sql if sql.startswith(',') else ' ' + sql}"
        return f

    return add


def r(*cols, digits=5):
    return [F.round(F.col(c), digits).alias(c) for c in cols]


for _edge in ("nearest", "zero"):
    _extra = " + greatest(0, 3 - i) * first_value(v) over f + greatest(0, i + 2 - (count(*) over f - 1)) * last_value(v) over f" if _edge == "nearest" else ""

    @query(f"w5_moving_avg_{_edge}", f"select subject, i, round((sum(v) over m{_extra}) / 6, 5) as moving from sa window m as (partition by subject order by i rows between 3 preceding and 2 following), f as (partition by subject order by i rows between unbounded preceding and unbounded following)")
    def _(spark, d, edge=_edge):
        return X.moving_avg(v_samples(spark, d), "v", S, ["i"], 6, edge).select("subject", "i", *r("moving"))


@query("w9_equal_count_bins", ", b as (select *, ntile(7) over (partition by subject order by v, i) as bin from sa) select subject, bin::int as bin, round(avg(v), 5) as x_mean, round(avg(t), 3) as y_mean, count(*) as n from b group by 1, 2")
def _(spark, d):
    x = X.equal_count_bins(v_samples(spark, d), "v", 7, S, "t", "i")
    return x.select("subject", "bin", *r("x_mean"), *r("y_mean", digits=3), "n")


@query("w9_equal_count_bins_global", ", b as (select *, ntile(11) over (order by value, event_id) as bin from events) select bin::int as bin, round(avg(value), 5) as x_mean, round(avg(event_id::double), 3) as y_mean, count(*) as n from b group by 1")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value", F.col("event_id").cast("double").alias("y"))
    return X.equal_count_bins_global(e, "value", 11, "y", "event_id").select("bin", *r("x_mean"), *r("y_mean", digits=3), "n")


for _mode in ("closed_last", "digitize"):
    _cap = "least(4, {})" if _mode == "closed_last" else "{}"

    @query(f"w10_quantile_bins_{_mode}", ", e as (select subject, quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) as q from sa group by 1), b as (select sa.subject, " + _cap.format("len(list_filter(q, lambda z: z <= v))") + "::int as bin from sa join e using (subject)) select subject, bin, count(*) as n from b group by 1, 2")
    def _(spark, d, mode=_mode):
        return X.quantile_bins(v_samples(spark, d), "v", 5, S, mode).groupBy("subject", "bin").agg(F.count("*").alias("n"))


@query("w11_fixed_bins", ", z as (select subject, reaction_time, (vtc - 1) as x from vt), p as (select subject, floor((x + 1.5) / 0.3)::int as bin, avg(reaction_time) as m from z where x >= -1.5 and x < 1.5 group by 1, 2) select bin, round(avg(m), 5) as mean, round(stddev_samp(m) / sqrt(count(m)), 5) as sem, count(m) as n_subjects from p group by 1 having count(m) >= 2", V_TRIALS)
def _(spark, d):
    t = T.vtc(v_trials(spark, d)).withColumn("x", F.col("VTC") - 1)
    return X.fixed_bins(t, "x", "reaction_time").select("bin", *r("mean", "sem"), "n_subjects")


@query("w12_sliding_samples", ", n as (select *, count(*) over (partition by subject) as n from sa), w as (select *, unnest(range(greatest(0, ceil((i - 9) / 4)::int), least(floor(i / 4), floor((n - 10) / 4))::int + 1))::int as window_id from n where n >= 10) select subject, window_id, round(avg(v), 5) as v_mean, round(avg(t), 3) as t_mean from w group by subject, window_id having window_id * 4 + 4.5 >= 6 and window_id * 4 + 4.5 <= any_value(n) - 1 - 6")
def _(spark, d):
    x = X.sliding_samples(v_samples(spark, d), S, 10, 4, ["v", "t"], edge=6)
    return x.select("subject", "window_id", *r("v_mean"), *r("t_mean", digits=3))


FLAT = ", q as (select subject, i, t, floor(v / 100) as v from sa) "


def coarse(spark, d):
    return v_samples(spark, d).withColumn("v", F.floor(F.col("v") / 100))


@query("w13_longest_flat", FLAT + ", c as (select *, coalesce((v <> lag(v) over (partition by subject order by i))::int, 1) as c from q), g as (select *, sum(c) over (partition by subject order by i) as g from c), l as (select subject, g, count(*) - 1 as l from g group by 1, 2) select subject, max(l) as longest from l group by 1 having max(l) >= 2")
def _(spark, d):
    return X.bad_by_flat(coarse(spark, d), S, 1.0, 2.0)


def trigger(spark, d):
    return v_samples(spark, d).withColumn("v", F.when(F.col("event_type") == "view", 0.0).otherwise(5.0))


TRIG = ", q as (select subject, i, t, case when event_type = 'view' then 0.0 else 5.0 end as v from sa), lo as (select *, v < max(v) over (partition by subject) / 2 as low from q), ed as (select *, low and not lag(low) over w as fall, low and not lead(low) over w as rise from lo window w as (partition by subject order by i)) "


@query("w14_trigger_falling", TRIG + "select subject, i, round(t, 3) as t, round(t - lag(t) over (partition by subject order by i), 3) as gap from ed where fall")
def _(spark, d):
    return X.trigger_edges(trigger(spark, d), S).select("subject", "i", *r("t", "gap", digits=3))


@query("w14_trigger_rising", TRIG + "select subject, i, round(t, 3) as t, round(t - lag(t) over (partition by subject order by i), 3) as gap from ed where rise")
def _(spark, d):
    return X.trigger_edges(trigger(spark, d), S, "rising").select("subject", "i", *r("t", "gap", digits=3))


@query("w14_trigger_mid", TRIG + "select subject, min(i) as i, round(arg_min(t, i), 3) as t from ed where fall group by 1")
def _(spark, d):
    return X.trigger_edges(trigger(spark, d), S, "mid").select("subject", "i", *r("t", digits=3))


@query("w15_trigger_span", TRIG + ", f as (select *, avg((v = 0)::int) over (partition by subject) > 0.5 as flip from q), g as (select subject, (t - lag(t) over (partition by subject order by i)) / 60 as gap from f where (v = 0) <> flip) select subject, round(max(gap), 3) as longest_gap, max(gap) < 6 as too_short from g group by 1")
def _(spark, d):
    return X.trigger_span(trigger(spark, d), S).select("subject", *r("longest_gap", digits=3), "too_short")


@query("w16_crop_to_trigger", TRIG + ", b as (select subject, min(i) as a, max(i) as b from q where v = 0 group by 1) select q.subject, q.i from q join b using (subject) where i between a and b")
def _(spark, d):
    return X.crop_to_trigger(trigger(spark, d), S, F.col("v") == 0).select("subject", "i")


@query("w17_zero_crossings", ", q as (select subject, i, t, v - avg(v) over (partition by subject) as v from sa), l as (select *, lead(v) over (partition by subject order by i) as nv, lead(t) over (partition by subject order by i) as nt from q) select subject, i, round(t - v * (nt - t) / (nv - v), 2) as t_zero from l where sign(v) <> sign(nv)")
def _(spark, d):
    from tessera.functions.scalars import center

    return X.zero_crossings(v_samples(spark, d).withColumn("v", center("v", S)), S).select("subject", "i", *r("t_zero", digits=2))


@query("w19_delay_regressors", "select subject, i, round(v, 5) as delay0, round(lag(v, 1) over w, 5) as delay1, round(lag(v, 2) over w, 5) as delay2 from sa window w as (partition by subject order by i) qualify i >= 3")
def _(spark, d):
    return X.delay_regressors(v_samples(spark, d), S, "v", 3).select("subject", "i", *r("delay0", "delay1", "delay2"))


@query("w20_lag_matrix", "select subject, i, round(v, 5) as lag0, round(coalesce(lag(v, 1) over w, 0), 5) as lag1 from sa window w as (partition by subject order by i)")
def _(spark, d):
    return X.lag_matrix(v_samples(spark, d), S, "v", 2).select("subject", "i", *r("lag0", "lag1"))


@query("w22_concat_runs", ", e as (select subject, run, max(onset) + 0.8 as len from tr group by 1, 2), o as (select subject, run, coalesce(sum(len) over (partition by subject order by run rows between unbounded preceding and 1 preceding), 0) as o from e) select subject, run, trial_idx, round(onset + o, 3) as t_all from tr join o using (subject, run)", V_TRIALS)
def _(spark, d):
    t = v_trials(spark, d).withColumn("t", F.col("onset"))
    return X.concat_runs(t, 0.8).select("subject", "run", "trial_idx", *r("t_all", digits=3))


@query("w23_session_offset", ", e as (select subject, run, max(onset) as len from tr group by 1, 2) select subject, run, round(coalesce(sum(len) over (partition by subject order by run rows between unbounded preceding and 1 preceding), 0), 3) as off from e", V_TRIALS)
def _(spark, d):
    t = v_trials(spark, d).withColumn("t", F.col("onset"))
    return X.concat_runs(t, 0.0).groupBy("subject", "run").agg(F.round(F.max("offset"), 3).alias("off"))


@query("w24_fdr_bh", ", p as (select subject, i, (1 + floor(v) % 200) / 4000.0 as p from sa), m as (select *, count(*) over (partition by subject) as m, count(*) over (partition by subject order by p range between unbounded preceding and current row) as k from p), a as (select *, least(1.0, min(p * m / k) over (partition by subject order by p desc range between unbounded preceding and current row)) as p_adj from m) select subject, i, round(p_adj, 6) as p_adj, round(p_adj, 9) <= 0.05 as reject from a")
def _(spark, d):
    x = v_samples(spark, d).withColumn("p", (F.floor("v") % 200 + 1) / 4000.0)
    out = X.fdr_bh(x, "p", S)
    return out.select("subject", "i", *r("p_adj", digits=6), (F.round("p_adj", 9) <= 0.05).alias("reject"))


@query("w25_bonferroni")
def _(spark, d):
    n = v_trials(spark, d).select("subject").distinct().agg(F.count("*").alias("n"))
    from tessera.functions.stats import t_critical

    alpha = 0.05 / (F.col("n") * 30)
    return n.select("n", F.round(alpha, 10).alias("alpha"), F.round(t_critical(1 - alpha / 2, F.col("n") - 1.0), 5).alias("t_crit"))
