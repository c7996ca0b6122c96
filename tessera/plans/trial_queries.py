"""Queries over trials, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import trials as T
from tessera.plans.views import V_TRIALS, v_samples, v_trials

RUN = ["subject", "run"]
KEYS = ["subject", "run", "trial_idx"]
Q, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = f"with {V_TRIALS}{sql if sql.startswith(',') else ' ' + sql}"
        return f

    return add


def r(*cols, digits=6):
    """Rounded columns under their own names."""
    return [F.round(F.col(c), digits).alias(c) for c in cols]


def rg(*cols, digits=6):
    """Columns rounded by their step of the grid."""
    return [S.grid_round(F.col(c), digits).alias(c) for c in cols]


def sql_grid(x):
    """`scalars.grid` in SQL."""
    return f"floor(({x}) * {S.GRID} + 0.5)"


def sql_round(x, digits=6):
    """`scalars.grid_round` in SQL."""
    return f"round({sql_grid(x)} / {S.GRID}, {digits})"


def v_vtc(spark, d):
    return T.vtc(v_trials(spark, d))


def sql_whole(x):
    """`scalars.whole` in SQL."""
    return f"round(({x}) * {float(S.WHOLE)}::double)::hugeint"


def sql_double(x):
    """A whole number as the nearest double; the cast from hugeint alone rounds twice."""
    return f"({x})::varchar::double"


def sql_half_up(x, digits=6):
    """`scalars.half_up` in SQL."""
    return f"sign({x}) * floor(abs({sql_grid(x)}) / {S.GRID} * 1e{digits} + 0.5) / 1e{digits}"


def rh(*cols, digits=6):
    """Columns rounded by their step of the grid in plain double arithmetic."""
    return [S.half_up(F.col(c), digits).alias(c) for c in cols]


#: VTC from whole-number sums: equal to the bit in any order of rows, so no zone hangs on the noise of sums.
EXACT = f", ex as (select *, {sql_whole('x')} as u, {sql_whole('rt_filled')} as uf from fi), mo as (select subject, run, count(u) as n, sum(u) as s, sum(u * u) as q from ex group by 1, 2), vz as (select ex.*, case when n * q - s * s > 0 then {sql_double('abs(n * uf - s)')} / sqrt({sql_double('n * q - s * s')}) end as vtc from ex join mo using (subject, run))"
ZONED = EXACT + f", th as (select subject, quantile_cont({sql_grid('vtc')}, 0.5) as q from vz group by 1), zo as (select vz.*, case when {sql_grid('vtc')} < q then 'in' when vtc is not null then 'out' end as zone from vz join th using (subject)) "


def v_exact_vtc(spark, d):
    return T.exact_vtc(v_trials(spark, d))


def v_zoned(spark, d):
    return T.zone_label(v_exact_vtc(spark, d), "VTC", ["subject"])


@query("p1_drop_last_trial", "select subject, run, trial_idx from tr qualify row_number() over (partition by subject, run order by trial_idx desc) > 1")
def _(spark, d):
    return T.drop_last_trial(v_trials(spark, d), RUN, "trial_idx").select(*KEYS)


@query("p2_recode_response", "select subject, run, trial_idx, case when stim = 1 and code = -1 then -2 when stim = 2 and code = 0 then -1 else code end as response_code from tr")
def _(spark, d):
    return S.recode_response(v_trials(spark, d).drop("response_code")).select(*KEYS, "response_code")


@query("p3_recode_by_press", "select subject, run, trial_idx, case when stim = 1 and reaction_time <> 0 then -2 when stim = 2 and reaction_time = 0 then -1 else code end as response_code from tr")
def _(spark, d):
    return S.recode_response(v_trials(spark, d).drop("response_code").withColumnRenamed("reaction_time", "rt"), by="press").select(*KEYS, "response_code")


@query("p4_label_sign", "select condition, count(*) as n from tr group by 1")
def _(spark, d):
    return v_trials(spark, d).groupBy("condition").agg(F.count("*").alias("n"))


@query("p5_label_nonzero", "select case when trial_type = 'mnt' then case when response_code = 0 then 'mnt_correct' else 'mnt_incorrect' end when response_code <> 0 then 'city_correct' else 'city_incorrect' end as condition, count(*) as n from tr group by 1")
def _(spark, d):
    return v_trials(spark, d).withColumn("condition", S.label_condition("nonzero")).groupBy("condition").agg(F.count("*").alias("n"))


@query("p6_trial_timing", "select subject, run, trial_idx, round(onset - 0.5 + 2.0, 6) as onset, round(lead(onset) over (partition by subject, run order by trial_idx) - onset, 6) as duration from tr")
def _(spark, d):
    t = v_trials(spark, d).withColumnRenamed("onset", "onset_clock").withColumns({"start_clock": F.lit(0.5), "device_offset": F.lit(2.0)})
    return T.trial_timing(t).select(*KEYS, *r("onset", "duration"))


MARKS = ", ma as (select subject, run, trial_idx, 'stimulus' as lock, response_code as event, trunc(onset * 100)::bigint as sample from tr union all select subject, run, trial_idx, 'response', case when response_code < 0 then response_code - 10 else response_code + 10 end, trunc((onset + reaction_time) * 100)::bigint from tr) "


@query("p7_markers", MARKS + "select lock, event, count(*) as n, sum(sample)::bigint as samples from ma group by 1, 2")
def _(spark, d):
    return T.markers(v_trials(spark, d), 100.0).groupBy("lock", "event").agg(F.count("*").alias("n"), F.sum("sample").alias("samples"))


@query("p8_filter_in_range", MARKS + ", re as (select subject, run, max(trunc(onset * 100))::bigint as n_samples from tr group by 1, 2) select subject, run, trial_idx, lock from ma join re using (subject, run) where sample >= 20 and sample <= n_samples - 100")
def _(spark, d):
    t = v_trials(spark, d)
    rec = t.groupBy(*RUN).agg(F.max((F.col("onset") * 100).cast("long")).alias("n_samples"))
    return T.filter_in_range(T.markers(t, 100.0), rec, -0.2, 1.0, 100.0).select(*KEYS, "lock")


def _z(name, on_zero, sql):
    @query(name, f"select subject, run, trial_idx, round({sql}, 6) as z from tr window w as (partition by subject, run)")
    def _(spark, d):
        return v_trials(spark, d).withColumn("z", S.zscore("reaction_time", RUN, on_zero)).select(*KEYS, *r("z"))


_z("p9_zscore", "null", "case when stddev_pop(reaction_time) over w > 0 then (reaction_time - avg(reaction_time) over w) / stddev_pop(reaction_time) over w end")
_z("p10_zscore_zero", "zero", "case when stddev_pop(reaction_time) over w > 0 then (reaction_time - avg(reaction_time) over w) / stddev_pop(reaction_time) over w else 0.0 end")
_z("p10_zscore_eps", "eps", "(reaction_time - avg(reaction_time) over w) / (stddev_pop(reaction_time) over w + 1e-30)")


@query("p11_center", "select subject, run, trial_idx, round(vtc - avg(vtc) over (partition by subject, run), 6) as centred from vt")
def _(spark, d):
    return v_vtc(spark, d).withColumn("centred", S.center("VTC", RUN)).select(*KEYS, *r("centred"))


@query("p12_scale_by_max", "select subject, run, trial_idx, round(reaction_time / nullif(max(reaction_time) over (partition by subject, run), 0), 6) as scaled from tr")
def _(spark, d):
    return v_trials(spark, d).withColumn("scaled", S.scale_by_max("reaction_time", RUN)).select(*KEYS, *r("scaled"))


@query("p13_log_power", f"select subject, run, trial_idx, round(log10(greatest(reaction_time, 1e-30)), 6) as log_p, round(case when reaction_time > 0 and {sql_grid('vtc')} > 0 then 10 * log10(reaction_time / vtc) end, 6) as db from vt")
def _(spark, d):
    # A deviation that is zero on the grid is noise of the mean: its ratio is null.
    deviation = F.when(S.grid(F.col("VTC")) > 0, F.col("VTC"))
    t = v_vtc(spark, d).withColumns({"log_p": S.log_power(F.col("reaction_time")), "db": S.db_ratio(F.col("reaction_time"), deviation)})
    return t.select(*KEYS, *r("log_p", "db"))


@query("p14_logit_fisher", ", c as (select subject, corr(reaction_time, onset) as c from tr group by 1) select subject, round(ln(least(greatest(c * c, 1e-10), 1 - 1e-10) / (1 - least(greatest(c * c, 1e-10), 1 - 1e-10))), 5) as logit, round(atanh(c), 6) as z from c")
def _(spark, d):
    c = v_trials(spark, d).groupBy("subject").agg(F.corr("reaction_time", "onset").alias("c"))
    return c.select("subject", F.round(S.logit_r2(F.col("c") * F.col("c")), 5).alias("logit"), F.round(S.fisher_z(F.col("c")), 6).alias("z"))


@query("p17_sig_stars", "select case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else '' end as stars, count(*) as n from (select (trial_idx % 100) / 1000.0 as p from tr) group by 1")
def _(spark, d):
    return v_trials(spark, d).select(S.sig_stars(F.col("trial_idx") % 100 / 1000.0).alias("stars")).groupBy("stars").agg(F.count("*").alias("n"))


@query("j1_trials_with_threshold", ", th as (select subject, quantile_cont(vtc, 0.5) as q from vt group by 1) select subject, run, trial_idx, round(vtc - q, 6) as gap from vt join th using (subject)")
def _(spark, d):
    t = v_vtc(spark, d)
    return t.join(T.median_by(t, ["subject"], "VTC"), "subject").select(*KEYS, F.round(F.col("VTC") - F.col("threshold"), 6).alias("gap"))


@query("a1_zone_confusion", ZONED + "select subject, run, zone, count(*) filter (condition = 'mnt_correct') as co, count(*) filter (condition = 'mnt_incorrect') as ce, count(*) filter (condition = 'city_correct') as cc, count(*) filter (condition = 'city_incorrect') as oe from zo where zone is not null group by 1, 2, 3")
def _(spark, d):
    return T.zone_confusion(v_zoned(spark, d))


RATES = ZONED + ", cf as (select subject, zone, count(*) filter (condition = 'mnt_correct') as co, count(*) filter (condition = 'mnt_incorrect') as ce, count(*) filter (condition = 'city_correct') as cc, count(*) filter (condition = 'city_incorrect') as oe from zo where zone is not null group by 1, 2) "


@query("a2_zone_error_rates", RATES + f"select subject, zone, co, ce, cc, oe, {sql_round('ce / nullif(ce + co, 0)')} as ce_rate, {sql_round('oe / nullif(oe + cc, 0)')} as oe_rate from cf")
def _(spark, d):
    x = T.zone_error_rates(T.zone_confusion(v_zoned(spark, d), ["subject", "zone"]))
    return x.select("subject", "zone", "co", "ce", "cc", "oe", *rg("ce_rate", "oe_rate"))


MEAN = f"{sql_double('s')} / {float(S.WHOLE)} / nullif(n, 0)"


@query("a3_zone_rt_stats", ZONED + f"select subject, zone, {sql_half_up('m')} as rt_mean, {sql_half_up('d')} as rt_sd from (select subject, zone, {MEAN} as m, case when n > 1 then sqrt({sql_double('n * q - s * s')} / (n * (n - 1))) / {float(S.WHOLE)} end as d from (select subject, zone, count(u) as n, sum(u) as s, sum(u * u) as q from (select subject, zone, {sql_whole('reaction_time')} as u from zo where condition = 'city_correct' and zone is not null) group by 1, 2))")
def _(spark, d):
    return T.zone_rt_stats(v_zoned(spark, d), ["subject", "zone"]).select("subject", "zone", *rh("rt_mean", "rt_sd"))


PRE = {n: f"avg(prt) filter (condition = '{c}' and pc = 'city_correct')" for n, c in (("co", "mnt_correct"), ("ce", "mnt_incorrect"), ("oe", "city_incorrect"))}


@query("a4_pre_outcome_rt", ZONED + f", la as (select *, lag(condition) over (partition by subject, run order by trial_idx) as pc, lag(reaction_time) over (partition by subject, run order by trial_idx) as prt from zo) select subject, zone, {sql_round(PRE['co'])} as pre_co, {sql_round(PRE['ce'])} as pre_ce, {sql_round(PRE['oe'])} as pre_oe from la where zone is not null group by 1, 2")
def _(spark, d):
    return T.pre_outcome_rt(v_zoned(spark, d)).select("subject", "zone", *rg("pre_co", "pre_ce", "pre_oe"))


@query("a6_median_by", "select subject, run, condition, round(quantile_cont(vtc, 0.5), 6) as threshold from vt group by 1, 2, 3")
def _(spark, d):
    return T.median_by(v_vtc(spark, d), ["subject", "run", "condition"], "VTC").select("subject", "run", "condition", *r("threshold"))


@query("a7_percentile_by", "select subject, run, round(quantile_cont(reaction_time, 0.8), 6) as q80 from tr where condition = 'city_correct' group by 1, 2")
def _(spark, d):
    return T.median_by(v_trials(spark, d).filter("condition = 'city_correct'"), RUN, "reaction_time", 0.8, out="q80").select(*RUN, *r("q80"))


SHARE = {z: f"count(*) filter (zone = '{z}') / count(*)" for z in ("in", "out")}
PRESS = {z: f"{sql_double(f"sum(u) filter (zone = '{z}')")} / {float(S.WHOLE)} / nullif(count(u) filter (zone = '{z}'), 0)" for z in ("in", "out")}


@query("a30_zone_share", ZONED + f"select subject, condition, count(*) as n, {sql_round(SHARE['in'])} as share_in, {sql_round(SHARE['out'])} as share_out from zo where zone is not null group by 1, 2")
def _(spark, d):
    return T.zone_share(v_zoned(spark, d), ["subject", "condition"]).select("subject", "condition", "n", *rg("share_in", "share_out"))


@query("a32_zone_rt_diff", ZONED + f"select subject, {sql_half_up('d', 4)} as rt_diff_ms from (select subject, ({PRESS['in']} - {PRESS['out']}) * 1000 as d from (select subject, zone, {sql_whole('reaction_time')} as u from zo where condition = 'city_correct') group by 1)")
def _(spark, d):
    return T.zone_rt_diff(v_zoned(spark, d), ["subject"]).select("subject", *rh("rt_diff_ms", digits=4))


@query("w1_fill_linear", "select subject, run, trial_idx, round(rt_filled, 6) as rt_filled from vt")
def _(spark, d):
    return v_vtc(spark, d).select(*KEYS, *r("rt_filled"))


@query("w1b_fill_previous", "select subject, run, trial_idx, round(coalesce(px, nx), 6) as filled from rt")
def _(spark, d):
    t = v_trials(spark, d).withColumn("x", F.when(F.col("reaction_time") != 0, F.col("reaction_time")))
    return T.fill(t, "x", RUN, "trial_idx", "previous", "filled").select(*KEYS, *r("filled"))


EXTRA = ", rk as (select *, case when x is not null then count(x) over (partition by subject, run order by trial_idx) end as r1, case when x is not null then count(x) over (partition by subject, run order by trial_idx desc) end as r2 from rt), en as (select subject, run, max(trial_idx) filter (r1 = 1) as s1i, max(x) filter (r1 = 1) as s1x, max(trial_idx) filter (r1 = 2) as s2i, max(x) filter (r1 = 2) as s2x, max(trial_idx) filter (r2 = 1) as e1i, max(x) filter (r2 = 1) as e1x, max(trial_idx) filter (r2 = 2) as e2i, max(x) filter (r2 = 2) as e2x from rk group by 1, 2) "


@query("w1b_fill_extrapolate", EXTRA + "select subject, run, trial_idx, round(case when px is null then coalesce(s1x + (s1x - s2x) / (s1i - s2i) * (trial_idx - s1i), nx) when nx is null then coalesce(e1x + (e1x - e2x) / (e1i - e2i) * (trial_idx - e1i), px) when pi = ni then px else px + (nx - px) / (ni - pi) * (trial_idx - pi) end, 6) as filled from rk join en using (subject, run)")
def _(spark, d):
    t = v_trials(spark, d).withColumn("x", F.when(F.col("reaction_time") != 0, F.col("reaction_time")))
    return T.fill(t, "x", RUN, "trial_idx", "extrapolate", "filled").select(*KEYS, *r("filled"))


@query("w2_vtc", "select subject, run, trial_idx, round(vtc, 6) as vtc from vt")
def _(spark, d):
    return v_vtc(spark, d).select(*KEYS, F.round("VTC", 6).alias("vtc"))


@query("w2b_vtc_all", "select subject, run, trial_idx, round(case when stddev_pop(reaction_time) over (partition by subject, run) > 0 then abs((rt_filled - avg(reaction_time) over (partition by subject, run)) / stddev_pop(reaction_time) over (partition by subject, run)) end, 6) as vtc from fi")
def _(spark, d):
    return T.vtc(v_trials(spark, d), base="all").select(*KEYS, F.round("VTC", 6).alias("vtc"))


@query("w3_gauss_smooth", ", ke as (select k::int as k, exp(-0.5 * (k / 3.8) ** 2) / sum(exp(-0.5 * (k / 3.8) ** 2)) over () as w from range(-10, 11) t(k)), nn as (select subject, run, count(*) as n from vt group by 1, 2), fo as (select subject, run, trial_idx, n, w, ((trial_idx + k) % (2 * n) + 2 * n) % (2 * n) as m from vt join nn using (subject, run), ke) select fo.subject, fo.run, fo.trial_idx, round(sum(w * vt.vtc), 6) as vtc_smoothed from fo join vt on vt.subject = fo.subject and vt.run = fo.run and vt.trial_idx = case when m < n then m else 2 * n - 1 - m end group by 1, 2, 3")
def _(spark, d):
    return T.gauss_smooth(v_vtc(spark, d).select(*KEYS, "VTC"), "VTC", RUN, "trial_idx").select(*KEYS, F.round("VTC_smoothed", 6).alias("vtc_smoothed"))


@query("w6_zone_label", ZONED + "select subject, zone, count(*) as n from zo group by 1, 2")
def _(spark, d):
    return v_zoned(spark, d).groupBy("subject", "zone").agg(F.count("*").alias("n"))


@query("w6b_zone_closed_in", EXACT + f", th as (select subject, run, quantile_cont({sql_grid('vtc')}, 0.5) as q from vz group by 1, 2) select subject, run, case when {sql_grid('vtc')} <= q then 'in' when vtc is not null then 'out' end as zone, count(*) as n from vz join th using (subject, run) group by 1, 2, 3")
def _(spark, d):
    return T.zone_label(v_exact_vtc(spark, d), "VTC", RUN, closed="in").groupBy(*RUN, "zone").agg(F.count("*").alias("n"))


@query("w6c_zone_two_quantiles", EXACT + f", th as (select subject, quantile_cont({sql_grid('vtc')}, 0.25) as a, quantile_cont({sql_grid('vtc')}, 0.75) as b from vz group by 1) select subject, case when {sql_grid('vtc')} < a then 'in' when {sql_grid('vtc')} >= b then 'out' end as zone, count(*) as n from vz join th using (subject) group by 1, 2")
def _(spark, d):
    return T.zone_label(v_exact_vtc(spark, d), "VTC", ["subject"], q_low=0.25, q_high=0.75).groupBy("subject", "zone").agg(F.count("*").alias("n"))


@query("w6d_zone_by_rt", ", th as (select subject, quantile_cont(x, 0.5) as q from rt group by 1) select subject, case when x < q then 'in' when x is not null then 'out' end as zone, count(*) as n from rt join th using (subject) group by 1, 2")
def _(spark, d):
    t = v_trials(spark, d).withColumn("rt", F.when(F.col("reaction_time") != 0, F.col("reaction_time")))
    return T.zone_label(t, "rt", ["subject"], computed=False).groupBy("subject", "zone").agg(F.count("*").alias("n"))


PUPIL = f", sa as (select user_id as subject, row_number() over (partition by user_id order by ts, event_id) - 1 as i, (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6 as t, value as v, event_type from events), pm as (select l.subject, l.i as trial_idx, avg(s.v) as m from sa l join sa s on l.subject = s.subject and s.event_type = 'view' and s.t >= l.t - 86400 and s.t < l.t + 4 * 86400 where l.event_type in ('purchase', 'error') group by 1, 2 having count(*) >= 2), th as (select subject, quantile_cont({sql_grid('m')}, 0.5) as q from pm group by 1) "


@query("w6d_zone_by_pupil", PUPIL + f"select subject, trial_idx, {sql_round('m', 5)} as mean_v, case when {sql_grid('m')} < q then 'in' else 'out' end as zone from pm join th using (subject)")
def _(spark, d):
    # Views stand for pupil samples, a day for the half second before a trial.
    s = v_samples(spark, d)
    trials = s.filter("event_type in ('purchase', 'error')").select("subject", F.col("i").alias("trial_idx"), F.col("t").alias("onset"))
    day = 86400.0
    x = T.zone_by_window_mean(trials, s.filter("event_type = 'view'"), ["subject"], -day, 4 * day, 2, ["subject"])
    return x.select("subject", "trial_idx", *rg("mean_v", digits=5), "zone")


@query("w7_sliding_trials", ", q as (select subject, run, quantile_cont(reaction_time, 0.8) filter (condition = 'city_correct') as q80, count(*) as n from vt group by 1, 2), wi as (select vt.*, q80, unnest(range(greatest(0, ceil((trial_idx - 19) / 5)::int), least(floor(trial_idx / 5), floor((n - 20) / 5))::int + 1))::int as window_id from vt join q using (subject, run) where n >= 20) select subject, run, window_id, window_id * 5 + 9.5::double as centre, round(count(*) filter (condition = 'mnt_incorrect') / nullif(count(*) filter (trial_type = 'mnt'), 0), 6) as fa_rate, round(count(*) filter (condition = 'city_correct' and reaction_time > q80) / nullif(count(*) filter (condition = 'city_correct'), 0), 6) as slow_share, round(avg(reaction_time) filter (condition = 'city_correct'), 6) as rt_mean, round(case when count(*) filter (condition = 'city_correct') >= 2 then stddev_pop(reaction_time) filter (condition = 'city_correct') / avg(reaction_time) filter (condition = 'city_correct') end, 6) as rt_cv, round(avg(vtc), 6) as vtc_mean from wi group by 1, 2, 3")
def _(spark, d):
    x = T.sliding_trials(v_vtc(spark, d), 20, 5)
    return x.select(*RUN, "window_id", "centre", *r("fa_rate", "slow_share", "rt_mean", "rt_cv", "vtc_mean"))


@query("w8_time_on_task", "select subject, run, trial_idx, round(case when count(*) over (partition by subject, run) > 1 then trial_idx / (count(*) over (partition by subject, run) - 1) else trial_idx end, 6) as time_on_task from tr")
def _(spark, d):
    return T.time_on_task(v_trials(spark, d), RUN, "trial_idx").select(*KEYS, *r("time_on_task"))


#: Unsmoothed, and widths from 1 by 0.5 up to 99.5.
SIGMAS = [0.0, *[1 + k / 2 for k in range(198)]]


@query("a33_smoothing_sweep")
def _(spark, d):
    return T.smoothing_sweep(v_vtc(spark, d).select(*KEYS, "VTC", "condition", "reaction_time"), SIGMAS).select("sigma", "n_runs", *r("rt_diff_ms", digits=4))


@query("g22_trials_to_grid")
def _(spark, d):
    # Event times are hours apart, so a grid step stands for 100,000 s.
    t = v_vtc(spark, d).withColumn("onset", F.col("onset") / 100_000)
    return T.trials_to_grid(t, "VTC").select(*RUN, "sec", F.round("VTC_grid", 6).alias("vtc_grid"))

