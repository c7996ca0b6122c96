"""Queries of regression, tests, signals, sources and clusters, with SQL where there is one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import scalars as C
from tessera.operators import clusters
from tessera.operators import regression as R
from tessera.operators import signals as S
from tessera.operators import trials as T
from tessera.operators import windows as X
from tessera.plans.aggregate_queries import long_epochs
from tessera.plans.join_queries import vertices
from tessera.plans.views import V_EPOCHS, V_SAMPLES, V_TRIALS, V_WEIGHTED, table, v_epochs, v_samples, v_trials, v_weighted
from tessera.sources import tables as IO

Q, SQL = {}, {}
RUN = ["subject", "run"]
FS = 64.0
EP = ["subject", "trial_idx", "channel"]


def query(name, sql=None, views=V_TRIALS):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = f"with {views}{sql if sql.startswith(',') else ' ' + sql}"
        return f

    return add


def r(*cols, digits=5):
    return [F.round(F.col(c), digits).alias(c) for c in cols]


def days(spark, d):
    """Trials with time in days, so that sums of squares stay small."""
    return T.vtc(v_trials(spark, d)).withColumn("day", F.col("onset") / 86400)


DAYS = ", da as (select *, onset / 86400 as day from vt) "


@query("r1_linregress", DAYS + "select subject, round(regr_slope(vtc, day), 6) as slope, round(regr_intercept(vtc, day), 6) as intercept, round(corr(vtc, day), 6) as r, round(corr(vtc, day) ** 2, 6) as r2, count(*) as n from da where vtc is not null group by 1")
def _(spark, d):
    return R.linregress(days(spark, d), "day", "VTC", ["subject"]).select("subject", *r("slope", "intercept", "r", "r2", digits=6), "n")


@query("r1_linregress_p")
def _(spark, d):
    return R.linregress(days(spark, d), "day", "VTC", ["subject"]).select("subject", *r("p"))


@query("r2_corr_by", DAYS + ", c as (select subject, run, corr(vtc, day) as r from da group by 1, 2) select subject, round(avg(r), 6) as r, count(r) as n from c group by 1")
def _(spark, d):
    return R.corr_by(days(spark, d), "VTC", "day", RUN, ["subject"]).select("subject", *r("r", digits=6), "n")


@query("r3_polyfit_line", DAYS + "select subject, round(regr_intercept(vtc, day), 4) as b_x0, round(regr_slope(vtc, day), 5) as b_x1 from da group by 1")
def _(spark, d):
    return R.polyfit(days(spark, d), "day", "VTC", 1, ["subject"]).select("subject", *r("b_x0", digits=4), *r("b_x1"))


@query("g4_poly_detrend_line", DAYS + ", f as (select subject, regr_slope(vtc, day) as s, regr_intercept(vtc, day) as c from da group by 1) select subject, run, trial_idx, round(vtc - c - s * day, 4) as detrended from da join f using (subject)")
def _(spark, d):
    return R.poly_detrend(days(spark, d), "day", "VTC", 1, ["subject"]).select(*RUN, "trial_idx", *r("detrended", digits=4))


@query("g4_poly_detrend_cubic")
def _(spark, d):
    return R.poly_detrend(days(spark, d), "day", "VTC", 3, ["subject"]).select(*RUN, "trial_idx", *r("detrended", digits=4))




def terms(quadratic):
    t = {"const": F.lit(1.0), "day": F.col("day") / 10}
    return t | ({"day2": F.col("day") * F.col("day") / 100} if quadratic else {})


@query("r4_ols")
def _(spark, d):
    x = R.ols(days(spark, d), "VTC", terms(True), RUN, 4).groupBy("subject").agg(*[F.avg(f"b_{n}").alias(f"b_{n}") for n in terms(True)])
    return x.select("subject", *r(*[f"b_{n}" for n in terms(True)]))


@query("r5_added_variable_test")
def _(spark, d):
    x = days(spark, d)
    return R.added_variable_test(R.ols(x, "VTC", terms(False), ["subject"]), R.ols(x, "VTC", terms(True), ["subject"]), ["subject"]).select("subject", *r("f", "delta_r2", "p"), "n")


ONE = ", m as (select subject, condition, avg(vtc) as m from vt group by 1, 2) "


@query("r6_ttest_1samp", ONE + "select condition, round((avg(m) - 0.7) / (stddev_samp(m) / sqrt(count(m))), 5) as t, count(m) as n from m group by 1")
def _(spark, d):
    m = days(spark, d).groupBy("subject", "condition").agg(F.avg("VTC").alias("m"))
    return R.ttest_1samp(m, "m", ["condition"], 0.7).select("condition", *r("t"), "n")


@query("r7_ttest_rel", ", m as (select subject, condition, avg(vtc) filter (run = 1) as a, avg(vtc) filter (run = 2) as b from vt group by 1, 2), x as (select condition, a - b as d from m where a is not null and b is not null) select condition, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 5) as t, count(d) as n from x group by 1")
def _(spark, d):
    m = lambda k: days(spark, d).filter(F.col("run") == k).groupBy("subject", "condition").agg(F.avg("VTC").alias("m"))
    return R.ttest_rel(m(1), m(2), "m", "subject", ["condition"]).select("condition", *r("t"), "n")


@query("r8_ttest_ind", ", g as (select subject, count(vtc) filter (trial_type = 'mnt') as na, count(vtc) filter (trial_type = 'city') as nb, avg(vtc) filter (trial_type = 'mnt') as ma, avg(vtc) filter (trial_type = 'city') as mb, var_samp(vtc) filter (trial_type = 'mnt') as va, var_samp(vtc) filter (trial_type = 'city') as vb from vt group by 1) select subject, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 5) as t, na + nb as n from g")
def _(spark, d):
    return R.ttest_ind(days(spark, d), "VTC", "trial_type", "mnt", "city", ["subject"]).select("subject", *r("t"), "n")


CELLS = ", s as (select (vec_id // 4) % 14 as subject, unnest(range(64))::int as pos, unnest(embedding)::double as x from embeddings), m as (select subject, pos, avg(x) as m from s group by 1, 2) "


@query("r9_ttest_cells", CELLS + "select pos, round(avg(m) / (stddev_samp(m) / sqrt(count(m))), 5) as t, count(m) as n from m group by 1", V_EPOCHS)
def _(spark, d):
    m = long_epochs(spark, d).groupBy("subject", "pos").agg(F.avg("v").alias("m"))
    return X.fdr_bh(R.ttest_1samp(m, "m", ["pos"]), "p", ["n"]).select("pos", *r("t"), "n")


@query("r10_baseline_difference", ", m as (select subject, avg(vtc) filter (run = 1) - avg(vtc) filter (run = 2) as d from vt group by 1) select round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 5) as t, count(d) as n from m")
def _(spark, d):
    x = days(spark, d).groupBy("subject").agg((F.avg(F.when(F.col("run") == 1, F.col("VTC"))) - F.avg(F.when(F.col("run") == 2, F.col("VTC")))).alias("d"))
    return R.ttest_1samp(x, "d", []).select(*r("t"), "n")


def design(spark, d):
    """Trials on a clock of seconds, one every 0.8 s, and 2 Hz times; the value is the VTC or its mean."""
    t = days(spark, d).withColumn("onset", F.col("trial_idx") * 0.8).withColumnRenamed("condition", "event")
    t = R.scaled_trials(t, "VTC", RUN)
    times = t.groupBy(*RUN).agg(F.max("onset").alias("b")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("b") * 2)))).select(*RUN, "i", (F.col("i") / 2).alias("t"))
    return t, times


DESIGN = ", t as (select subject, run, condition as event, trial_idx * 0.8::double as onset, coalesce(vtc, avg(vtc) over (partition by subject, run, condition)) as value from vt), ti as (select subject, run, unnest(range(0, floor(max(onset) * 2)::bigint + 1)) / 2 as t from t group by 1, 2) "


@query("r11_hrf_design", DESIGN + "select subject, run, event, k::int as kernel, round(sum(value * exp(-((ti.t - onset + 2 - k) ** 2) / 2)), 4) as x from t join ti using (subject, run), range(1, 13) g(k) where ti.t >= onset - 2 and ti.t <= onset + 10 group by 1, 2, 3, 4")
def _(spark, d):
    t, times = design(spark, d)
    return R.hrf_design(t, times, RUN).groupBy(*RUN, "event", "kernel").agg(F.round(F.sum("x"), 4).alias("x"))


@query("r12_scaled_trials", ", f as (select *, case when trial_idx % 5 <> 0 then vtc end as f from vt) select subject, run, trial_idx, round(coalesce(f, avg(f) over (partition by subject, run, condition)), 6) as value from f")
def _(spark, d):
    t = days(spark, d).withColumnRenamed("condition", "event").withColumn("f", F.when(F.col("trial_idx") % 5 != 0, F.col("VTC")))
    return R.scaled_trials(t, "f", RUN).select(*RUN, "trial_idx", *r("value", digits=6))


@query("r13_impulse_design", "select subject, run, round(trial_idx * 0.8 * 64)::bigint as i, round(vtc - avg(vtc) over (partition by subject, run), 6) as x from vt")
def _(spark, d):
    t = days(spark, d).withColumn("onset", F.col("trial_idx") * 0.8).withColumn("value", F.col("VTC"))
    return R.impulse_design(t, RUN, FS).select(*RUN, "i", *r("x", digits=6))


@query("r14_drift_legendre", ", s as (select subject, run, trial_idx, case when max(trial_idx) over w > min(trial_idx) over w then 2 * (trial_idx - min(trial_idx) over w) / (max(trial_idx) over w - min(trial_idx) over w) - 1 else 0 end as s from tr window w as (partition by subject, run)) select subject, run, trial_idx::double as t, 1.0::double as drift0, round(s, 6) as drift1, round((3 * s * s - 1.0) / 2, 6) as drift2, round((5 * s * ((3 * s * s - 1.0) / 2) - 2 * s) / 3, 6) as drift3 from s")
def _(spark, d):
    t = v_trials(spark, d).withColumn("t", F.col("trial_idx").cast("double"))
    return R.drift_design(t, RUN, 3, "legendre").select(*RUN, "t", "drift0", *r("drift1", "drift2", "drift3", digits=6))


@query("r15_bspline_compress")
def _(spark, d):
    taps = long_epochs(spark, d).withColumnRenamed("pos", "delay").withColumnRenamed("v", "x")
    return R.bspline_compress(taps, EP, 64, 6).select(*EP, "spline", *r("x"))


@query("r16_combine_designs", "select subject, regressor, round(sum(x), 5) as x from (select subject, 'vtc' as regressor, vtc as x from vt union all select subject, 'rt', reaction_time from vt) group by 1, 2")
def _(spark, d):
    t = days(spark, d)
    part = lambda n, c: t.select("subject", F.lit(n).alias("regressor"), F.col(c).alias("x"))
    return R.combine_designs(part("vtc", "VTC"), part("rt", "reaction_time")).groupBy("subject", "regressor").agg(F.round(F.sum("x"), 5).alias("x"))


NESTED = (
    DAYS + ", na as (select subject, vtc as y, day / 10 as d, (trial_type = 'mnt')::double as s, reaction_time as e from da where vtc is not null), "
    "nb as (select subject, count(*) as n, avg(y) as my, avg(d) as md, avg(s) as ms, avg(e) as me, regr_slope(y, d) as k1, regr_slope(s, d) as k2, regr_slope(e, d) as k3 from na group by 1 having count(*) >= 8), "
    "nc as (select subject, n, y - my - k1 * (d - md) as y, s - ms - k2 * (d - md) as s, e - me - k3 * (d - md) as e, s as s0, e as e0 from na join nb using (subject)), "
    "nd as (select subject, any_value(n) as n, sum(y * y) as yy, sum(s * y) as sy, sum(e * y) as ey, sum(s * s) as ss, sum(e * e) as ee, sum(s * e) as se, sum(s0 * s0) as sz, sum(e0 * e0) as ez from nc group by 1), "
    "ne as (select *, ss * ee - se * se as det from nd where ss > 1e-6 * sz and ee > 1e-6 * ez and ss * ee - se * se > 1e-6 * ss * ee), "
    "nf as (select *, greatest(yy - sy * sy / ss, 0) as r1, greatest(yy - ey * ey / ee, 0) as r2, greatest(yy - (sy * sy * ee - 2 * sy * ey * se + ey * ey * ss) / det, 0) as r3, (ee * sy - se * ey) / det as b1, (ss * ey - se * sy) / det as b2 from ne) "
)


def nested(spark, d):
    """Time is the nuisance, rare trials the stimulus, press times the regressor scaled by trial; subjects with all four terms."""
    x = days(spark, d)
    groups = {"stim": {"mnt": (F.col("trial_type") == "mnt").cast("double")}, "scaled": {"rt": F.col("reaction_time")}}
    m = R.nested_models(x, "VTC", {"const": F.lit(1.0), "day": F.col("day") / 10}, groups, ["subject"])
    return m.filter("n >= 8 and element_at(models, -1).rank = 4")


@query("r16_nested_designs", NESTED + "select subject, design, k, round(rss, 6) as rss from (select subject, unnest(['base', 'stim', 'scaled', 'stim+scaled']) as design, unnest([2, 3, 3, 4])::int as k, unnest([yy, r1, r2, r3]) as rss from nf)")
def _(spark, d):
    return R.design_fits(nested(spark, d), ["subject"]).select("subject", "design", F.col("rank").alias("k"), *r("rss", digits=6))


@query(
    "r20_group_tests",
    NESTED + "select subject, design, tested, round(f, 4) as f, round(z, 4) as z from (select subject, unnest(['stim', 'scaled', 'stim+scaled', 'stim+scaled', 'stim+scaled']) as design, unnest(['stim', 'scaled', 'stim', 'scaled', 'stim+scaled']) as tested, "
    "unnest([(yy - r1) / (r1 / (n - 3)), (yy - r2) / (r2 / (n - 3)), (r2 - r3) / (r3 / (n - 4)), (r1 - r3) / (r3 / (n - 4)), (yy - r3) / 2 / (r3 / (n - 4))]) as f, "
    "unnest([sy / ss / sqrt(r1 / (n - 3) / ss), ey / ee / sqrt(r2 / (n - 3) / ee), b1 / sqrt(r3 / (n - 4) * ee / det), b2 / sqrt(r3 / (n - 4) * ss / det), (b1 + b2) / sqrt(r3 / (n - 4) * (ee + ss - 2 * se) / det)]) as z from nf)",
)
def _(spark, d):
    return R.group_tests(nested(spark, d), ["subject"]).select("subject", "design", "tested", *r("f", "z", digits=4))


TAPS, SPLINES = 12, 5


@query("r15_delay_response")
def _(spark, d):
    s = v_samples(spark, d).withColumn("x", (F.col("event_type") == "view").cast("double"))
    x = R.spline_taps(s, "x", ["subject"], "i", TAPS, SPLINES).withColumn("one", F.lit(1.0))
    fit = R.fit_series(x, ["subject"], "v", ["one", *[f"s{k}" for k in range(SPLINES)]], "i")
    return R.bspline_expand(fit.filter("n >= 20"), ["subject"], TAPS, SPLINES, first=1).select("subject", "delay", *r("h", "var", digits=4))


@query("p16_select_regressors", "select 'Drift ' || k as regressor, count(*) as n from tr, range(2) g(k) group by 1")
def _(spark, d):
    names = F.array(*[F.lit(x) for x in ("Drift 0", "Drift 1", "HRF city", "GS run 1")])
    x = v_trials(spark, d).select(F.explode(names).alias("regressor"))
    return C.select_regressors(x, prefix="Drift").groupBy("regressor").agg(F.count("*").alias("n"))


def _fit(method, keys=("subject",), **kw):
    def f(spark, d):
        t = days(spark, d).withColumns({"const": F.lit(1.0), "x1": F.col("day") / 10})
        return R.fit_series(t, list(keys), "VTC", ["const", "x1"], "onset", method, **kw)

    return f


@query("r17_fit_ols", DAYS + "select subject, round(regr_intercept(vtc, day / 10), 5) as b0, round(regr_slope(vtc, day / 10), 5) as b1, count(vtc) as n from da group by 1")
def _(spark, d):
    return _fit("ols")(spark, d).select("subject", F.round(F.col("beta")[0], 5).alias("b0"), F.round(F.col("beta")[1], 5).alias("b1"), "n")


@query("r18_fit_ar_irls")
def _(spark, d):
    return _fit("ar_irls", RUN, pmax=5)(spark, d).select(*RUN, F.round(F.col("beta")[1], 5).alias("b1"), F.size("ar").alias("order"), "n")


@query("r19_fit_huber")
def _(spark, d):
    return _fit("robust", norm="huber")(spark, d).select("subject", F.round(F.col("beta")[0], 5).alias("b0"), F.round(F.col("beta")[1], 5).alias("b1"))


@query("r20_contrast")
def _(spark, d):
    return R.contrast(_fit("ols")(spark, d), [1]).select("subject", *r("f", "p", "z"))


BASIS = ", ba as (select k as kernel, t, exp(-((t + 2 - k) ** 2) / 2)::double as b from range(1, 5) g(k), (select unnest(range(-4, 9)) / 2 as t)), be as (select subject, k as kernel, avg(vtc) filter (trial_idx % 4 = k - 1) as beta from vt, range(1, 5) g(k) group by 1, 2) "


def basis(spark):
    """Four kernels at 13 times; fixed by the design, not by the data."""
    b = spark.range(-4, 9).select((F.col("id") / 2).alias("t")).withColumn("kernel", F.explode(F.sequence(F.lit(1), F.lit(4))))
    u = F.col("t") + 2 - F.col("kernel")
    return b.withColumn("b", F.exp(-u * u / 2))


def betas(spark, d):
    return days(spark, d).groupBy("subject", (F.col("trial_idx") % 4 + 1).cast("int").alias("kernel")).agg(F.avg("VTC").alias("beta"))


@query("r21_hrf_from_beta", BASIS + ", h as (select subject, t, sum(beta * b) as h from be join ba using (kernel) group by 1, 2) select subject, t, round(h - avg(h) filter (t < 0) over (partition by subject), 5) as h from h")
def _(spark, d):
    return R.hrf_from_beta(betas(spark, d), basis(spark), ["subject"]).select("subject", "t", *r("h"))


@query("r22_hrf_variance", BASIS + ", co as (select a.subject, a.kernel as k1, b.kernel as k2, a.beta * b.beta as c from be a join be b using (subject)) select subject, x.t, round(sum(x.b * c * y.b), 4) as var from co join ba x on x.kernel = k1 join ba y on y.kernel = k2 and y.t = x.t group by 1, 2")
def _(spark, d):
    b = betas(spark, d)
    cov = b.withColumnRenamed("kernel", "k1").join(b.select("subject", F.col("kernel").alias("k2"), F.col("beta").alias("b2")), "subject").select("subject", "k1", "k2", (F.col("beta") * F.col("b2")).alias("c"))
    return R.hrf_variance(cov, basis(spark), ["subject"]).select("subject", "t", *r("var", digits=4))


@query("r22_reweighted_variance", BASIS + ", co as (select a.subject, a.kernel as k1, b.kernel as k2, a.beta * b.beta as c from be a join be b using (subject)), vr as (select subject, var_pop(vtc) as v from vt group by 1), pri as (select avg(v) as p from vr), ha as (select subject, x.t, sum(x.b * c * y.b) as h from co join ba x on x.kernel = k1 join ba y on y.kernel = k2 and y.t = x.t group by 1, 2) select subject, t, round(h * (v + p) / v, 4) as var from ha join vr using (subject), pri where v > 0")
def _(spark, d):
    # The prior is the mean over subjects of their residual variance.
    b = betas(spark, d)
    cov = b.withColumnRenamed("kernel", "k1").join(b.select("subject", F.col("kernel").alias("k2"), F.col("beta").alias("b2")), "subject").select("subject", "k1", "k2", (F.col("beta") * F.col("b2")).alias("c"))
    resid = days(spark, d).groupBy("subject").agg(F.var_pop("VTC").alias("v"))
    prior = resid.agg(F.avg("v").alias("p"))
    x = R.hrf_variance(cov, basis(spark), ["subject"]).join(resid.filter("v > 0"), "subject").join(F.broadcast(prior))  # one row
    return x.select("subject", "t", F.round(R.reweighted_variance(F.col("var"), F.col("v"), F.col("p")), 4).alias("var"))


FITTED = DAYS + ", f as (select subject, regr_slope(vtc, day) as s, regr_intercept(vtc, day) as c from da group by 1), y as (select subject, run, trial_idx, vtc as y, c + s * day as h from da join f using (subject)) "


def fitted(spark, d):
    x = days(spark, d)
    des = x.select("subject", "run", "trial_idx", F.explode(F.array(F.struct(F.lit("const").alias("regressor"), F.lit(1.0).alias("x")), F.struct(F.lit("day").alias("regressor"), F.col("day").alias("x")))).alias("s")).select("subject", "run", "trial_idx", "s.*")
    b = R.linregress(x, "day", "VTC", ["subject"])
    b = b.select("subject", F.explode(F.array(F.struct(F.lit("const").alias("regressor"), F.col("intercept").alias("beta")), F.struct(F.lit("day").alias("regressor"), F.col("slope").alias("beta")))).alias("s")).select("subject", "s.*")
    p = R.predict(des, b, ["subject"], ["run", "trial_idx"])
    return p.join(x.select("subject", "run", "trial_idx", F.col("VTC").alias("y")), ["subject", "run", "trial_idx"])


@query("r23_model_scores", FITTED + "select subject, round(avg((y - h) ** 2), 6) as mse, round(1 - sum((y - h) ** 2) / (var_pop(y) * count(y)), 6) as ev from y where y is not null group by 1")
def _(spark, d):
    return R.model_scores(fitted(spark, d), ["subject"]).select("subject", *r("mse", "ev", digits=6))


@query("r24_prediction_correlation", FITTED + "select subject, round(corr(y, h), 5) as r, round(atanh(corr(y, h)), 5) as z from y group by 1")
def _(spark, d):
    return R.model_scores(fitted(spark, d), ["subject"]).select("subject", *r("r"), F.round(C.fisher_z(F.col("r")), 5).alias("z"))


@query("r25_significant_share")
def _(spark, d):
    c = R.contrast(_fit("ols")(spark, d), [1]).withColumn("family", F.lit(1))
    return X.fdr_bh(c, "p", ["family"]).groupBy("family").agg(F.avg(F.col("reject").cast("int")).alias("ratio"), F.count("*").alias("n"))


@query("r26_robust_group_t")
def _(spark, d):
    # A fit per run; runs are averaged within the subject.
    f = _fit("ar_irls", RUN, pmax=3)(spark, d).groupBy("subject").agg(F.avg(F.col("beta")[1]).alias("b"))
    return R.ttest_1samp(f, "b", []).select(*r("mean", "t", "p"), "n")


@query("r27_ar_loglik")
def _(spark, d):
    x = fitted(spark, d).withColumn("e", F.col("y") - F.col("y_hat")).withColumn("o", F.col("run") * 100000 + F.col("trial_idx"))
    return R.ar_loglik(x, ["subject"], "e", "o").select("subject", "p", *r("loglik"))


@query("r28_whiteness", ", c as (select subject, trial_idx, run, vtc as e, vtc - avg(vtc) over (partition by subject, run) as c from vt where vtc is not null), l as (select *, lag(c) over w as lc, lag(e) over w as le from c window w as (partition by subject, run order by trial_idx)) select subject, run, round(sum(c * lc) / sum(c * c), 5) as acf1, round(sum((e - le) ** 2) / sum(e * e), 5) as dw, abs(sum(c * lc) / sum(c * c)) > 1.96 / sqrt(count(e)) as correlated from l group by 1, 2")
def _(spark, d):
    return R.whiteness(days(spark, d).filter("VTC is not null"), RUN, "VTC", "trial_idx").select(*RUN, *r("acf1", "dw"), "correlated")


@query("r29_residualize", FITTED + "select subject, run, trial_idx, round(y - h, 4) as resid from y")
def _(spark, d):
    return R.residualize(days(spark, d), "VTC", {"const": F.lit(1.0), "day": F.col("day")}, ["subject"]).select(*RUN, "trial_idx", *r("resid", digits=4))


@query("r30_trial_hrf", BASIS + "select vt.subject, vt.run, vt.trial_idx, ba.t, round(sum(be.beta * b * (1 + vt.vtc)), 4) as h from vt join be using (subject) join ba using (kernel) group by 1, 2, 3, 4")
def _(spark, d):
    t = days(spark, d).select("subject", "run", "trial_idx", "VTC")
    x = R.trial_responses(t, betas(spark, d), basis(spark), ["subject"], 1 + F.col("VTC"))
    return x.select(*RUN, "trial_idx", "t", *r("h", digits=4))


@query("r31_prewhitened_xcorr")
def _(spark, d):
    return R.prewhitened_xcorr(days(spark, d).filter("VTC is not null"), RUN, "VTC", "reaction_time", "trial_idx", 3).select(*RUN, "lag", *r("r"))


def series(spark, d):
    """One packed series per subject from its samples, made regular by index."""
    return S.pack(v_samples(spark, d), ["subject"])


@query("w4_filtfilt_fir")
def _(spark, d):
    return S.filtfilt_fir(v_samples(spark, d), ["subject"]).select("subject", "i", *r("v"))


@query("w21_find_peaks")
def _(spark, d):
    return S.find_peaks(series(spark, d), 3).select("subject", F.explode("peaks").alias("i"))


@query("g8_epoch_spectrum", ", dft as (select trial_idx, channel, f, sum(x * cos(2 * pi() * f * i / 64)) as re, sum(x * sin(2 * pi() * f * i / 64)) as im from (select trial_idx, channel, unnest(range(64)) as i, unnest(v) as x from ep), range(0, 33) g(f) group by 1, 2, 3) select trial_idx, channel, f::int as f, round(log10(re * re + im * im + 1e-30), 4) as power from dft", V_EPOCHS)
def _(spark, d):
    x = S.epoch_spectrum(v_epochs(spark, d)).select("trial_idx", "channel", F.posexplode("v").alias("f", "p"))
    return x.select("trial_idx", "channel", "f", F.round("p", 4).alias("power"))


@query("g9_hann_psd")
def _(spark, d):
    x = S.hann_psd(v_epochs(spark, d), FS).select("trial_idx", F.posexplode("v").alias("f", "p"))
    return x.groupBy("trial_idx", "f").agg(F.round(F.avg("p"), 8).alias("p"))


@query("g10_band_power")
def _(spark, d):
    return S.band_power(v_epochs(spark, d), FS, {"theta": (4, 8), "alpha": (8, 12)}, nperseg=64).select(*EP, *r("theta", "alpha", digits=8))


@query("g11_band_logvar")
def _(spark, d):
    return S.band_logvar(v_epochs(spark, d), FS, 8.0, 12.0).select(*EP, *r("logvar"))


@query("g12_multitaper_power")
def _(spark, d):
    x = S.multitaper_power(v_epochs(spark, d), ["subject"], FS, 32, 16)
    return x.select("subject", "window", "f", F.round(F.log10("v"), 5).alias("log_power"))


@query("g12_power_over_baseline")
def _(spark, d):
    x = S.ratio_to_baseline(S.multitaper_power(v_epochs(spark, d), ["subject"], FS, 32, 16), ["subject"], -0.2, FS, 16)
    return x.select("subject", "window", "f", F.round("v", 5).alias("log_ratio"))


@query("g12_power_over_condition")
def _(spark, d):
    p = S.multitaper_power(v_epochs(spark, d), ["event"], FS, 32, 16)
    x = S.power_ratio(p, p.filter("event = 0").drop("event"), ["window", "f"])
    return x.select("event", "window", "f", F.round("v", 5).alias("log_ratio"))


@query("g13_alpha_power")
def _(spark, d):
    return S.alpha_power(v_epochs(spark, d), FS).withColumn("scaled", C.scale_by_max("alpha", ["subject"])).select(*EP, *r("scaled"))


@query("g14_band_power_at")
def _(spark, d):
    e = v_epochs(spark, d)
    at = e.select("subject", "trial_idx").distinct().withColumn("sample", F.explode(F.expr("sequence(8L, 56L, 16L)")))
    return S.band_power_at(e, at, ["subject", "trial_idx"], FS, (8.0, 12.0), 8).select("subject", "trial_idx", "channel", "sample", *r("power", digits=8))


@query("g15_butter_filtfilt")
def _(spark, d):
    return S.butter_filtfilt(v_epochs(spark, d), FS, 1.0, 20.0).select(*EP, F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b), 6).alias("energy"))


@query("g16_envelope")
def _(spark, d):
    return S.envelope(v_epochs(spark, d), ["subject", "trial_idx"], FS, (8.0, 12.0)).select("subject", "trial_idx", "pos", *r("v"))


@query("g17_sampling_rate", ", g as (select subject, t - lag(t) over (partition by subject order by t) as d from sa) select subject, round(1 / quantile_cont(d, 0.5), 10) as rate from g group by 1", V_SAMPLES)
def _(spark, d):
    return S.sampling_rate(v_samples(spark, d), ["subject"]).select("subject", *r("rate", digits=10))


@query("g17_resample_linear")
def _(spark, d):
    return S.resample_linear(v_samples(spark, d), ["subject"], 1 / 43200.0).select("subject", "i", *r("v"))


@query("g18_resample_fft")
def _(spark, d):
    return S.resample_fft(v_epochs(spark, d), 32).select(*EP, F.posexplode("v").alias("i", "v")).select(*EP, "i", *r("v"))


@query("g18_truncate_common", ", s as (select subject, trial_idx, channel, case when channel = 0 then v[:64 - (trial_idx % 5)::int] else v end as v from ep), c as (select *, min(len(v)) over (partition by trial_idx) as n from s) select subject, trial_idx, channel, n::int as n, round(list_sum(v[:n]), 4) as total from c", V_EPOCHS)
def _(spark, d):
    # A channel that ends early cuts the others of its trial.
    e = v_epochs(spark, d).withColumn("v", F.when(F.col("channel") == 0, F.slice("v", F.lit(1), (64 - F.col("trial_idx") % 5).cast("int"))).otherwise(F.col("v")))
    x = S.truncate_common(e, ["trial_idx"])
    return x.select(*EP, F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query("g19_pupil_pipeline")
def _(spark, d):
    s = v_samples(spark, d).withColumn("t", F.col("i") / 4)
    blinks = s.filter("event_type = 'error'").select("subject", (F.col("t") - 0.1).alias("t_start"), (F.col("t") + 0.1).alias("t_stop"))
    return S.pupil_pipeline(s, blinks, ["subject"], 2.0, cutoff=1.0).select("subject", F.posexplode("v").alias("i", "v")).select("subject", "i", *r("v"))


XC = ", z as (select subject, i, (v - avg(v) over w) / nullif(stddev_pop(v) over w, 0) as z, count(*) over w as n from sa window w as (partition by subject)), j as (select a.subject, (b.i - a.i)::int as lag, any_value(a.n) as n, sum(a.z * b.z) as s from z a join z b on a.subject = b.subject and b.i - a.i between -3 and 3 group by 1, 2) "


@query("g20_xcorr", XC + "select subject, lag, round(s / n, 5) as r from j", V_SAMPLES)
def _(spark, d):
    s = v_samples(spark, d)
    return S.xcorr(s, s, ["subject"], 3).select("subject", "lag", *r("r"))


@query("g21_xcorr_overlap", XC + "select lag, round(avg(s / (n - abs(lag))), 5) as r from j group by 1", V_SAMPLES)
def _(spark, d):
    s = v_samples(spark, d)
    return S.xcorr(s, s, ["subject"], 3, "overlap").groupBy("lag").agg(F.round(F.avg("r"), 5).alias("r"))


@query("g23_coherence")
def _(spark, d):
    x = S.cross_spectra(v_epochs(spark, d).filter("channel < 2"), ["subject", "trial_idx"], FS, 16)
    y = S.cross_spectra(v_epochs(spark, d).filter("channel >= 2"), ["subject", "trial_idx"], FS, 16)
    c = S.coherence(x, y, ["subject", "trial_idx"])
    return X.moving_avg(c, "coherence", ["subject", "trial_idx", "channel"], ["f"], 3, out="smooth").select("subject", "trial_idx", "channel", "f", *r("coherence", "smooth"))


@query("g24_source_spectrum")
def _(spark, d):
    return S.source_spectrum(v_epochs(spark, d), "event", FS, 32).select("event", "pos", *r("v", digits=8))


#: Thirty frequencies from 2 to 24 Hz.
MORLET = [float(f) for f in np.geomspace(2, 24, 30)]


@query("g25_morlet_power")
def _(spark, d):
    p = S.morlet_power(v_epochs(spark, d), ["event"], FS, MORLET)
    return p.select("event", F.round("freq", 6).alias("freq"), "pos", F.round(10 * F.log10("v"), 5).alias("db"))


@query("g25_morlet_in_out")
def _(spark, d):
    # The criterion of an epoch is its mean; epochs below their subject's median are in the zone.
    e = v_epochs(spark, d).withColumn("crit", F.aggregate("v", F.lit(0.0), lambda s, x: s + x))
    z = T.zone_label(e, "crit", ["subject"])
    p = S.morlet_power(z, ["event", "zone"], FS, MORLET)
    low, high = (p.filter(F.col("zone") == k).select("event", "freq", "pos", F.col("v").alias(k)) for k in ("in", "out"))
    return low.join(high, ["event", "freq", "pos"]).select("event", F.round("freq", 6).alias("freq"), "pos", F.round(C.db_ratio(F.col("in"), F.col("out")), 5).alias("db"))


@query("g26_pc_scores")
def _(spark, d):
    s = long_epochs(spark, d).withColumnRenamed("pos", "i")
    return S.pc_scores(s, ["subject", "trial_idx"]).select("subject", "trial_idx", "i", *r("score", "ratio"), "n90")


@query("g28_vtc_spectrum")
def _(spark, d):
    v = S.pack(days(spark, d).filter("VTC is not null"), RUN, "trial_idx", "VTC").filter(F.size("v") >= 16)
    x = S.source_spectrum(v.withColumn("channel", F.col("run")), "subject", 1 / 0.8, 16)
    return x.groupBy("pos").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v") / F.sqrt(F.count("v")), 6).alias("sem"))


@query("g29_trace_on_grid")
def _(spark, d):
    t = T.time_on_task(days(spark, d), RUN, "trial_idx")
    g = S.trace_on_grid(t.filter("VTC is not null"), RUN, "time_on_task", "VTC", 21)
    return g.groupBy("subject", "g").agg(F.avg("v").alias("v")).groupBy("g").agg(F.round(F.avg("v"), 5).alias("v"))


def paths(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    k = F.col("page_id")
    return p.select(k, F.concat(F.lit("/data/sub-"), k % 14, F.lit("_task-watch_run-0"), k % 3 + 1, F.lit("_v"), k % 4, F.when(k % 2 == 0, "_clean.tsv").otherwise("_raw.tsv")).alias("path"))


PATHS = "pa as (select page_id, '/data/sub-' || (page_id % 14) || '_task-watch_run-0' || (page_id % 3 + 1) || '_v' || (page_id % 4) || case when page_id % 2 = 0 then '_clean.tsv' else '_raw.tsv' end as path from pages) "


@query("s4_pick_latest", "select subject, run, arg_min(path, k || path) as path from (select path, regexp_extract(path, 'sub-([^_/]+)', 1) as subject, regexp_extract(path, 'run-0*(\\d+)', 1)::int as run, case when path like '%v3_raw.tsv' then '0' when path like '%clean.tsv' then '1' end as k from pa) where k is not null group by 1, 2", PATHS)
def _(spark, d):
    x = IO.catalog(paths(spark, d))
    return IO.pick_latest(x, ["v3_raw.tsv", "clean.tsv"], RUN, F.col("path")).select("subject", "run", "path")


@query("s5_catalog", "select distinct path, regexp_extract(path, 'sub-([^_/]+)', 1) as subject, regexp_extract(path, 'task-([^_/]+)', 1) as task, regexp_extract(path, 'run-0*(\\d+)', 1)::int as run from pa", PATHS)
def _(spark, d):
    return IO.catalog(paths(spark, d))


@query("p15_parcel_network", "select case when network = 'Brand#1' then 'Visual' else network end as network, count(*) as n from (select split_part(replace(p_brand, '#', '#') || '_' || p_size, '_', 1)[1:7] as network from part) group by 1", V_WEIGHTED)
def _(spark, d):
    label = F.concat(F.substring("p_brand", 1, 7), F.lit("_"), F.col("p_size"))
    x = table(spark, d, "part").filter(C.is_brain_parcel(label))
    return x.select(C.parcel_network(label, {"Brand#1": "Visual"}).alias("network")).groupBy("network").agg(F.count("*").alias("n"))


@query("p18_mask_channels", "select parcel, count(case when parcel % 7 <> 0 then x end) as n from we group by 1", V_WEIGHTED)
def _(spark, d):
    w = v_weighted(spark, d)
    return C.mask_channels(w, w.filter("parcel % 7 = 0"), ["parcel"], "x").groupBy("parcel").agg(F.count("x").alias("n"))


@query("c1_cluster_series")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("vertex"), F.col("embedding").cast("array<double>").alias("v"))
    return clusters.cluster_series(vertices(spark, d), v, 8.0, 0.3, 2)


ROI = ", ro as (select label as roi, pos as t, avg(x) as v from (select label, unnest(range(64))::int as pos, unnest(embedding)::double as x from embeddings) group by 1, 2) "


def rois(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("roi"), F.posexplode(F.col("embedding").cast("array<double>")).alias("t", "v")).groupBy("roi", "t").agg(F.avg("v").alias("v"))


@query("c2_roi_correlations", ROI + "select x.roi as a, y.roi as b, round(corr(x.v, y.v), 5) as r from ro x join ro y on x.t = y.t and x.roi < y.roi group by 1, 2", V_EPOCHS)
def _(spark, d):
    return clusters.roi_correlations(rois(spark, d)).select("a", "b", *r("r"))


@query("c2_correlation_groups")
def _(spark, d):
    return clusters.correlation_groups(rois(spark, d), 0.2)


