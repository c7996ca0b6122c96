"""Queries of aggregates, epochs and set operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import epochs as G
from tessera.operators import trials as T
from tessera.plans.views import V_EPOCHS, V_TRIALS, V_WEIGHTED, table, v_epochs, v_trials, v_weighted
from tessera.plans.trial_queries import v_zoned

Q, SQL = {}, {}


def query(name, sql=None, views=V_EPOCHS):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = f"with {views}{sql if sql.startswith(',') else ' ' + sql}"
        return f

    return add


def r(*cols, digits=5):
    return [F.round(F.col(c), digits).alias(c) for c in cols]


LONG = ", lo as (select *, unnest(range(64))::int as pos, unnest(v) as x from ep) "
FS, T0 = 64.0, -0.2


@query("a5_signal_detection")
def _(spark, d):
    return A.sdt(T.zone_confusion(v_zoned(spark, d), ["subject", "zone"])).select("subject", "zone", *r("d_prime", "criterion"))


SUM = ", p as (select subject, condition, avg(vtc) as m from vt group by 1, 2) "


@query("a8_group_summary", SUM + "select condition, round(avg(m), 5) as mean, round(stddev_pop(m) / sqrt(count(m)), 5) as sem, count(m) as n from p group by 1", V_TRIALS)
def _(spark, d):
    return A.group_summary(T.vtc(v_trials(spark, d)), "VTC", ["subject"], ["condition"]).select("condition", *r("mean", "sem"), "n")


@query("a9_mean_ci")
def _(spark, d):
    s = A.group_summary(T.vtc(v_trials(spark, d)), "VTC", ["subject"], ["condition"], ddof=1)
    return A.mean_ci(s).select("condition", *r("mean", "ci_low", "ci_high"), "n")


@query("a10_erp", LONG + "select subject, event, channel, pos, round(avg(x), 5) as v from lo group by 1, 2, 3, 4")
def _(spark, d):
    return A.erp(v_epochs(spark, d), ["subject", "event", "channel"]).select("subject", "event", "channel", "pos", *r("v"))


@query("a10_grand_mean", LONG + ", w as (select subject, event, channel, pos, avg(x) as v from lo group by 1, 2, 3, 4) select event, channel, pos, round(avg(v), 5) as mean, round(avg(v) - 2 * stddev_samp(v) / sqrt(count(v)), 5) as low, round(avg(v) + 2 * stddev_samp(v) / sqrt(count(v)), 5) as high, count(v) as n from w group by 1, 2, 3")
def _(spark, d):
    w = A.erp(v_epochs(spark, d), ["subject", "event", "channel"])
    return A.grand_mean(w, ["event", "channel"]).select("event", "channel", "pos", *r("mean", "low", "high"), "n")


@query("a11_zone_erp", LONG + "select subject, case when v[1] < 0 then 'in' else 'out' end as zone, pos, round(avg(x), 5) as v from lo where subject in (select subject from ep group by 1 having count(distinct v[1] < 0) = 2) group by 1, 2, 3")
def _(spark, d):
    e = v_epochs(spark, d).withColumn("zone", F.when(F.col("v")[0] < 0, "in").otherwise("out"))
    return A.zone_erp(e, []).select("subject", "zone", "pos", *r("v"))


@query("a12_condition_diff", "select subject, round(avg(vtc) filter (condition = 'city_correct') - avg(vtc) filter (condition = 'mnt_correct'), 5) as diff from vt group by 1 having diff is not null", V_TRIALS)
def _(spark, d):
    return A.condition_diff(T.vtc(v_trials(spark, d)), "VTC", "condition", "city_correct", "mnt_correct", ["subject"]).select("subject", *r("diff"))


WIN = ", m as (select subject, event, trial_idx, channel, list_avg(v[1:13]) as amp from ep) "


@query("a13_epoch_window_mean", WIN + "select subject, event, round(avg(amp), 5) as amp from m group by 1, 2")
def _(spark, d):
    return A.epoch_window_mean(v_epochs(spark, d), FS, T0, -0.3, 0.0).groupBy("subject", "event").agg(F.round(F.avg("amp"), 5).alias("amp"))


@query("a14_epoch_window_mean_pooled", WIN + "select subject, round(avg(amp), 5) as amp, round(quantile_cont(amp, 0.5), 5) as median from m group by 1")
def _(spark, d):
    x = A.epoch_window_mean(v_epochs(spark, d), FS, T0, -0.3, 0.0)
    return x.groupBy("subject").agg(F.round(F.avg("amp"), 5).alias("amp"), F.round(F.percentile("amp", 0.5), 5).alias("median"))


CH = ", s as (select subject, trial_idx, channel, list_var_pop(v) as var, list_max(v) - list_min(v) as ptp from ep) "


def long_epochs(spark, d):
    return v_epochs(spark, d).select("subject", "trial_idx", "channel", F.posexplode("v").alias("pos", "v"))


@query("a15_bad_by_variance", CH + ", z as (select *, (var - avg(var) over (partition by subject)) / stddev_pop(var) over (partition by subject) as z from s) select subject, trial_idx, channel, round(z, 5) as z from z where z > 1.5")
def _(spark, d):
    s = A.channel_stats(long_epochs(spark, d), ["subject", "trial_idx", "channel"])
    return A.bad_by_variance(s, ["subject"], 1.5).select("subject", "trial_idx", "channel", *r("z"))


@query("a16_bad_by_amplitude", CH + "select subject, trial_idx, channel, round(ptp, 5) as ptp from s where ptp > 0.6")
def _(spark, d):
    s = A.channel_stats(long_epochs(spark, d), ["subject", "trial_idx", "channel"])
    return A.bad_by_amplitude(s, 0.6).select("subject", "trial_idx", "channel", *r("ptp"))


REJ = CH + ", j as (select subject, trial_idx, any_value(0) as run, bool_or(ptp > 0.62) as rejected from s group by 1, 2) "


def rejected(spark, d):
    return A.reject_ptp(v_epochs(spark, d), 0.62, ["subject", "trial_idx"])


@query("a17_reject_ptp", REJ + "select subject, trial_idx, rejected from j")
def _(spark, d):
    return rejected(spark, d)


@query("a18_reject_std_var", ", s as (select subject, trial_idx, list_stddev_samp(v) as sd, list_var_samp(v) as var from ep) select subject, trial_idx, avg(sd) >= 0.13 or avg(var) >= 0.017 as rejected from s group by 1, 2")
def _(spark, d):
    return A.reject_std_var(v_epochs(spark, d), ["subject", "trial_idx"], 0.13, 0.017)


@query("a19_trial_yield", REJ + "select subject, count(*) filter (not rejected) as kept, count(*) as total, round(100 * count(*) filter (rejected) / count(*), 5) as pct_rejected, coalesce(string_agg(trial_idx, ',' order by trial_idx) filter (rejected), '') as rejected_trials from j group by 1")
def _(spark, d):
    x = A.trial_yield(rejected(spark, d), ["subject"])
    return x.select("subject", "kept", "total", *r("pct_rejected"), F.array_join(F.col("rejected_trials").cast("array<string>"), ",").alias("rejected_trials"))


@query("a20_enough_trials", REJ + "select subject, trial_idx from j where subject in (select subject from j where not rejected group by 1 having count(*) >= 5)")
def _(spark, d):
    return A.enough_trials(rejected(spark, d), 5).select("subject", "trial_idx")


@query("a21_bad_channels", ", f as (select parcel, run as wavelength, avg(m) as m from we group by 1, 2) select parcel from f group by 1 having min(m) < 8 union select parcel from we where x < 1500", V_WEIGHTED)
def _(spark, d):
    w = v_weighted(spark, d)
    amp = w.select("parcel", F.col("run").alias("wavelength"), F.col("m").alias("v"))
    return A.bad_channels(amp, w.select("parcel", F.when(F.col("x") < 1500, 0).otherwise(1).alias("flag")), 8.0, ["parcel"])


@query("a22_short_regressor", LONG + "select subject, trial_idx, pos, round(avg(x), 5) as short from lo where channel * 8 < 20 group by 1, 2, 3")
def _(spark, d):
    dist = table(spark, d, "embeddings").select((F.col("vec_id") % 4).alias("channel")).distinct().withColumn("mm", F.col("channel") * 8.0)
    return A.short_regressor(long_epochs(spark, d), dist, ["subject", "trial_idx", "pos"]).select("subject", "trial_idx", "pos", *r("short"))


@query("a23_global_mean", LONG + "select subject, trial_idx, pos, round(sum(x * (channel + 1)) / sum(channel + 1), 5) as gm from lo group by 1, 2, 3")
def _(spark, d):
    x = long_epochs(spark, d).withColumn("w", F.col("channel") + 1.0)
    return A.global_mean(x, ["subject", "trial_idx", "pos"], "w").select("subject", "trial_idx", "pos", *r("gm"))


@query("a24_ivw_mean", "select network, round(sum(x / m) / sum(1 / m), 4) as ivw, round(1 / sum(1 / m), 9) as ivw_var from we group by 1", V_WEIGHTED)
def _(spark, d):
    return A.ivw_mean(v_weighted(spark, d), ["network"]).select("network", *r("ivw", digits=4), *r("ivw_var", digits=9))


@query("a25_parcel_variance", ", p as (select parcel, run, sum(m) / count(*) / count(*) as v from we group by 1, 2) select parcel, round(sum(v) / count(*) / count(*), 6) as var from p group by 1", V_WEIGHTED)
def _(spark, d):
    return A.parcel_variance(v_weighted(spark, d)).select("parcel", *r("var", digits=6))


@query("a26_weighted_stats", ", s as (select network, sum(m) as sw, sum(m * m) as sww, sum(m * x) / sum(m) as mu, sum(m * x * x) / sum(m) as q from we group by 1) select network, round(mu, 3) as w_mean, round(q - mu * mu, 1) as w_var, round(sqrt((q - mu * mu) * sww / (sw * sw)), 3) as w_se from s", V_WEIGHTED)
def _(spark, d):
    return A.weighted_stats(v_weighted(spark, d), ["network"], "x", "m").select("network", *r("w_mean", digits=3), *r("w_var", digits=1), *r("w_se", digits=3))


@query("a27_overlap_table", ", c as (select subject, network, count(*) as n from we group by 1, 2), f as (select *, n / sum(n) over (partition by subject) as fraction from c) select subject, network, n, round(fraction, 6) as fraction from f where fraction >= 0.04", V_WEIGHTED)
def _(spark, d):
    return A.overlap_table(v_weighted(spark, d), "subject", "network", 0.04).select("subject", "network", "n", *r("fraction", digits=6))


@query("a27_overlap_pivot", "select subject, count(*) filter (run = 1) as r1, count(*) filter (run = 2) as r2, count(*) filter (run = 3) as r3, count(*) filter (run = 4) as r4, count(*) filter (run = 5) as r5, count(*) filter (run = 6) as r6, count(*) filter (run = 7) as r7 from we group by 1", V_WEIGHTED)
def _(spark, d):
    x = A.overlap_table(v_weighted(spark, d), "subject", "run").groupBy("subject").pivot("run", list(range(1, 8))).agg(F.sum("n"))
    return x.select("subject", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"r{k}") for k in range(1, 8)])


@query("a28_effect_summary", "select network, count(distinct subject) as n_subjects, round(avg(x), 3) as mean, count(*) filter (m / 100 < 0.05) as n_sig, round(100 * count(*) filter (m / 100 < 0.05) / count(*), 5) as pct_sig from we group by 1", V_WEIGHTED)
def _(spark, d):
    x = A.effect_summary(v_weighted(spark, d).withColumn("p", F.col("m") / 100), ["network"], "x")
    return x.select("network", "n_subjects", *r("mean", digits=3), "n_sig", *r("pct_sig"))


def modalities(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("subject")).distinct()
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("subject")).distinct()
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("subject")).distinct()
    return docs, labels, cust


@query("a29_availability", "select has_label, has_order, count(*) as n from (select d.doc_id, l.doc_id is not null as has_label, c.c_custkey is not null as has_order from (select distinct doc_id from documents) d left join (select distinct doc_id from labels) l using (doc_id) left join (select distinct c_custkey from customer) c on c.c_custkey = d.doc_id) group by cube (has_label, has_order)")
def _(spark, d):
    docs, labels, cust = modalities(spark, d)
    x = docs.join(labels.withColumn("a", F.lit(True)), "subject", "left").join(cust.withColumn("b", F.lit(True)), "subject", "left")
    return A.availability(x.select(F.col("a").isNotNull().alias("has_label"), F.col("b").isNotNull().alias("has_order")), ["has_label", "has_order"])


@query("a31_sig_ratio", "select subject, round(avg((m / 100 < 0.05)::int), 6) as ratio from we where parcel % 10 <> 0 group by 1", V_WEIGHTED)
def _(spark, d):
    x = v_weighted(spark, d).withColumns({"p": F.col("m") / 100, "channel": F.col("parcel")})
    return A.sig_ratio(x, x.filter("parcel % 10 = 0").select("subject", "channel").distinct()).select("subject", *r("ratio", digits=6))


@query("s8_exclusions", "select subject, arg_min(reason, k) as reason from (select distinct doc_id as subject, 'toxic' as reason, 0 as k from labels where toxic = 1 union all select distinct doc_id, 'low quality', 1 from labels where quality = 0) group by 1")
def _(spark, d):
    lab = table(spark, d, "labels").withColumnRenamed("doc_id", "subject")
    return A.exclusions(lab.filter("toxic = 1").select("subject", F.lit("toxic").alias("reason")), lab.filter("quality = 0").select("subject", F.lit("low quality").alias("reason")))


@query("t1_raster", ", o as (select subject, run, trial_idx, reaction_time as x, row_number() over (partition by subject order by reaction_time, run * 100000 + trial_idx) - 1 as row from tr) select subject, run, trial_idx, row, round((sum(x) over m + greatest(0, 2 - row) * first_value(x) over f + greatest(0, row + 1 - (count(*) over f - 1)) * last_value(x) over f) / 4, 5) as smoothed from o window m as (partition by subject order by row rows between 2 preceding and 1 following), f as (partition by subject order by row rows between unbounded preceding and unbounded following)", V_TRIALS)
def _(spark, d):
    t = v_trials(spark, d).withColumn("tie", F.col("run") * 100000 + F.col("trial_idx"))
    return A.raster(t, "reaction_time", "tie", ["subject"], 4).select("subject", "run", "trial_idx", F.col("row").cast("long").alias("row"), *r("smoothed"))


@query("t2_top_channel", CH + ", q as (select subject, quantile_cont(ptp, [0.05, 0.95]) as q from s group by 1) select subject, arg_max(trial_idx * 4 + channel, ptp) as channel, round(max(ptp), 5) as ptp from s join q using (subject) where ptp between q[1] and q[2] group by 1")
def _(spark, d):
    s = A.channel_stats(long_epochs(spark, d), ["subject", "trial_idx", "channel"]).withColumn("channel", F.col("trial_idx") * 4 + F.col("channel"))
    return A.top_channel(s, ["subject"], "ptp", trim=(0.05, 0.95)).select("subject", "channel", *r("ptp"))


@query("t3_argmax", "select trial_idx, channel, (list_position(list_transform(v[11:40], lambda x: abs(x)), list_max(list_transform(v[11:40], lambda x: abs(x)))) - 1 + 10)::int as peak from ep")
def _(spark, d):
    return v_epochs(spark, d).select("trial_idx", "channel", A.argmax_abs(F.col("v"), 10, 30).alias("peak"))


@query("t4_peak_near", ", p as (select trial_idx, channel, v, list_position(list_transform(v, lambda x: abs(x)), list_max(list_transform(v, lambda x: abs(x)))) - 1 as i from ep) select trial_idx, channel, round(v[i + 1], 5) as peak from p where abs(i / 64.0 - 0.5) <= 0.2")
def _(spark, d):
    return A.peak_near(v_epochs(spark, d), ["trial_idx", "channel"], FS, 0.5, 0.2).select("trial_idx", "channel", *r("peak"))


for _how, _op in (("intersect", "intersect"), ("union", "union"), ("minus", "except")):

    @query(f"t5_subjects_{_how}", f"select doc_id as subject from documents {_op} select c_custkey from customer")
    def _(spark, d, how=_how):
        docs, _, cust = modalities(spark, d)
        return A.subject_sets(docs, cust, how)


@query("t6_common_channels", "select run as channel from we group by 1 having count(distinct subject) = (select count(distinct subject) from we)", V_WEIGHTED)
def _(spark, d):
    return A.common_channels(v_weighted(spark, d).withColumn("channel", F.col("run")))


@query("t7_paired", "select subject, round(avg(reaction_time) filter (run = 1), 5) as a, round(avg(reaction_time) filter (run = 2), 5) as b from tr group by 1 having a is not null and b is not null", V_TRIALS)
def _(spark, d):
    t = v_trials(spark, d)
    half = lambda k, n: t.filter(F.col("run") == k).groupBy("subject").agg(F.round(F.avg("reaction_time"), 5).alias(n))
    return A.paired(half(1, "a"), half(2, "b"))


def epoch_sums(x):
    """Weighted checksum of an array, so that its order counts."""
    return F.round(F.aggregate(F.transform("v", lambda z, i: z * (i + 1)), F.lit(0.0), lambda s, z: s + z), 3).alias("check")


CHECK = "round(list_sum(list_transform(v, lambda x, i: x * i)), 3) as check"


@query("g1_baseline_correct", f", b as (select trial_idx, channel, list_avg(v[1:13]) as m, v as o from ep), c as (select trial_idx, channel, list_transform(o, lambda x: x - m) as v from b) select trial_idx, channel, {CHECK} from c")
def _(spark, d):
    return G.baseline_correct(v_epochs(spark, d), FS, T0).select("trial_idx", "channel", epoch_sums("v"))


@query("g2_demean", f", b as (select trial_idx, channel, list_avg(v) as m, v as o from ep), c as (select trial_idx, channel, list_transform(o, lambda x: x - m) as v from b) select trial_idx, channel, {CHECK} from c")
def _(spark, d):
    return G.demean(v_epochs(spark, d)).select("trial_idx", "channel", epoch_sums("v"))


@query("g3_detrend", ", s as (select trial_idx, channel, list_avg(v) as m, list_sum(list_transform(v, lambda x, i: (i - 32.5) * x)) / (64 * 4095 / 12.0) as b, v from ep) select trial_idx, channel, round(v[1] - m + 31.5 * b, 5) as first, round(v[64] - m - 31.5 * b, 5) as last from s")
def _(spark, d):
    return G.detrend(v_epochs(spark, d)).select("trial_idx", "channel", F.round(F.col("v")[0], 5).alias("first"), F.round(F.col("v")[63], 5).alias("last"))


@query("g5_trapz", "select trial_idx, channel, round((list_sum(v[11:31]) - (v[11] + v[31]) / 2) / 64, 6) as area from ep")
def _(spark, d):
    return v_epochs(spark, d).select("trial_idx", "channel", F.round(G.trapz(F.col("v"), 1 / FS, 10, 30), 6).alias("area"))


PEAK = """, w as (select trial_idx, channel, v, list_min(v[39:59]) as peak, list_position(v[39:59], list_min(v[39:59])) + 37 as i from ep),
c as (select *, list_max(list_filter(range(64), lambda k: v[k + 1] >= 0 and k < i)) as a, list_min(list_filter(range(64), lambda k: v[k + 1] >= 0 and k > i)) as b from w),
f as (select *, peak < 0 and a is not null and b is not null as ok from c),
z as (select trial_idx, channel, peak, i, case when ok then a end as start_idx, case when ok then b end as end_idx,
  case when ok then (list_sum(v[a + 1:b + 1]) - (v[a + 1] + v[b + 1]) / 2) / 64 else (list_sum(v[39:59]) - (v[39] + v[59]) / 2) / 64 end as area from f) """


@query("g6_component_features", PEAK + "select trial_idx, channel, round(-0.2 + i / 64.0, 5) as peak_time, round(peak, 5) as peak_amp, round(area, 6) as area, start_idx::int as start_idx, end_idx::int as end_idx from z")
def _(spark, d):
    c = G.component_features(v_epochs(spark, d), FS, T0, [(0.4, 0.7, -1)]).select("trial_idx", "channel", F.col("components")[0].alias("c")).select("trial_idx", "channel", "c.*")
    return c.select("trial_idx", "channel", *r("peak_time", "peak_amp"), *r("area", digits=6), "start_idx", "end_idx")


@query("g7_erp_area", PEAK + "select trial_idx, channel, round(abs(area), 6) as erp_area from z")
def _(spark, d):
    return G.erp_area(v_epochs(spark, d), FS, T0, [(0.4, 0.7, -1)]).select("trial_idx", "channel", *r("erp_area", digits=6))


@query("w18_gradient", ", g as (select trial_idx, channel, list_transform(range(1, 65), lambda i: 64 * case when i = 1 then v[2] - v[1] when i = 64 then v[64] - v[63] else (v[i + 1] - v[i - 1]) / 2 end) as v from ep) select trial_idx, channel, round(list_sum(list_transform(v, lambda x, i: x * i)), 2) as check from g")
def _(spark, d):
    x = F.aggregate(F.transform("v", lambda z, i: z * (i + 1)), F.lit(0.0), lambda s, z: s + z)
    return G.gradient(v_epochs(spark, d), FS).select("trial_idx", "channel", F.round(x, 2).alias("check"))


@query("g27_rereference", LONG + ", m as (select subject, trial_idx, pos, avg(x) as r from lo where channel in (0, 1) group by 1, 2, 3) select trial_idx, channel, pos, round(x - r, 5) as v from lo join m using (subject, trial_idx, pos)")
def _(spark, d):
    return G.rereference(long_epochs(spark, d), ["subject", "trial_idx", "pos"], [0, 1]).select("trial_idx", "channel", "pos", *r("v"))


