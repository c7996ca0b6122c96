"""DuckDB SQL of queries whose plain form needs Fourier sums, orthogonal polynomials, tail series or closures."""

from __future__ import annotations

import math

import numpy as np

from tessera.functions import kernels as K
from tessera.plans.model_queries import DAYS, ROI
from tessera.plans.trial_queries import ZONED
from tessera.plans.views import V_EPOCHS, V_SAMPLES, V_TRIALS

Q: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, views: str, body: str) -> None:
    SQL[name] = f"with recursive {views}{body}"


def _table(name: str, columns: str, rows) -> str:
    cell = lambda x: f"{x!r}::double" if isinstance(x, float) else repr(x)
    return f", {name} as (select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({columns})) "


# Tails: the closed sums for whole degrees of freedom, and the power series of the normal distribution.


def t_within(t: str, v: str) -> str:
    """P(|T| < |t|) for v degrees of freedom: finite sums over powers of the cosine of atan(t / sqrt(v))."""
    sin, cos2 = f"(abs({t}) / sqrt({v} + ({t}) * ({t})))", f"({v} / ({v} + ({t}) * ({t})))"
    odd = f"list_sum(list_transform(range(0, ({v}::bigint - 1) // 2), lambda j: exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * pow({cos2}, j + 0.5)))"
    even = f"list_sum(list_transform(range(0, {v}::bigint // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi()) * pow({cos2}, j)))"
    return f"(case when {v}::bigint % 2 = 1 then 2 / pi() * (atan(abs({t}) / sqrt({v})) + {sin} * coalesce({odd}, 0)) else {sin} * coalesce({even}, 0) end)"


def normal_below(x: str) -> str:
    """Phi(x) by its power series, for |x| up to about 7."""
    term = f"exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - (k + 1) * ln(2.0) - lgamma(k + 1.5) + 0.5 * ln(pi()))"
    return f"(0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: {term})))"


def bisected(name: str, source: str, keys: str, low: float, high: float, below: str) -> str:
    """A recursive table (keys, x): where `below` of `mid` turns from true to false, for each row of `source`."""
    mid = "((lo + hi) / 2)"
    cond = below.replace("mid", mid)
    return (
        f", {name}_steps as (select {keys}, {low}::double as lo, {high}::double as hi, 0 as step from {source} "
        f"union all select {keys}, case when {cond} then {mid} else lo end, case when {cond} then hi else {mid} end, step + 1 from {name}_steps where step < 60), "
        f"{name} as (select {keys}, (lo + hi) / 2 as x from {name}_steps where step = 60) "
    )


_add(
    "a5_signal_detection", V_TRIALS,
    ZONED + ", c as (select subject, zone, count(*) filter (condition = 'mnt_correct') as co, count(*) filter (condition = 'mnt_incorrect') as ce, count(*) filter (condition = 'city_correct') as cc, count(*) filter (condition = 'city_incorrect') as oe from zo where zone is not null group by 1, 2), "
    "h0 as (select *, 1 - ce::double / nullif(ce + co, 0) as h, oe::double / nullif(oe + cc, 0) as f from c), "
    "h as (select subject, zone, case when h = 1 then 1 - 0.5::double / (ce + co) when h = 0 then 0.5::double / (ce + co) else h end as h, case when f = 1 then 1 - 0.5::double / (oe + cc) when f = 0 then 0.5::double / (oe + cc) else f end as f from h0), "
    "ps as (select distinct p from (select h as p from h union all select f from h) where p is not null)"
    + bisected("z", "ps", "p", -7, 7, f"{normal_below('mid')} < p")
    + "select subject, zone, round(a.x - b.x, 5) as d_prime, round(-(a.x + b.x) / 2, 5) as criterion from h left join z a on a.p = h.h left join z b on b.p = h.f",
)
_add(
    "a9_mean_ci", V_TRIALS,
    ", p as (select subject, condition, avg(vtc) as m from vt group by 1, 2), s as (select condition, avg(m) as mean, stddev_samp(m) / sqrt(count(m)) as sem, count(m) as n from p group by 1), vs as (select distinct (n - 1)::double as v from s where n > 1)"
    + bisected("q", "vs", "v", 0, 100, f"{t_within('mid', 'v')} < 0.95")
    + "select condition, round(mean, 5) as mean, round(mean - x * sem, 5) as ci_low, round(mean + x * sem, 5) as ci_high, n from s left join q on v = n - 1",
)
_add(
    "w25_bonferroni", V_TRIALS,
    ", c as (select count(distinct subject) as n from tr), vs as (select n, (n - 1)::double as v, 0.05::double / (n * 30) as a from c)"
    + bisected("q", "vs", "n, v, a", 0, 100, f"1 - {t_within('mid', 'v')} > a")
    + "select n, round(a, 10) as alpha, round(x, 5) as t_crit from q",
)
_P_LINE = "r * sqrt((n - 2) / greatest(1 - r * r, 1e-300))"
_add(
    "r1_linregress_p", V_TRIALS,
    DAYS + f", f as (select subject, corr(vtc, day) as r, count(*)::double as n from da where vtc is not null group by 1), t as (select subject, {_P_LINE} as t, n - 2 as v from f) select subject, round(1 - {t_within('t', 'v')}, 5) as p from t",
)

# Regressions by orthogonal polynomials: each power minus its projections on the ones below.


def _ortho(keys: str, u: str, source: str, upto: int) -> str:
    """, o as (...): rows of `source` where `y` counts, with p1 .. p`upto` and the sums of their squares and products with y."""
    w = f"over (partition by {keys})"
    ok = "filter (y is not null)"
    out = f", o0 as (select *, {u} as u, count(y) {w} as n_y, avg(y) {w} as y0 from {source})"
    out += f", o1 as (select *, u - avg(u) {ok} {w} as p1 from o0)"
    for k in range(2, upto + 1):
        lower = " ".join(f"- p{j} * sum(u ** {k} * p{j}) {ok} {w} / nullif(sum(p{j} * p{j}) {ok} {w}, 0)" for j in range(1, k))
        out += f", o{k} as (select *, u ** {k} - avg(u ** {k}) {ok} {w} {lower} as p{k} from o{k - 1})"
    sums = ", ".join(f"sum(p{k} * p{k}) {ok} {w} as s{k}, sum(y * p{k}) {w} as c{k}" for k in range(1, upto + 1))
    return out + f", o as (select *, {sums} from o{upto}) "


_add(
    "g4_poly_detrend_cubic", V_TRIALS,
    DAYS + ", dy as (select *, vtc as y from da)" + _ortho("subject", "(day - avg(day) over (partition by subject)) / greatest(stddev_pop(day) over (partition by subject), 1e-12)", "dy", 3)
    + "select subject, run, trial_idx, case when n_y >= 5 then round(y - y0 - c1 / s1 * p1 - c2 / s2 * p2 - c3 / s3 * p3, 4) end as detrended from o",
)
_add(
    "r4_ols", V_TRIALS,
    DAYS + ", dy as (select *, vtc as y from da where vtc is not null)" + _ortho("subject, run", "day / 10", "dy", 2)
    + ", m as (select subject, run, any_value(y0) as y0, any_value(c1 / s1) as b1, any_value(c2 / s2) as b2, avg(u) as m1, avg(u * u) as m2, sum(u * u * p1) / any_value(s1) as c from o where n_y >= 4 group by 1, 2) "
    "select subject, round(avg(y0 - b1 * m1 - b2 * (m2 - c * m1)), 5) as b_const, round(avg(b1 - b2 * c), 5) as b_day, round(avg(b2), 5) as b_day2 from m group by 1",
)
_RSS = ", dy as (select *, vtc as y from da where vtc is not null)" + _ortho("subject", "day / 10", "dy", 2) + (
    ", e as (select subject, any_value(n_y) as n, any_value(c1 / s1) as b, any_value(s1) as sxx, sum((y - y0) ** 2) as tss, sum((y - y0 - c1 / s1 * p1) ** 2) as rss_a, sum((y - y0 - c1 / s1 * p1 - c2 / s2 * p2) ** 2) as rss_b from o group by 1) "
)
_add(
    "r5_added_variable_test", V_TRIALS,
    DAYS + _RSS + ", f as (select *, (n - 3)::double as v, greatest(0.0, (rss_a - rss_b) / nullif(rss_b / (n - 3), 0)) as f from e where n >= 4) "
    f"select subject, round(f, 5) as f, round((rss_a - rss_b) / nullif(tss, 0), 5) as delta_r2, round(1 - {t_within('sqrt(f)', 'v')}, 5) as p, n from f",
)
_Z = ", f as (select *, (n - 2)::double as v, b / sqrt(rss_a / (n - 2) / sxx) as z from e where n > 2) "
_add("r20_contrast", V_TRIALS, DAYS + _RSS + _Z + f"select subject, round(z * z, 5) as f, round(1 - {t_within('z', 'v')}, 5) as p, round(z, 5) as z from f")
_add(
    "r25_significant_share", V_TRIALS,
    DAYS + _RSS + _Z + f", p as (select 1 - {t_within('z', 'v')} as p from f), m as (select *, count(*) over () as m, rank() over (order by p) as k from p), "
    "a as (select p, min(p * m / k) over (order by p desc range between unbounded preceding and current row) as q from m) select 1 as family, avg((q <= 0.05)::int) as ratio, count(*) as n from a",
)

# Trials.

# Kernels folded to the period of a mirrored run, once per length of a run; a trial then meets each other trial and its mirror.
_add(
    "a33_smoothing_sweep", V_TRIALS,
    ", sg as (select unnest(list_prepend(0.0::double, list_transform(range(198), lambda x: 1 + x / 2.0::double))) as sigma), k0 as (select sigma, unnest(range(-floor(4 * sigma + 0.5)::int, floor(4 * sigma + 0.5)::int + 1)) as k from sg), "
    "k1 as (select *, case when sigma > 0 then exp(-0.5 * (k / sigma) ** 2) else 1.0 end as g from k0), ke as (select sigma, k, g / sum(g) over (partition by sigma) as w from k1), "
    "nn as (select subject, run, count(*) as n from vt group by 1, 2), fw as (select n, sigma, (k % (2 * n) + 2 * n) % (2 * n) as j, sum(w) as w from (select distinct n from nn), ke group by 1, 2, 3), "
    "pa as (select a.subject, a.run, a.trial_idx, n, b.vtc, (b.trial_idx - a.trial_idx + 2 * n) % (2 * n) as j1, (4 * n - 1 - b.trial_idx - a.trial_idx) % (2 * n) as j2 from vt a join vt b using (subject, run) join nn using (subject, run)), "
    "ju as (select subject, run, trial_idx, n, vtc, unnest([j1, j2]) as j from pa), "
    "sm as (select sigma, subject, run, trial_idx, sum(w * vtc) as x from ju join fw using (n, j) group by 1, 2, 3, 4), "
    "md as (select sigma, subject, run, quantile_cont(x, 0.5) as q from sm group by 1, 2, 3), "
    "df as (select sigma, subject, run, (avg(reaction_time) filter (x < q) - avg(reaction_time) filter (x >= q)) * 1000 as d from sm join md using (sigma, subject, run) join vt using (subject, run, trial_idx) where condition = 'city_correct' group by 1, 2, 3) "
    "select sigma, count(d) as n_runs, round(avg(d), 4) as rt_diff_ms from df group by 1",
)
_add(
    "g22_trials_to_grid", V_TRIALS,
    ", s as (select subject, run, floor(onset / 100000)::int as sec, arg_max(vtc, trial_idx) as v from vt group by 1, 2, 3), b as (select subject, run, unnest(range(min(sec), max(sec) + 1))::int as sec from s group by 1, 2), j as (select subject, run, sec, v from b left join s using (subject, run, sec)), "
    "f as (select *, last_value(case when v is not null then sec end ignore nulls) over p as pi, last_value(v ignore nulls) over p as pv, first_value(case when v is not null then sec end ignore nulls) over n as ni, first_value(v ignore nulls) over n as nv from j "
    "window p as (partition by subject, run order by sec rows between unbounded preceding and current row), n as (partition by subject, run order by sec rows between current row and unbounded following)) "
    "select subject, run, sec, round(case when pv is null then nv when nv is null then pv when pi = ni then pv else pv + (nv - pv) / (ni - pi) * (sec - pi) end, 6) as vtc_grid from f",
)


def _interpolated(grid: str, points: str, keys: list[str]) -> str:
    """, it as (...): the series `points` (keys, ts, v) at the times t of `grid` (keys, i, t), linear, clamped."""
    on = " and ".join(f"g.{k} = s.{k}" for k in keys)
    by = ", ".join(f"g.{k}" for k in keys)
    return (
        f", nb as (select {by}, g.i, any_value(g.t) as t, max(ts) filter (ts <= g.t) as pt, arg_max(s.v, ts) filter (ts <= g.t) as pv, min(ts) filter (ts >= g.t) as nt, arg_min(s.v, ts) filter (ts >= g.t) as nv from {grid} g left join {points} s on {on} group by {by}, g.i), "
        f"it as (select {', '.join(keys)}, i, case when pt is null then nv when nt is null or nt = pt then pv else pv + (nv - pv) * (t - pt) / (nt - pt) end as v from nb) "
    )


_add(
    "g17_resample_linear", V_SAMPLES,
    ", e as (select subject, min(t) as a, max(t) as b, 1 / 43200.0::double as hz from sa group by 1), g as (select subject, i, a + i / hz as t from (select *, unnest(range(0, floor((b - a) * hz)::bigint + 1)) as i from e)), pp as (select subject, t as ts, v from sa)"
    + _interpolated("g", "pp", ["subject"]) + "select subject, i, round(v, 5) as v from it",
)
_add(
    "g29_trace_on_grid", V_TRIALS,
    ", tt as (select *, case when count(*) over (partition by subject, run) > 1 then trial_idx::double / (count(*) over (partition by subject, run) - 1) else trial_idx end as ts from vt), pp as (select subject, run, ts, vtc as v from tt where vtc is not null), "
    "g as (select subject, run, i::int as i, i / 20.0::double as t from (select distinct subject, run from pp), range(0, 21) r(i))"
    + _interpolated("g", "pp", ["subject", "run"]) + ", m as (select subject, i, avg(v) as v from it group by 1, 2) select i as g, round(avg(v), 5) as v from m group by 1",
)

# Series and spectra: discrete Fourier sums over unnested samples.

_LONG = ", lo as (select *, unnest(range(64))::int as i, unnest(v) as x from ep) "


def _fourier(name: str, source: str, keys: str, x: str, n: int) -> str:
    """, name as (keys, f, re, im): the non-negative frequencies of length n of `x` at places i."""
    return f", {name} as (select {keys}, f::int as f, sum({x} * cos(2 * pi() * f * i / {n})) as re, -sum({x} * sin(2 * pi() * f * i / {n})) as im from {source}, range(0, {n // 2 + 1}) g(f) group by {keys}, f) "


def _segments(source: str, keys: str, n: int, step: int, last: int) -> str:
    """, sg as (keys, s, i, x): segments of n samples from every `step`, mean removed, times a periodic Hann window."""
    return (
        f", s0 as (select {keys}, s, i - s as i, x from (select *, unnest(range(0, {last} + 1, {step})) as s from {source}) where i >= s and i < s + {n}), "
        f"sg as (select {keys}, s, i, (x - avg(x) over (partition by {keys}, s)) * (0.5 - 0.5 * cos(2 * pi() * i / {n})) as x from s0) "
    )


def _density(n: int, fs: str) -> str:
    """One-sided density from re and im of a periodic Hann window of length n (its squares sum to 3 n / 8)."""
    return f"(re * re + im * im) / ({fs} * {3 * n / 8}) * case when f in (0, {n // 2}) then 1 else 2 end"


_add("g9_hann_psd", V_EPOCHS, _LONG + ", w as (select trial_idx, channel, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 63)) as x from lo), ww as (select sum((0.5 - 0.5 * cos(2 * pi() * i / 63)) ** 2) as s from range(64) r(i))" + _fourier("ft", "w", "trial_idx, channel", "x", 64) + "select trial_idx, f, round(avg((re * re + im * im) / (64 * s)), 8) as p from ft, ww group by 1, 2")
_SEG64 = _LONG + _segments("lo", "subject, trial_idx, channel", 64, 32, 0) + _fourier("ft", "sg", "subject, trial_idx, channel", "x", 64)
_BAND = "round(sum(p * case when f in ({0}, {1}) then 0.5 else 1 end) filter (f between {0} and {1}), 8)"
_add("g10_band_power", V_EPOCHS, _SEG64 + f", d as (select *, {_density(64, '64')} as p from ft) select subject, trial_idx, channel, {_BAND.format(4, 8)} as theta, {_BAND.format(8, 12)} as alpha from d group by 1, 2, 3")
_add(
    "g24_source_spectrum", V_EPOCHS,
    _LONG + _segments("lo", "event, trial_idx, channel", 32, 16, 32) + _fourier("ft", "sg", "event, trial_idx, channel, s", "x", 32)
    + f", d as (select event, trial_idx, channel, f, avg({_density(32, '64')}) as p from ft group by 1, 2, 3, 4), c as (select event, channel, f, avg(p) as p from d group by 1, 2, 3) select event, f as pos, round(avg(p), 8) as v from c group by 1, 2",
)
_add(
    "g28_vtc_spectrum", V_TRIALS,
    ", ok as (select subject, run, vtc as x, (row_number() over (partition by subject, run order by trial_idx) - 1)::int as i, count(*) over (partition by subject, run) as n from vt where vtc is not null), lg as (select * from ok where n >= 16), "
    "s0 as (select subject, run, s, i - s as i, x from (select *, unnest(range(0, n - 15, 8)) as s from lg) where i >= s and i < s + 16), sg as (select subject, run, s, i, (x - avg(x) over (partition by subject, run, s)) * (0.5 - 0.5 * cos(2 * pi() * i / 16)) as x from s0) "
    + _fourier("ft", "sg", "subject, run, s", "x", 16)
    + f", d as (select subject, run, f, avg({_density(16, '1.25')}) as p from ft group by 1, 2, 3), c as (select subject, f, avg(p) as p from d group by 1, 2) select f as pos, round(avg(p), 6) as mean, round(stddev_samp(p) / sqrt(count(p)), 6) as sem from c group by 1",
)


def _tapers(n: int, nw: float, k: int) -> str:
    return _table("ta", "k, i, h", [(j, i, float(x)) for j, row in enumerate(K.dpss(n, nw, k)) for i, x in enumerate(row)])


def _detrended(source: str, keys: str) -> str:
    w = f"over (partition by {keys})"
    return f", de as (select {keys}, i, x - avg(x) {w} - (i - avg(i) {w}) * (sum(x * i) {w} - avg(x) {w} * sum(i) {w}) / (sum(i * i) {w} - avg(i) {w} * sum(i) {w}) as x from {source}) "


_MULTITAPER = (
    _LONG + _tapers(32, 2.0, 3) + ", s0 as (select subject, event, trial_idx, channel, s, i - s as i, x from (select *, unnest(range(0, 33, 16)) as s from lo) where i >= s and i < s + 32)" + _detrended("s0", "subject, event, trial_idx, channel, s")
    + ", tp as (select subject, event, trial_idx, channel, s, k, de.i, x * h as x from de join ta on ta.i = de.i)" + _fourier("ft", "tp", "subject, event, trial_idx, channel, s, k", "x", 32)
)
_add("g12_multitaper_power", V_EPOCHS, _MULTITAPER + 'select subject, (s // 16)::int as "window", f, round(log10(avg((re * re + im * im) / 64)), 5) as log_power from ft group by 1, 2, 3')
_MEANS = ', pw as (select {0}, (s // 16)::int as "window", f, avg(re * re + im * im) as p from ft group by 1, 2, 3) '
_add("g12_power_over_baseline", V_EPOCHS, _MULTITAPER + _MEANS.format("subject") + 'select subject, "window", f, round(log10(p / avg(case when "window" * 16 / 64 - 0.2 < 0 then p end) over (partition by subject, f)), 5) as log_ratio from pw')
_add("g12_power_over_condition", V_EPOCHS, _MULTITAPER + _MEANS.format("event") + 'select pw.event, pw."window", pw.f, round(log10(pw.p / z.p), 5) as log_ratio from pw join pw z on z.event = 0 and z."window" = pw."window" and z.f = pw.f')
_add(
    "g13_alpha_power", V_EPOCHS,
    _LONG + _tapers(64, 2.0, 3) + _detrended("lo", "subject, trial_idx, channel") + ", tp as (select subject, trial_idx, channel, k, de.i, x * h as x from de join ta on ta.i = de.i)"
    + _fourier("ft", "tp", "subject, trial_idx, channel, k", "x", 64)
    + ", a as (select subject, trial_idx, channel, avg((re * re + im * im) / 64) as a from ft where f between 8 and 12 group by 1, 2, 3) select subject, trial_idx, channel, round(a / nullif(max(a) over (partition by subject), 0), 5) as scaled from a",
)
_add(
    "g18_resample_fft", V_EPOCHS,
    _LONG + ", ke as (select j::int as j, i::int as i, (1 + list_sum(list_transform(range(1, 16), lambda f: 2 * cos(2 * pi() * f * (j / 32.0 - i / 64.0)))) + 2 * cos(pi() * i / 2) * cos(pi() * j)) / 64 as k from range(32) a(j), range(64) b(i)) "
    "select subject, trial_idx, channel, j as i, round(sum(x * k), 5) as v from lo join ke on ke.i = lo.i group by 1, 2, 3, 4",
)
_add(
    "g23_coherence", V_EPOCHS,
    _LONG + _segments("lo", "subject, trial_idx, channel", 16, 8, 48) + _fourier("ft", "sg", "subject, trial_idx, channel, s", "x", 16)
    + ", c as (select a.subject, a.trial_idx, a.channel, b.channel as other, f, (avg(a.re * b.re + a.im * b.im) ** 2 + avg(a.im * b.re - a.re * b.im) ** 2) / nullif(avg(a.re ** 2 + a.im ** 2) * avg(b.re ** 2 + b.im ** 2), 0) as c "
    "from ft a join ft b using (subject, trial_idx, s, f) where a.channel < 2 and b.channel >= 2 group by 1, 2, 3, 4, 5), m as (select subject, trial_idx, channel, f, avg(c) as c from c group by 1, 2, 3, 4) "
    "select subject, trial_idx, channel, f, round(c, 5) as coherence, round((coalesce(lag(c) over w, c) + c + coalesce(lead(c) over w, c)) / 3, 5) as smooth from m window w as (partition by subject, trial_idx, channel order by f)",
)
_SD = 1 / (4 * math.pi)
# Epochs of a condition have one wavelet transform each; sums over them come last.
_MORLET = (
    _LONG + _table("fq", "freq", [(float(f),) for f in np.geomspace(2, 24, 30)])
    + f", wv as (select freq, u::int as u, cos(2 * pi() * freq * u / 64) * exp((u / 64.0) ** 2 / -(2 * {_SD!r} ** 2)) as wr, sin(2 * pi() * freq * u / 64) * exp((u / 64.0) ** 2 / -(2 * {_SD!r} ** 2)) as wi from fq, range(-25, 26) r(u)), nr as (select freq, sum(wr * wr + wi * wi) as s from wv group by 1), "
    "cr as (select *, avg(x) over (partition by trial_idx, channel) as c from lo), md as (select subject, quantile_cont(c, 0.5) as q from cr where i = 0 group by 1), zo as (select cr.*, case when c < q then 'in' else 'out' end as zone from cr join md using (subject)), "
    "cv as (select event, zone, trial_idx, channel, freq, i + u as pos, sum(x * wr) as re, sum(x * wi) as im from zo, wv where i + u between 0 and 63 group by 1, 2, 3, 4, 5, 6), "
)
_POWER = "avg(2 * (re * re + im * im) / s)"
_add("g25_morlet_power", V_EPOCHS, _MORLET + f"p as (select event, freq, pos, {_POWER} as v from cv join nr using (freq) group by 1, 2, 3) select event, round(freq, 6) as freq, pos, round(10 * log10(v), 5) as db from p")
_add("g25_morlet_in_out", V_EPOCHS, _MORLET + f"p as (select event, zone, freq, pos, {_POWER} as v from cv join nr using (freq) group by 1, 2, 3, 4) select event, round(a.freq, 6) as freq, pos, round(10 * log10(a.v / b.v), 5) as db from p a join p b using (event, freq, pos) where a.zone = 'in' and b.zone = 'out'")
_add(
    "r15_bspline_compress", V_EPOCHS,
    _LONG + _table("ba", "i, spline, b", [(d, k, float(K.bspline(64, 6)[d, k])) for d in range(64) for k in range(6)])
    + "select subject, trial_idx, channel, spline, round(sum(x * b), 5) as x from lo join ba on ba.i = lo.i group by 1, 2, 3, 4",
)
_add(
    "w4_filtfilt_fir", V_SAMPLES,
    ", g as (select k::int as k, exp(-0.5 * (2.5 * (k - 9.5) / 9.5) ** 2) as g from range(20) r(k)), ke as (select k, g / sum(g) over () as w from g), nn as (select subject, count(*)::int as n, least(60, count(*)::int - 1) as pad from sa group by 1), "
    "pl as (select subject, n, pad, p::int as p, case when p < pad then pad - p when p < pad + n then p - pad else 2 * n - 2 - (p - pad) end as src, case when p < pad then 0 when p >= pad + n then n - 1 end as pin from nn, range(0, 100000) r(p) where p < n + 2 * pad), "
    "y as (select pl.subject, n, pad, p, case when pin is null then a.v else 2 * b.v - a.v end as y from pl join sa a on a.subject = pl.subject and a.i = src left join sa b on b.subject = pl.subject and b.i = pin), "
    "c1 as (select q.subject, q.p, sum(w * y.y) as c from (select subject, p, w, greatest(p - k, 0) as src from y, ke) q join y on y.subject = q.subject and y.p = q.src group by 1, 2), "
    "c2 as (select q.subject, q.p, q.n, q.pad, sum(w * c1.c) as c from (select subject, n, pad, p, w, least(p + k, n + 2 * pad - 1) as src from y, ke) q join c1 on c1.subject = q.subject and c1.p = q.src group by 1, 2, 3, 4) "
    "select y.subject, (y.p - y.pad)::int as i, round(case when y.pad < 1 then y.y else c end, 5) as v from y join c2 using (subject, p) where y.p >= y.pad and y.p < y.pad + y.n",
)

# Components: the closure of the links.


def _closure(a: str) -> str:
    """, re as (...): all ends that a node reaches, from links (a, b) in both directions; the smallest names the component."""
    return f", lk as (select a, b from {a} union select b, a from {a}), re as (select a, b from lk union select re.a, lk.b from re join lk on re.b = lk.a) "


_add("c2_correlation_groups", V_EPOCHS, ROI + ", rr as (select x.roi as a, y.roi as b from ro x join ro y on x.t = y.t and x.roi < y.roi group by 1, 2 having corr(x.v, y.v) >= 0.2)" + _closure("rr") + 'select a as roi, least(a, min(b)) as "group" from re group by 1')
_add(
    "c1_cluster_series", V_EPOCHS,
    ", ve as (select vec_id as vertex, embedding[1]::double * 50 as x, embedding[2]::double * 50 as y, embedding[3]::double * 50 as z from embeddings), pr as (select a.vertex as a, b.vertex as b from ve a join ve b on a.vertex < b.vertex where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 8), "
    "lo as (select vec_id, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings), li as (select pr.a, pr.b from pr join lo p on p.vec_id = pr.a join lo q on q.vec_id = pr.b and p.i = q.i group by 1, 2 having corr(p.x, q.x) >= 0.3)"
    + _closure("li") + "select a as vertex, least(a, min(b)) as cluster from re group by 1",
)
