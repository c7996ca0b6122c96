"""Regression and tests: moments in Spark, small solves per group, fits in grouped pandas functions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tessera.functions import kernels as K
from tessera.functions.stats import p_f, p_greater, p_two_sided


def linregress(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Slope, intercept, r, R squared and p of a line per key."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = ok.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.count("*").alias("n"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    return s.withColumn("r2", F.col("r") * F.col("r")).withColumn("p", p_two_sided(t, F.col("n") - 2.0))


def corr_by(df: DataFrame, x: str, y: str, inner: list[str], outer: list[str]) -> DataFrame:
    """Pearson r per inner key, its mean per outer key (R2)."""
    per = df.groupBy(*dict.fromkeys([*inner, *outer])).agg(F.corr(x, y).alias("r"))
    return per.groupBy(*outer).agg(F.avg("r").alias("r"), F.count("r").alias("n"))


@pandas_udf(ArrayType(DoubleType()))
def _solve(m: pd.Series) -> pd.Series:
    """Coefficients from packed upper moments [xx..., xy...] of k regressors; minimum norm if singular."""
    out = []
    for v in m:
        v = np.asarray(v, dtype=float)
        k = int((np.sqrt(9 + 8 * len(v)) - 3) / 2)
        xx = np.zeros((k, k))
        xx[np.triu_indices(k)] = v[: k * (k + 1) // 2]
        xx = xx + np.triu(xx, 1).T
        out.append(np.linalg.lstsq(xx, v[k * (k + 1) // 2 :], rcond=None)[0])
    return pd.Series(out)


def ols(df: DataFrame, y: str, terms: dict[str, Column], keys: list[str], min_n: int | None = None) -> DataFrame:
    """Ordinary least squares per key from moments that Spark sums: beta by name, rss, tss, n.

    A term named 'const' is the intercept. Groups with fewer than `min_n` (default: terms + 1) rows go.
    """
    names = list(terms)
    x = df.withColumns({f"__{n}": c.cast("double") for n, c in terms.items()}).withColumn("__y", F.col(y).cast("double"))
    x = x.dropna(subset=["__y", *[f"__{n}" for n in names]])
    pairs = list(combinations_with_replacement(names, 2))
    xx = [F.sum(F.col(f"__{a}") * F.col(f"__{b}")) for a, b in pairs]
    xy = [F.sum(F.col(f"__{a}") * F.col("__y")) for a in names]
    g = x.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*xx, *xy).alias("__m"), F.sum(F.col("__y") * F.col("__y")).alias("__yy"), F.var_pop("__y").alias("__v"))
    g = g.filter(F.col("n") >= (min_n or len(names) + 1)).withColumn("__b", _solve("__m"))
    at = {p: i for i, p in enumerate(pairs)}
    quad = F.lit(0.0)
    for i, a in enumerate(names):
        quad = quad + 2 * F.col("__b")[i] * F.col("__m")[len(pairs) + i]
        for j, b in enumerate(names):
            quad = quad - F.col("__b")[i] * F.col("__b")[j] * F.col("__m")[at[(a, b) if i <= j else (b, a)]]
    out = {f"b_{n}": F.col("__b")[i] for i, n in enumerate(names)}
    return g.withColumns(out | {"rss": F.greatest(F.col("__yy") - quad, F.lit(0.0)), "tss": F.col("__v") * F.col("n"), "k": F.lit(len(names))}).drop("__m", "__yy", "__v", "__b")


def polyfit(df: DataFrame, x: str, y: str, order: int, keys: list[str]) -> DataFrame:
    """Polynomial coefficients b_x0 .. b_xk per key."""
    return ols(df, y, {f"x{k}": F.pow(F.col(x), F.lit(k)) if k else F.lit(1.0) for k in range(order + 1)}, keys)


def poly_detrend(df: DataFrame, x: str, y: str, order: int, keys: list[str], out: str = "detrended") -> DataFrame:
    """y minus its polynomial in x per key, nulls left out of the fit (G4); x is centred first for accuracy."""
    w = W.partitionBy(*keys)
    c = df.withColumn("__x", (F.col(x) - F.avg(x).over(w)) / F.greatest(F.stddev_pop(x).over(w), F.lit(1e-12)))
    fit = polyfit(c, "__x", y, order, keys).select(*keys, *[f"b_x{k}" for k in range(order + 1)])
    value = sum((F.col(f"b_x{k}") * F.pow("__x", F.lit(k)) for k in range(1, order + 1)), F.col("b_x0"))
    return c.join(fit, keys, "left").withColumn(out, F.col(y) - value).drop("__x", *[f"b_x{k}" for k in range(order + 1)])


def added_variable_test(small: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """F, p and change of R squared of the larger of two nested fits (R5); F is floored at 0."""
    a, b = small.select(*keys, F.col("rss").alias("rss_a"), F.col("k").alias("k_a")), large
    x = a.join(b, keys)
    q, d2 = F.col("k") - F.col("k_a"), F.col("n") - F.col("k")
    f = F.greatest(F.lit(0.0), F.try_divide((F.col("rss_a") - F.col("rss")) / q, F.col("rss") / d2))
    x = x.withColumn("f", f).withColumn("delta_r2", F.try_divide(F.col("rss_a") - F.col("rss"), F.col("tss")))
    return x.withColumn("p", p_f("f", q.cast("double"), d2.cast("double"))).select(*keys, "f", "delta_r2", "p", "n")


def ttest_1samp(df: DataFrame, x: str, keys: list[str], mu: float = 0.0, alternative: str = "two-sided") -> DataFrame:
    """One-sample t per key (R6, R9): t, df, p; 0 spread gives null."""
    g = df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("__s"), F.count(x).alias("n"))
    t = F.when(F.col("__s") > 0, (F.col("mean") - mu) / (F.col("__s") / F.sqrt("n")))
    p = p_two_sided if alternative == "two-sided" else p_greater
    return g.withColumn("t", t).withColumn("p", p("t", F.col("n") - 1.0)).drop("__s")


def ttest_rel(a: DataFrame, b: DataFrame, x: str, subject: str, keys: list[str]) -> DataFrame:
    """Paired t per key, pairs by subject."""
    j = a.select(subject, *keys, F.col(x).alias("__a")).join(b.select(subject, *keys, F.col(x).alias("__b")), [subject, *keys])
    return ttest_1samp(j.withColumn("__d", F.col("__a") - F.col("__b")), "__d", keys)


def ttest_ind(df: DataFrame, x: str, group: str, a, b, keys: list[str]) -> DataFrame:
    """Two-sample t with pooled variance per key."""
    m = {n: F.when(F.col(group) == v, F.col(x)) for n, v in (("a", a), ("b", b))}
    g = df.groupBy(*keys).agg(*[f(m[n]).alias(f"__{s}{n}") for n in "ab" for s, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    na, nb = F.col("__na"), F.col("__nb")
    pooled = ((na - 1) * F.col("__va") + (nb - 1) * F.col("__vb")) / (na + nb - 2)
    t = F.when(pooled > 0, (F.col("__ma") - F.col("__mb")) / F.sqrt(pooled * (1 / na + 1 / nb)))
    g = g.withColumn("t", t).withColumn("n", na + nb)
    return g.withColumn("p", p_two_sided("t", F.col("n") - 2.0)).select(*keys, "t", "n", "p")


def hrf_design(trials: DataFrame, times: DataFrame, keys: list[str], pre: float = 2.0, post: float = 10.0, spacing: float = 1.0, sd: float = 1.0) -> DataFrame:
    """Gaussian-kernel regressors in sparse form (keys, t, event, kernel, x).

    Kernel k (from 1) is exp(-(t - onset + pre - k spacing)^2 / 2 sd^2) times the trial's `value`, for
    times in [onset - pre, onset + post]. A bucketed range join brings only those times together, and the kernels are
    summed side by side before they become rows.
    """
    from tessera.operators.joins import _bucketed

    width = pre + post
    iv = trials.select(*keys, "event", "onset", "value", (F.col("onset") - pre).alias("__lo"), (F.col("onset") + post).alias("__hi"))
    # Sums are far more than the trials that make them: a fixed number of partitions is not joined into a few tasks, and a time
    # stays in the bucket that it is joined in, so that its sums are not sent again.
    parts, on = int(trials.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, "__b"]
    b = _bucketed(iv, F.col("__lo"), F.col("__hi"), width).repartition(parts, *on)
    p = times.select(*keys, "t").withColumn("__b", F.floor(F.col("t") / width)).repartition(parts, *on)
    j = p.join(b, on).filter((F.col("t") >= F.col("__lo")) & (F.col("t") <= F.col("__hi")))
    n = round(width / spacing)
    u = lambda k: F.col("t") - F.col("onset") + pre - k * spacing
    sums = j.groupBy(*on, "t", "event").agg(*[F.sum(F.col("value") * F.exp(-u(k) * u(k) / (2 * sd * sd))).alias(f"__{k}") for k in range(1, n + 1)])
    return sums.select(*keys, "t", "event", F.posexplode(F.array(*[F.col(f"__{k}") for k in range(1, n + 1)])).alias("kernel", "x")).withColumn("kernel", F.col("kernel") + 1)


def trial_responses(trials: DataFrame, betas: DataFrame, basis: DataFrame, keys: list[str], gain: Column) -> DataFrame:
    """`trials` with (t, h): the response of the key, sum of beta x kernel, times the trial's gain.

    The kernels are summed once per key and time, not per trial; trials meet the packed response and nothing is grouped after.
    """
    h = betas.join(basis, "kernel").groupBy(*keys, "t").agg(F.sum(F.col("beta") * F.col("b")).alias("h"))
    packed = h.groupBy(*keys).agg(F.collect_list(F.struct("t", "h")).alias("__h"))
    x = trials.withColumn("__g", gain).join(packed, keys).withColumn("__p", F.explode("__h"))
    return x.select(*trials.columns, F.col("__p.t").alias("t"), (F.col("__p.h") * F.col("__g")).alias("h"))


def scaled_trials(trials: DataFrame, feature: str, keys: list[str]) -> DataFrame:
    """`value` = the trial's feature; trials without one get the mean of their run and event."""
    return trials.withColumn("value", F.coalesce(F.col(feature), F.avg(feature).over(W.partitionBy(*keys, "event"))))


def impulse_design(trials: DataFrame, keys: list[str], sfreq: float) -> DataFrame:
    """Centred value at sample round(onset x rate)."""
    x = F.col("value") - F.avg("value").over(W.partitionBy(*keys))
    return trials.select(*keys, F.round(F.col("onset") * sfreq).cast("long").alias("i"), x.alias("x"))


def drift_design(samples: DataFrame, keys: list[str], order: int, kind: str = "poly") -> DataFrame:
    """Drift columns drift0 .. driftk over time scaled to [-1, 1] per key (R14): powers or Legendre polynomials."""
    w = W.partitionBy(*keys)
    lo, hi = F.min("t").over(w), F.max("t").over(w)
    x = samples.withColumn("__s", F.when(hi > lo, 2 * (F.col("t") - lo) / (hi - lo) - 1).otherwise(0.0))
    s, cols = F.col("__s"), [F.lit(1.0)]
    for k in range(1, order + 1):
        if kind == "poly" or k == 1:
            cols.append(F.pow(s, F.lit(k)))
        else:
            cols.append(((2 * k - 1) * s * cols[-1] - (k - 1) * cols[-2]) / k)
    return x.select(*keys, "t", *[c.alias(f"drift{k}") for k, c in enumerate(cols)])


#: Numbers that the matrices of the keys solved together hold at most, for all designs.
SOLVED = 500_000
#: What the solver gives per key: lists over the designs (rank, rss) and over the tests.
NUMBERS = {"rank": IntegerType(), "rss": DoubleType(), "df1": IntegerType(), "df2": IntegerType(), "f": DoubleType(), "total": DoubleType(), "se": DoubleType()}
TESTS = "array<struct<design: string, tested: string, df1: int, df2: int, f: double, total: double, se: double>>"


def _swept(m: np.ndarray, column: int, size: np.ndarray) -> np.ndarray:
    """One sweep of stacked symmetric matrices on a pivot: that column enters the fit. Returns where it did: not if it is a
    combination of those that are in, as its pivot is then a rounding error of its `size`."""
    pivot = m[:, column, column].copy()
    ok = pivot > 1e-10 * np.maximum(size, 1e-300)
    row = m[ok, column, :] / pivot[ok, None]
    col = m[ok][:, :, column].copy()
    m[ok] -= col[:, :, None] * row[:, None, :]
    m[ok, column, :] = row
    m[ok, :, column] = -col / pivot[ok, None]
    m[ok, column, column] = 1 / pivot[ok]
    return ok


def nested_models(df: DataFrame, y: str, base: dict[str, Column], groups: dict[str, dict[str, Column]], keys: list[str]) -> DataFrame:
    """All nested least-squares fits of groups of regressors on top of a base, and tests of the groups, per key.

    (keys, n, models, tests). A design is the base ('base') with any of the groups, named 'a+b' in their order; with two groups
    there are four. `models` has each design's rank and rss. `tests` has, for each design and any of its groups together, the F of
    their coefficients being 0 and, with its standard error, the sum of these coefficients.

    Spark sums one matrix of products per key over all terms. Sweeping a column into that matrix adds its regressor, so a design
    costs the sweeps of its last group, and the corner of the matrix is its rss; F follows from two corners, which for least squares
    is the joint Wald test. Rows with a missing value take no part; a column that is a combination of others is left out of a
    design's rank, and the tests of a group that adds nothing have no F.
    """
    terms = base | {n: c for g in groups.values() for n, c in g.items()}
    names = [*terms, "__y"]
    x = df.select(*keys, *[c.cast("double").alias(f"__t{i}") for i, c in enumerate(terms.values())], F.col(y).cast("double").alias(f"__t{len(terms)}"))
    x = x.dropna(subset=[f"__t{i}" for i in range(len(names))])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    g = x.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(f"__t{i}") * F.col(f"__t{j}")) for i, j in pairs]).alias("__m"))
    chosen = [tuple(n for k, n in enumerate(groups) if bits >> k & 1) for bits in range(1 << len(groups))]
    tested = [(c, t) for c in chosen[1:] for t in chosen[1:] if set(t) <= set(c)]
    label = lambda c: "+".join(c) or "base"
    at = {n: i for i, n in enumerate(names)}
    solve = _nested_solver(len(names), [at[n] for n in base], {k: [at[n] for n in v] for k, v in groups.items()}, chosen, tested)
    # Spark does not look into this step, so a filter on its result does not run it once more, in workers of its own.
    s = g.mapInArrow(solve, StructType([*g.drop("__m").schema, *[StructField(f"__{c}", ArrayType(t)) for c, t in NUMBERS.items()]]))
    pick = lambda i, *cols: [F.col(f"__{c}")[i].alias(c) for c in cols]
    models = [F.struct(F.lit(label(c)).alias("design"), *pick(i, "rank", "rss")) for i, c in enumerate(chosen)]
    tests = [F.struct(F.lit(label(c)).alias("design"), F.lit(label(t)).alias("tested"), *pick(i, "df1", "df2", "f", "total", "se")) for i, (c, t) in enumerate(tested)]
    return s.select(*keys, "n", F.array(*models).alias("models"), (F.array(*tests) if tests else F.array().cast(TESTS)).alias("tests"))


def _nested_solver(size: int, base: list[int], groups: dict[str, list[int]], chosen: list[tuple], tested: list[tuple]):
    """The step of `nested_models` in Python: from batches with `n` and packed sums `__m` to batches with the numbers of all designs
    and tests in their order. Numbers stay in arrays, and a batch is taken in parts of a bounded size, so a worker needs no more for more
    keys."""
    rows, cols = np.triu_indices(size)
    last = size - 1
    step = max(1, SOLVED // (size * size * len(chosen)))

    def packed(columns: list[np.ndarray], keys: int, kind: type) -> pa.Array:
        """One list a key; what is not a number is null."""
        flat = np.array(columns, kind).reshape(len(columns), keys).T.ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(keys + 1, dtype=np.int32) * len(columns)), pa.array(flat, mask=np.isnan(flat)))

    def solved(count: np.ndarray, m: np.ndarray) -> list[list[np.ndarray]]:
        full = np.zeros((len(m), size, size))
        full[:, rows, cols] = full[:, cols, rows] = m
        state: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for c in chosen:
            # A design goes on from the one without its last group.
            mat, inside = (full.copy(), np.zeros((len(m), last), bool)) if not c else (state[c[:-1]][0].copy(), state[c[:-1]][1].copy())
            for term in base if not c else groups[c[-1]]:
                inside[:, term] = _swept(mat, term, full[:, term, term])
            state[c] = mat, inside, np.maximum(mat[:, last, last], 0.0)
        rank = {c: state[c][1].sum(axis=1) for c in chosen}
        tests = []
        for c, t in tested:
            mat, inside, rss = state[c]
            less = tuple(g for g in c if g not in t)
            df1, df2 = rank[c] - rank[less], count - rank[c]
            scale = np.where(df2 > 0, rss / df2, np.nan)
            f = np.where((df1 > 0) & (scale > 0), np.maximum(state[less][2] - rss, 0.0) / df1 / scale, np.nan)
            # The tested coefficients; those of terms that are left out are no part of the sums.
            own = [i for g in t for i in groups[g]]
            used = inside[:, own]
            spread = np.where(used[:, :, None] & used[:, None, :], mat[:, own][:, :, own], 0.0).reshape(len(m), -1).sum(axis=1) * scale
            tests.append((df1, df2, f, np.where(used, mat[:, own, last], 0.0).sum(axis=1), np.sqrt(np.where(spread > 0, spread, np.nan))))
        return [[rank[c] for c in chosen], [state[c][2] for c in chosen], *[[x[k] for x in tests] for k in range(5)]]

    def solve(batches):
        for batch in batches:
            kept = [n for n in batch.schema.names if n != "__m"]
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                m = part.column("__m").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    made = solved(part.column("n").to_numpy(), m)
                made = [packed(v, part.num_rows, np.int32 if t == IntegerType() else float) for v, t in zip(made, NUMBERS.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in kept], *made], [*kept, *[f"__{n}" for n in NUMBERS]])

    return solve


def design_fits(models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, design, rank, rss) of `nested_models`."""
    return models.select(*keys, "n", F.explode("models").alias("__d")).select(*keys, "n", "__d.*")


def group_tests(models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, design, tested, df1, df2, f, p, z) of `nested_models` (R5, R20): joint F with p, and z of the coefficients' sum."""
    x = models.select(*keys, "n", F.explode("tests").alias("__d")).select(*keys, "n", "__d.*")
    p = F.when(F.col("f").isNotNull(), p_f("f", F.col("df1").cast("double"), F.col("df2").cast("double")))
    return x.select(*keys, "n", "design", "tested", "df1", "df2", "f", p.alias("p"), F.try_divide("total", "se").alias("z"))


def spline_taps(df: DataFrame, x: str, keys: list[str], order: str, n_taps: int, n_splines: int) -> DataFrame:
    """`df` with s0 .. s{n-1}: the last `n_taps` values of x, the present one first, projected on a B-spline basis.

    Values before the first row count as 0. A spline covers few delays, so each column sums its own only.
    """
    b = K.bspline(n_taps, n_splines)
    w = W.partitionBy(*keys).orderBy(order)
    lags = {f"__d{d}": F.coalesce(F.lag(x, d).over(w), F.lit(0.0)) for d in range(n_taps)}
    taps = df.withColumns(lags)
    made = {f"s{k}": sum((float(b[d, k]) * F.col(f"__d{d}") for d in range(n_taps) if b[d, k]), F.lit(0.0)) for k in range(n_splines)}
    return taps.withColumns(made).drop(*lags)


def bspline_expand(fits: DataFrame, keys: list[str], n_taps: int, n_splines: int, first: int = 0) -> DataFrame:
    """(keys, delay, h, var): spline coefficients and their covariance mapped back to delays.

    `fits` has beta and cov, the splines from place `first` on. At a delay at most four splines are not 0, so the response is a sum of
    four coefficients and its variance one of sixteen covariances.
    """
    b = K.bspline(n_taps, n_splines)
    delays = F.array(*[F.struct(F.lit(d).alias("d"), F.array(*[F.struct(F.lit(first + k).alias("k"), F.lit(float(b[d, k])).alias("b")) for k in range(n_splines) if b[d, k]]).alias("w")) for d in range(n_taps)])
    x = fits.select(*keys, "beta", "cov", F.explode(delays).alias("__d"))
    add = lambda array, f: F.aggregate(array, F.lit(0.0), lambda s, z: s + f(z))
    h = add(F.col("__d.w"), lambda z: z["b"] * F.get("beta", z["k"]))
    var = add(F.col("__d.w"), lambda z: z["b"] * add(F.col("__d.w"), lambda y: y["b"] * F.get(F.get("cov", z["k"]), y["k"])))
    return x.select(*keys, F.col("__d.d").alias("delay"), h.alias("h"), var.alias("var"))


def bspline_compress(taps: DataFrame, keys: list[str], n_taps: int, df: int) -> DataFrame:
    """Delay taps (keys, delay, x) projected on a B-spline basis (keys, spline, x) (R15); the basis has n_taps x df rows."""
    b = K.bspline(n_taps, df)
    rows = [(d, k, float(b[d, k])) for d in range(n_taps) for k in range(df) if b[d, k]]
    basis = taps.sparkSession.createDataFrame(rows, "delay int, spline int, b double")
    return taps.join(F.broadcast(basis), "delay").groupBy(*keys, "spline").agg(F.sum(F.col("x") * F.col("b")).alias("x"))


def combine_designs(*parts: DataFrame) -> DataFrame:
    """Long designs put together; what is missing is 0 by absence."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


FIT = "beta array<double>, cov array<array<double>>, ar array<double>, n long, df_resid double, scale double"


def fit_series(df: DataFrame, keys: list[str], y: str, xs: list[str], order: str, method: str = "ols", pmax: int = 30, norm: str = "bisquare", ar: list[float] | None = None) -> DataFrame:
    """A fit per key (R17-R19, R26): 'ols', 'robust' or 'ar_irls'; rows with a missing y or x are left out.

    Least squares come from sums of products that Spark makes, so a key may have any number of rows. The
    iterative fits take a series (a channel of a run) as one packed row, and the series of a batch side by side.
    """
    if method == "ols":
        return _fit_moments(df, keys, y, xs)

    @pandas_udf(FIT)
    def fit(rows: pd.Series) -> pd.DataFrame:
        packed = [np.array([list(r) for r in v], dtype=float).reshape(-1, len(xs) + 1) for v in rows]
        out = [{"beta": None, "cov": None, "ar": None, "n": len(v), "df_resid": None, "scale": None} for v in packed]
        enough = [i for i, v in enumerate(packed) if len(v) > len(xs)]
        x, v = [packed[i][:, 1:] for i in enough], [packed[i][:, 0] for i in enough]
        fits = K.irls_many(x, v, norm) if method == "robust" else K.ar_irls_many(x, v, pmax, norm, ar=ar)
        for i, f in zip(enough, fits, strict=True):
            out[i] |= {"beta": f["beta"].tolist(), "cov": f["cov"].tolist(), "ar": list(map(float, f.get("ar", []))), "df_resid": float(f["df"]), "scale": f["scale"]}
        return pd.DataFrame(out, columns=["beta", "cov", "ar", "n", "df_resid", "scale"])

    values = [F.col(c).cast("double") for c in (y, *xs)]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in values])
    row = F.when(whole, F.struct(F.col(order).alias("o"), F.array(*values).alias("v")))
    # Few bytes but much work: a fixed number of partitions is not joined into a few tasks.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = df.select(*dict.fromkeys([*keys, order, y, *xs])).repartition(parts, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__v"))
    return packed.select(*keys, fit("__v.v").alias("__f")).select(*keys, "__f.*")


def _fit_moments(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Least-squares fits from packed sums of products, the first moments taken off where there is a constant's column."""
    names, k = [y, *xs], len(xs)
    x = df.select(*keys, *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(names)])
    ok = reduce(lambda p, q: p & q, [F.col(f"__{i}").isNotNull() for i in range(k + 1)])
    x = x.withColumns({f"__{i}": F.when(ok, F.col(f"__{i}")) for i in range(k + 1)})
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    g = x.groupBy(*keys).agg(F.count("__0").alias("n"), F.array(*[F.sum(F.col(f"__{i}") * F.col(f"__{j}")) for i, j in pairs]).alias("__m"))

    @pandas_udf(f"{FIT}")
    def solve(n: pd.Series, m: pd.Series) -> pd.DataFrame:
        rows = []
        for count, v in zip(n, m, strict=True):
            if count <= k:
                rows.append((None, None, None, count, None, None))
                continue
            full = np.zeros((k + 1, k + 1))
            full[np.triu_indices(k + 1)] = np.asarray(v, dtype=float)
            full = full + np.triu(full, 1).T
            xx, xy, yy = full[1:, 1:], full[0, 1:], full[0, 0]
            beta, _, rank, _ = np.linalg.lstsq(xx, xy, rcond=None)
            df_resid = max(int(count) - int(rank), 1)
            scale = max(float(yy - 2 * beta @ xy + beta @ xx @ beta), 0.0) / df_resid
            rows.append((beta.tolist(), (np.linalg.pinv(xx) * scale).tolist(), [], int(count), float(df_resid), scale))
        return pd.DataFrame(rows, columns=["beta", "cov", "ar", "n", "df_resid", "scale"])

    return g.select(*keys, solve("n", "__m").alias("f")).select(*keys, "f.*")


def contrast(fits: DataFrame, chosen: list[int]) -> DataFrame:
    """Joint F with p of chosen coefficients, and z of their sum."""
    at = np.array(chosen)

    def scan(batches):
        for pdf in batches:
            rows = []
            for b, c, d in zip(pdf["beta"], pdf["cov"], pdf["df_resid"], strict=True):
                if b is None or d is None or np.isnan(d):
                    rows.append((None, None, None))
                    continue
                rows.append(K.contrast({"beta": np.asarray(b, float), "cov": np.array([list(r) for r in c], float), "df": d}, at))
            yield pdf.drop(columns=["beta", "cov", "ar"]).assign(f=[r[0] for r in rows], p=[r[1] for r in rows], z=[r[2] for r in rows])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fits.schema if f.name not in ("beta", "cov", "ar"))
    return fits.mapInPandas(scan, f"{schema}, f double, p double, z double")


def hrf_from_beta(betas: DataFrame, basis: DataFrame, keys: list[str]) -> DataFrame:
    """Response (keys, t, h) = sum of beta x kernel, minus its mean before 0."""
    h = betas.join(basis, "kernel").groupBy(*keys, "t").agg(F.sum(F.col("beta") * F.col("b")).alias("h"))
    return h.withColumn("h", F.col("h") - F.coalesce(F.avg(F.when(F.col("t") < 0, F.col("h"))).over(W.partitionBy(*keys)), F.lit(0.0)))


def hrf_variance(cov: DataFrame, basis: DataFrame, keys: list[str]) -> DataFrame:
    """Variance of the response at each time, b' Cov b (R22); cov is long (keys, k1, k2, c)."""
    b1 = basis.select(F.col("kernel").alias("k1"), "t", F.col("b").alias("b1"))
    b2 = basis.select(F.col("kernel").alias("k2"), "t", F.col("b").alias("b2"))
    return cov.join(b1, "k1").join(b2, ["k2", "t"]).groupBy(*keys, "t").agg(F.sum(F.col("b1") * F.col("c") * F.col("b2")).alias("var"))


def reweighted_variance(var: Column, var_resid: Column, vp: Column) -> Column:
    """Variance scaled by (residual + prior) / residual."""
    return var * (var_resid + vp) / var_resid


def predict(design: DataFrame, betas: DataFrame, keys: list[str], times: list[str]) -> DataFrame:
    """Prediction from a long design and its coefficients."""
    return design.join(betas, [*keys, "regressor"]).groupBy(*keys, *times).agg(F.sum(F.col("x") * F.col("beta")).alias("y_hat"))


def model_scores(df: DataFrame, keys: list[str], y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """MSE, explained variance and correlation of prediction and data."""
    e2 = (F.col(y) - F.col(y_hat)) ** 2
    return df.groupBy(*keys).agg(F.avg(e2).alias("mse"), (1 - F.try_divide(F.sum(e2), F.var_pop(y) * F.count(y))).alias("ev"), F.corr(y, y_hat).alias("r"))


def whiteness(df: DataFrame, keys: list[str], e: str, order: str) -> DataFrame:
    """Lag-1 autocorrelation, whether it is beyond 1.96 / sqrt(n), and Durbin-Watson."""
    w = W.partitionBy(*keys).orderBy(order)
    x = df.withColumn("__c", F.col(e) - F.avg(e).over(W.partitionBy(*keys)))
    x = x.withColumns({"__l": F.lag("__c").over(w), "__p": F.lag(e).over(w)})
    g = x.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("__c") * F.col("__l")), F.sum(F.col("__c") ** 2)).alias("acf1"),
        F.try_divide(F.sum((F.col(e) - F.col("__p")) ** 2), F.sum(F.col(e) ** 2)).alias("dw"),
        F.count(e).alias("n"),
    )
    return g.withColumn("correlated", F.abs("acf1") > 1.96 / F.sqrt("n"))


def residualize(df: DataFrame, y: str, terms: dict[str, Column], keys: list[str], out: str = "resid") -> DataFrame:
    """y minus its least-squares prediction from nuisance terms per key."""
    fit = ols(df, y, terms, keys).select(*keys, *[f"b_{n}" for n in terms])
    value = sum((F.col(f"b_{n}") * c for n, c in terms.items()), F.lit(0.0))
    return df.join(fit, keys, "left").withColumn(out, F.col(y) - value).drop(*[f"b_{n}" for n in terms])


def ar_loglik(df: DataFrame, keys: list[str], e: str, order: str, pmax: int = 5) -> DataFrame:
    """AR order and log-likelihood of residuals per key."""

    @pandas_udf("p int, loglik double")
    def one(series: pd.Series) -> pd.DataFrame:
        rows = []
        for v in series:
            v = np.asarray(v, dtype=float)
            v = v[~np.isnan(v)]
            phi = K.ar_fit(v, pmax)
            rows.append((len(phi), K.ar_loglik(v, phi) if len(v) > len(phi) + 1 else None))
        return pd.DataFrame(rows, columns=["p", "loglik"])

    return _packed(df, keys, order, {"v": e}).select(*keys, one("__v.v").alias("__f")).select(*keys, "__f.*")


def _packed(df: DataFrame, keys: list[str], order: str, cols: dict[str, str]) -> DataFrame:
    """One row per key with `__v`, its rows in order as doubles; the kernels of many keys share a batch, where a group each would cost
    more than its numbers."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(F.col(order).alias("o"), *[F.col(c).cast("double").alias(n) for n, c in cols.items()])
    return df.select(*dict.fromkeys([*keys, order, *cols.values()])).repartition(parts, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__v"))


def prewhitened_xcorr(df: DataFrame, keys: list[str], a: str, b: str, order: str, max_lag: int, pmax: int = 5) -> DataFrame:
    """(keys, lag, r): cross-correlation after filtering both series with [1, -phi] of the first."""

    @pandas_udf("array<struct<lag: int, r: double>>")
    def lags(first: pd.Series, second: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(first, second, strict=True):
            x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
            phi = K.ar_fit(x - x.mean(), pmax)
            x, y = (K.whiten(v - v.mean(), phi) for v in (x, y))
            x, y = ((v - v.mean()) / (v.std() or 1) for v in (x, y))
            n = len(x)
            near = [k for k in range(-max_lag, max_lag + 1) if abs(k) < n]
            out.append([(k, float((x[max(0, -k) : n - max(0, k)] * y[max(0, k) : n - max(0, -k)]).sum() / n)) for k in near])
        return pd.Series(out)

    packed = _packed(df, keys, order, {"a": a, "b": b})
    return packed.select(*keys, F.explode(lags("__v.a", "__v.b")).alias("__l")).select(*keys, "__l.*")
