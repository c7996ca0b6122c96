"""Operators on ranges: one key holds half of all rows, no task holds that key, and the results are those of plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import joins as J
from tessera.operators import trials as T
from tessera.operators import windows as X
from tessera.operators.ranges import RANGE, exact_quantiles, in_ranges

SCHEMA = "k string, i long, t double, v double"


@pytest.fixture(scope="module")
def series():
    """Key 'hot' has half of the rows; times repeat, some values and one key are null."""
    rng = np.random.default_rng(8)
    keys = ["hot"] * 600 + [None] * 20 + [f"k{j % 37}" for j in range(580)]
    return [(k, i, float(rng.integers(0, 400)) / 2, None if rng.random() < 0.1 else float(rng.integers(0, 60))) for i, k in enumerate(keys)]


@pytest.fixture(scope="module")
def sides(series):
    return series[::3], [r for i, r in enumerate(series) if i % 3]


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_no_range_holds_the_large_key(spark, series):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = in_ranges(spark.createDataFrame(series, SCHEMA), ["k"], "t").groupBy("k", RANGE).count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * len(series) / parts
    assert sizes.filter("k = 'hot'").count() >= parts / 2


def neighbours(left, right):
    points = by_key((k, i, t, v) for k, i, t, v in right)
    for k, i, t, _ in left:
        own = [] if k is None else [(u, w) for *_, u, w in points.get(k, [])]
        largest = lambda u: max((w for z, w in own if z == u and w is not None), default=None)
        before, after = max((u for u, _ in own if u <= t), default=None), min((u for u, _ in own if u >= t), default=None)
        yield i, t, before, after, largest


def test_nearest_forward_and_interpolated(spark, sides):
    left, right = sides
    right = [r for r in right if r[0] is not None and r[3] is not None]
    left = [r for r in left if r[0] is not None]
    a, b = spark.createDataFrame(left, SCHEMA).drop("v"), spark.createDataFrame(right, SCHEMA).select("k", F.col("t").alias("u"), "v")
    nearest, forward, interp = {}, {}, {}
    for i, t, p, n, at in neighbours(left, right):
        pick = p if n is None or (p is not None and t - p <= n - t) else n
        nearest[i] = (pick, None if pick is None else at(pick))
        forward[i] = (n, None if n is None else at(n))
        interp[i] = None if p is None and n is None else at(n) if p is None else at(p) if n is None or n == p else at(p) + (at(n) - at(p)) * (t - p) / (n - p)
    args = (a, b, ["k"], "t", "u", "v")
    assert {r["i"]: (r["near_t"], r["near_v"]) for r in J.asof_nearest(*args).collect()} == nearest
    assert {r["i"]: (r["next_t"], r["next_v"]) for r in J.asof_forward(*args).collect()} == forward
    assert {r["i"]: r["interp"] for r in J.interp_join(*args).collect()} == pytest.approx(interp)


def test_masked_samples(spark, sides):
    samples, starts = sides
    spans = [(k, t, t + (i % 4)) for k, i, t, _ in starts if i % 5 == 0]
    got = J.mask_intervals(spark.createDataFrame(samples, SCHEMA), spark.createDataFrame(spans, "k string, t_start double, t_stop double"), ["k"])
    want = {i: None if any(k == z and a <= t <= b for z, a, b in spans) else v for k, i, t, v in samples}
    assert {r["i"]: r["v"] for r in got.collect()} == want


def test_false_discovery(spark, series):
    rows = [(k, i, t, None if v is None else (v + 1) / 700) for k, i, t, v in series]
    df = spark.createDataFrame(rows, SCHEMA)
    for family, groups in ((["k"], by_key(rows)), (["one"], {1: rows})):
        want = {}
        for own in groups.values():
            p = sorted(r[3] for r in own if r[3] is not None)
            for _, i, _, x in own:
                want[i] = None if x is None else min(1.0, min(z * len(p) / sum(y <= z for y in p) for z in p if z >= x))
        got = X.fdr_bh(df.withColumn("one", F.lit(1)), "v", family).collect()
        assert {r["i"]: r["p_adj"] for r in got} == pytest.approx(want)
        assert all(r["reject"] == (None if r["p_adj"] is None else r["p_adj"] <= 0.05) for r in got)
        assert set(got[0].asDict()) == {"k", "i", "t", "v", "one", "p_adj", "reject"}


def test_exact_quantiles(spark, series):
    qs = [0.0, 0.05, 0.5, 0.8, 1.0]
    extra = [("none", 9001, 0.0, None), ("single", 9002, 0.0, 3.5)]
    df = spark.createDataFrame(series + extra, SCHEMA)
    got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", qs).collect()}
    groups = by_key(series + extra)
    assert got.keys() == groups.keys() and got["none"] == [None] * 5 and got["single"] == [3.5] * 5
    for k, own in groups.items():
        if k != "none":
            assert got[k] == pytest.approx(np.quantile([r[3] for r in own if r[3] is not None], qs).tolist())
    whole = exact_quantiles(df, [], "v", [0.5]).first()["q"][0]
    assert whole == np.median([r[3] for r in series + extra if r[3] is not None])
    assert {r["k"]: r["m"] for r in T.median_by(df, ["k"], "v", 0.8, "m").collect()} == {k: None if k == "none" else pytest.approx(got[k][3]) for k in groups}
    assert exact_quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_bins_and_trimmed_channels(spark, series):
    rows = [r for r in series if r[0] is not None and r[3] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["k"], r["bin"]): r["n"] for r in X.quantile_bins(df, "v", 4, ["k"]).groupBy("k", "bin").agg(F.count("*").alias("n")).collect()}
    equal = {(r["k"], r["bin"]): (r["n"], round(r["x_mean"], 9)) for r in X.equal_count_bins(df, "v", 5, ["k"], "t", "i").collect()}
    want, bins = {}, {}
    for k, own in by_key(rows).items():
        edges = np.quantile([r[3] for r in own], [0.25, 0.5, 0.75])
        for r in own:
            at = (k, min(3, int((edges <= r[3]).sum())))
            want[at] = want.get(at, 0) + 1
        ordered = sorted(own, key=lambda r: (r[3], r[1]))
        for b, part in enumerate(np.array_split(np.array([r[3] for r in ordered]), 5), 1):
            if len(part):
                bins[(k, b)] = (len(part), round(float(part.mean()), 9))
    assert got == want and equal == bins
    top = {r["k"]: (r["channel"], r["v"]) for r in A.top_channel(df.withColumnRenamed("i", "channel"), ["k"], "v", trim=(0.05, 0.95)).collect()}
    for k, own in by_key(rows).items():
        low, high = np.quantile([r[3] for r in own], [0.05, 0.95])
        inside = [r for r in own if low <= r[3] <= high]
        if inside:
            best = max(r[3] for r in inside)
            assert top[k] == (min(r[1] for r in inside if r[3] == best), best)


@pytest.mark.parametrize("block, max_lag", [(7, 3), (5, 12), (4096, 2)])
def test_lag_products_by_blocks(spark, block, max_lag):
    """Blocks of any size give the plain sums: gaps, nulls, a constant series, series of different length."""
    from tessera.operators import signals as S

    rng = np.random.default_rng(block)
    series = {(k, side): [(i + first, None if rng.random() < 0.1 else float(rng.normal())) for i in range(n) if rng.random() < 0.9] for k, side, first, n in [("x", "a", 0, 60), ("x", "b", -4, 50), ("y", "a", 3, 9), ("y", "b", 0, 30), ("only", "a", 0, 5)]}
    series |= {("flat", s): [(i, 2.0) for i in range(6)] for s in "ab"}
    frame = lambda side: spark.createDataFrame([(k, i, v) for (k, s), rows in series.items() if s == side for i, v in rows], "k string, i long, v double").repartition(4)
    z = {}
    for key, rows in series.items():
        values = np.array([v for _, v in rows if v is not None])
        z[key] = {i: None if v is None or values.std() == 0 else (v - values.mean()) / values.std() for i, v in rows}
    for norm in ("n", "overlap"):
        want = {}
        for k in ("x", "y", "flat"):
            for lag in range(-max_lag, max_lag + 1):
                pairs = [(v, z[k, "b"][i + lag]) for i, v in z[k, "a"].items() if i + lag in z[k, "b"]]
                valid = [p * q for p, q in pairs if p is not None and q is not None]
                n = len(z[k, "a"]) - (abs(lag) if norm == "overlap" else 0)
                if pairs:
                    want[k, lag] = pytest.approx(sum(valid) / n) if valid and n else None
        got = {(r["k"], r["lag"]): r["r"] for r in S.xcorr(frame("a"), frame("b"), ["k"], max_lag, norm, block).collect()}
        assert got == want


@pytest.mark.parametrize("block", [41, 64, 4096])
def test_smoothing_by_blocks(spark, block):
    from tessera.functions import kernels as K
    from tessera.operators import signals as S

    rng = np.random.default_rng(block)
    series = {n: rng.normal(size=n).cumsum() for n in (1, 2, 19, 20, 21, 41, 42, 83, 300)}
    df = spark.createDataFrame([(n, i, float(v)) for n, x in series.items() for i, v in enumerate(x)], "k int, i long, v double").repartition(3)
    got = {(r["k"], r["i"]): r["v"] for r in S.filtfilt_fir(df, ["k"], block=block).collect()}
    want = {(n, i): v for n, x in series.items() for i, v in enumerate(K.filtfilt_fir(x, K.gausswin(20)))}
    assert got.keys() == want.keys() and got == pytest.approx(want)
